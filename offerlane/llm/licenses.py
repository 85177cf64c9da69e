"""License scans by template markup: optional and replaceable regions compiled into token automata.

A template is wording with marks: [[ ... ]] may be missing, {n} stands for at most n words of any kind. It compiles into
an automaton over words whose states are sets of positions in the template; a text has the template's license where
some run of its words leads from the start to the end, so all mandatory words stand there exactly, in order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlane.llm.common import ship, texts_of

#: Fixed values of the contract: phrase and label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: The method's own labels: wording that licenses ask to be kept, with what may vary.
TEMPLATES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the [[software]] {2} to deal in [[the]] software without restriction",
    "apache-2.0": "licensed under the apache license [[version]] 2 0 [[the license]]",
    "mit-notice": "[[this {3} is]] released under the [[terms of the]] mit license",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc-grant": "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
}

#: Clauses that several licenses share, in their published words.
_ISC_GRANT = "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
_ISC_REST = "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
_MIT_GRANT = TEMPLATES["mit-grant"] + " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_MIT_NOTICE = "the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software"
_MIT_REST = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall [[the]] {6} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_SOURCE = "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_BINARY = "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAMES = "[[3]] neither the name of [[the]] {8} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_REST = "this software is provided by [[the]] {8} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"

#: Whole licenses; titles and names may vary or be missing.
WHOLE = {
    "isc": f"{_ISC_GRANT} {_ISC_REST}",
    "mit-text": f"{_MIT_GRANT} {_MIT_NOTICE} {_MIT_REST}",
    "bsd-2-clause": f"{TEMPLATES['bsd-grant']} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_REST}",
    "bsd-3-clause": f"{TEMPLATES['bsd-grant']} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAMES} {_BSD_REST}",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "0bsd": f"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted {_ISC_REST}",
    "wtfpl": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed do what the fuck you want to public license",
    "boost-1.0": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "postgresql": "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
}

#: Clauses and notices by which a license is told where its whole text isn't there.
NOTICES = {
    "mit-notice-kept": _MIT_NOTICE,
    "bsd-no-endorsement": _BSD_NAMES,
    "gpl-no-warranty": "this {1} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "apache-no-warranty": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "epl-2.0": "under the terms of the eclipse public license [[v]] [[version]] 2 0",
    "cddl-1.0": "subject to the terms of the common development and distribution license",
    "cc0-1.0": "[[creative commons]] cc0 1 0 universal",
    "ofl-1.1": "this font software is licensed under the sil open font license version 1 1",
    "artistic-2.0": "under [[the terms of]] the artistic license [[version]] 2 0",
    "mpl-1.1": "the contents of this file are subject to the mozilla public license version 1 1",
    "gfdl": "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license",
    "json": "the software shall be used for good not evil",
    "hpnd": "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee",
    "boost-notice": "distributed under the boost software license version 1 0",
}
TEMPLATES |= WHOLE | NOTICES

_PARTS = "[[licensed]] [[redistribute it and or modify it]] under the [[terms of the]] {} [[license]] [[as published by the free software foundation]] [[either]] {} [[of the license]]"
_GNU = {"gpl": ("gnu general public", ["3", "2"]), "lgpl": ("gnu lesser general public", ["3", "2 1"]), "agpl": ("gnu affero general public", ["3"])}
_CC = {"by": "attribution", "by nc": "attribution noncommercial", "by sa": "attribution sharealike", "by nd": "attribution noderivatives", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}

#: Labels whose published notices have several wordings: any of them.
WORDINGS = {label: [t] for label, t in TEMPLATES.items()}
WORDINGS["mit-notice"] += [f"[[this {{3}} is]] {w} under the [[terms of the]] mit license" for w in ("licensed", "distributed", "available")]
for _name, (_words, _versions) in _GNU.items():
    for _v in _versions:
        _label = f"{_name}-{_v.replace(' ', '.') if ' ' in _v else _v + '.0'}"
        WORDINGS[_label] = [_PARTS.format(_words, f"{mark}{_v}") for mark in ("version ", "v")]
for _short, _long in _CC.items():
    WORDINGS[f"cc-{_short.replace(' ', '-')}-4.0"] = [f"[[licensed]] under [[a]] [[the]] [[creative commons]] {w} 4 0 [[international]] [[public]] [[license]]" for w in (f"cc {_short}", f"creative commons {_long}", f"creative commons {_long.replace('noncommercial', 'non commercial').replace('sharealike', 'share alike')}")]

#: Bytes of words, A-Z lower-cased; all others are blanks.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


@dataclass(frozen=True)
class Automaton:
    """steps[i]: the word that leads from state i to i + 1, or None for any word. free[i]: the states reached from i
    without a word. The last state accepts."""

    steps: tuple
    free: tuple
    anchor: bytes  # a mandatory word run that every match holds, between blanks

    @classmethod
    def compile(cls, template: str) -> Automaton:
        steps, free, opened, runs = [], [[]], [], [[]]
        for mark in re.findall(r"\[\[|\]\]|\{\d+\}|[^\s\[\]{}]+", template):
            if mark == "[[":
                opened.append(len(steps))
                runs.append([])
            elif mark == "]]":
                free[opened.pop()].append(len(steps))
                runs.append([])
            elif mark[0] == "{":
                first, n = len(steps), int(mark[1:-1])
                steps += [None] * n
                free += [[] for _ in range(n)]
                for i in range(first, first + n):
                    free[i].append(first + n)
                runs.append([])
            else:
                steps.append(mark.encode())
                free.append([])
                if not opened:
                    runs[-1].append(mark.encode())
        return cls(tuple(steps), tuple(map(tuple, free)), b" " + b" ".join(max(runs, key=len)) + b" ")

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for j in self.free[todo.pop()]:
                if j not in states:
                    states.add(j)
                    todo.append(j)
        return states

    def match(self, words: list[bytes], at: int) -> int:
        """Where the longest match that starts at this word ends, or -1. Matches are as long as the template at most."""
        states, best, last = self._closed({0}), -1, len(self.steps)
        for k in range(at, len(words)):
            states = self._closed({s + 1 for s in states if s < last and (self.steps[s] is None or self.steps[s] == words[k])})
            if not states:
                break
            if last in states:
                best = k + 1
        return best

    def find(self, words: list[bytes]) -> tuple[int, int] | None:
        """The first match, as (from, to) in words."""
        starts = {self.steps[s] for s in self._closed({0}) if s < len(self.steps)}
        for i, w in enumerate(words):
            if (None in starts or w in starts) and (end := self.match(words, i)) >= 0:
                return i, end
        return None


AUTOMATA = {label: [Automaton.compile(t) for t in dict.fromkeys(ts)] for label, ts in WORDINGS.items()}
_PHRASES = {(" " + p + " ").encode(): label for p, label in BASE.items()}


def scan(text: bytes) -> dict:
    """One text's words, base places, template spans and score. The score is 1 where a template's whole mandatory wording
    stands, 0.5 where only base phrases stand, else 0."""
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in _PHRASES.items():
        at = line.find(phrase)
        while at >= 0:
            places.append(at)
            base.add(label)
            at = line.find(phrase, at + 1)
    starts = [line.count(b" ", 0, at) for at in (min(places), max(places))] if places else [None, None]
    found = {label: [span for a in some if a.anchor in line and (span := a.find(words))] for label, some in AUTOMATA.items()}
    spans = {label: min(at) for label, at in found.items() if at}
    return {"n_words": len(words), "n_base": len(places), "first_word": starts[0], "last_word": starts[1], "base": base, "spans": spans, "score": 1.0 if spans else 0.5 if base else 0.0}


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, last: long>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs, repeated rows too: doc_id, counts and places of base phrases, labels, score, and the
    span of words of each template found (last excluded). Null texts count as empty, and have no labels and score 0."""
    ship(docs.sparkSession)
    as_text = lambda labels: ",".join(sorted(labels))

    def run(batches):
        for b in batches:
            found = [scan(t) for t in texts_of(b.column(1))]
            columns = [b.column(0)] + [pa.array([f[k] for f in found], pa.int64()) for k in ("n_words", "n_base", "first_word", "last_word")]
            columns += [pa.array([as_text(f["base"]) for f in found], pa.string()), pa.array([as_text(f["base"] | set(f["spans"])) for f in found], pa.string()), pa.array([f["score"] for f in found], pa.float64())]
            spans = pa.array([[{"label": k, "first": x, "last": y} for k, (x, y) in sorted(f["spans"].items())] for f in found], pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*columns, spans], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
