"""License templates on the wordings that the licenses publish."""

import re

import pytest

from offerlane.llm import licenses
from offerlane.llm.common import table

GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."


@pytest.mark.parametrize(
    "text, label",
    [
        (GNU.format("General Public License", 3), "gpl-3.0"),
        (GNU.format("General Public License", 2), "gpl-2.0"),
        ("modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "gpl-2.0"),
        (GNU.format("Lesser General Public License", "2.1"), "lgpl-2.1"),
        (GNU.format("Lesser General Public License", 3), "lgpl-3.0"),
        (GNU.format("Affero General Public License", 3), "agpl-3.0"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by-4.0"),
        ("This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc-4.0"),
        ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0"),
        ("licensed under CC BY-NC-SA 4.0", "cc-by-nc-sa-4.0"),
        ("licensed under the MIT License", "mit-notice"),
        ("Licensed under the GNU General Public License, version 3", "gpl-3.0"),
    ],
)
def test_published_wordings(text, label):
    got = licenses.scan(text.encode())
    assert set(got["spans"]) == {label} and got["score"] == 1
    assert not licenses.scan(b"under the rules of the gnu general public library, version 3")["spans"]


def spelled_out(template):
    """A template as a backtracking regular expression over words that each end with a blank."""
    out = ""
    for mark in re.findall(r"\[\[|\]\]|\{\d+\}|[^\s\[\]{}]+", template):
        out += "(?:" if mark == "[[" else ")?" if mark == "]]" else f"(?:\\S+ ){{0,{mark[1:-1]}}}" if mark[0] == "{" else re.escape(mark) + " "
    return re.compile(r"(?<!\S)" + out)


def slow_labels(text, templates):
    line = " ".join(w.decode() for w in licenses.words_of(text)) + " "
    return {label for label, forms in templates.items() if any(f.search(line) for f in forms)}


def example(template, names):
    """Words that the template accepts: optional parts kept or not, names in place of the replaceable ones."""
    text = re.sub(r"\[\[([^\[\]{}]*)\]\]", r"\1" if names else "", template)
    text = re.sub(r"\[\[|\]\]", "", text)
    return re.sub(r"\{\d+\}", names, text)


def test_labels_match_backtracking_on_the_table_and_on_each_template(spark):
    templates = {label: [spelled_out(t) for t in ts] for label, ts in licenses.WORDINGS.items()}
    assert len(templates) > 40
    texts = [(r["text"] or "").encode() for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()]
    hit = [t for t in texts if b"icense" in t]
    some = hit + texts[:200]
    for label, forms in licenses.WORDINGS.items():
        for form in forms:
            for names in ("", "Some"):
                words = example(form, names)
                some += [f"x, {words}! y".encode(), words.upper().encode(), words.replace(" the ", " teh ", 1).encode(), words.rsplit(" ", 1)[0].encode()]
                assert label in licenses.scan(words.encode())["spans"]
    assert len(hit) > 20
    for t in some:
        assert set(licenses.scan(t)["spans"]) == slow_labels(t, templates), t[:200]
