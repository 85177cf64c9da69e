"""The ten operators against brute force, round trips and held-out accuracy, on whole small tables and odd rows."""

import collections
import json
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash
from test_near import slow_kept

from offerlane.llm import common, components, decontaminate, exact, fuse, language, licenses, packing, quality, queries, simhash, tokens, urls, warc
from offerlane.llm.common import table

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, rank int, key string"
ODD = [
    (1, "Alpha beta gamma delta epsilon", "en", "s", 30, 9, 9, "x"),
    (1, "Alpha beta gamma delta epsilon", "en", "s", 30, 9, 9, "x"),
    (2, "alpha  beta gamma\tdelta epsilon", "en", None, None, None, None, None),
    (3, None, None, None, None, None, None, None),
    (4, "", "de", "s", 0, 0, 0, ""),
    (5, " \n\t ", None, "s", 4, 0, 0, ""),
    (None, "no id here", "en", "s", 10, 0, 0, ""),
    (None, None, None, None, None, None, None, None),
    (6, "word " * 30_000, "en", "s", 150_000, 0, 0, ""),
    (7, "日本語 ünï <|endoftext|> x 12345", "de", "s", 10, 0, 0, ""),
    (8, "12345 !!!", "en", "s", 10, 0, 0, ""),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SMALL, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


# 1


def slow_fingerprint(text, words=4):
    ws = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    ws = re.findall("[^\x20\x09-\x0d]+", ws)
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + words]) for i in range(max(1, len(ws) - words + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius=4):
    ids, left, out = sorted(prints), set(prints), {}
    for i in ids:
        if i in left:
            todo = [i]
            left.discard(i)
            while todo:
                a = todo.pop()
                out[a] = i
                near = {b for b in left if (prints[a] ^ prints[b]).bit_count() <= radius}
                left -= near
                todo += near
    return out


def test_simhash_whole_table(spark, texts):
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    want = slow_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op1_simhash_near_dedup(spark, SMALL).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in texts}
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("hot", [8192, 3])
def test_links_close_as_brute_force(spark, hot):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 12)
    prints = {int(c) for c in centres}
    for c in centres[:4]:
        for _ in range(40):
            prints.add(int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 6), replace=False)))
    want = slow_components({p: p for p in prints})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = components.connected_components(simhash.hamming_links(df, hot_size=hot)).collect()
    got = {p: p for p in prints} | {r["node"]: r["root"] for r in found}
    assert got == want


def test_simhash_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["fp"], r["component_id"]))
    assert by[1] == by[2] and next(iter(by[1]))[1] == 1
    assert by[3] == by[4] == by[5] == {(0, 3)}
    assert (0, 3) in by[None]
    assert simhash.near_duplicates(none).count() == 0


def test_components_of_a_long_chain(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 100), (None, 3), (50, 60), (60, 50)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {60: 50}


# 2


def slow_base(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(ws), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_components_of_hubs(spark):
    """Two stars with more edges than stay cold, joined by one edge, and a small one beside them."""
    rows = [(1, i) for i in range(10, 700)] + [(i, 2) for i in range(1000, 1800)] + [(699, 1000), (5000, 5001), (5001, 5000), (7, 7)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {n: 1 for n in [2, *range(10, 700), *range(1000, 1800)]} | {5001: 5000}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_look_up_is_a_join_for_hot_and_cold_keys(spark, how):
    rows = [(i % 7 if i % 3 else 100, i) for i in range(1200)] + [(None, -1), (55, -2)]
    found = [(k, sum(r[0] == k for r in rows), None if k == 3 else f"v{k}") for k in (100, *range(6))]
    left, right = spark.createDataFrame(rows, "k long, i long"), spark.createDataFrame(found, "k long, n long, v string")
    assert sorted(common.look_up(left, right, "k", len(rows), how).collect(), key=lambda r: r.i) == sorted(left.join(right, "k", how).collect(), key=lambda r: r.i)


def test_licenses_whole_table(spark, texts):
    got = queries.op2_license_scan(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == slow_base(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_templates_match_only_their_mandatory_wording():
    labels = lambda t: set(licenses.scan(t.encode())["spans"])
    assert labels("x Licensed under the Apache License, Version 2.0. y") == {"apache-2.0"}
    assert labels("licensed under the apache license 2.0") == {"apache-2.0"}
    assert labels("licensed under the apache licence 2.0") == set()
    assert labels("Licensed under a Creative Commons CC BY-NC 4.0 International License") == {"cc-by-nc-4.0"}
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the {}), to deal in the Software without restriction"
    assert labels(grant.format('"Software"')) == labels(grant.format('"Foo Bar"')) == {"mit-grant"}
    assert labels(grant.format('"one two three four"')) == set()
    r = licenses.scan(b"mit license mit license")
    assert (r["n_base"], r["first_word"], r["last_word"], r["score"]) == (2, 0, 2, 0.5)


def test_licenses_odd_rows(odd, none):
    got = licenses.scan_licenses(odd).collect()
    assert len(got) == len(ODD) and all(r["n_words"] == slow_base(o[1] or "")[0] for r, o in zip(got, ODD))
    assert licenses.scan_licenses(none).count() == 0


# 3


def test_fuse_filter_refuses_nothing_it_holds():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 10, 1000, 60_000):
        keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        f = fuse.FuseFilter.unpack(fuse.FuseFilter.build(keys).pack())
        assert f.screen(keys).all()
        assert f.screen(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)).mean() < 0.02 or n < 3


def slow_exact(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id if doc_id is not None else 0, doc_id))
    out = []
    for g in groups.values():
        best = min(g)
        out += [(r[3], best[3], len(g), r == best) for r in g]
    return collections.Counter(out)


def test_exact_whole_table_and_odd_rows(spark, docs, odd, none):
    for df in (docs, odd):
        got = exact.exact_duplicates(df).collect()
        assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == slow_exact([(r["doc_id"], r["text"]) for r in df.collect()])
        assert all(len(r["text_sha256"]) == 64 for r in got)
    assert exact.exact_duplicates(none).count() == 0


def test_texts_of_one_digest_are_compared_and_split(spark, docs, odd, monkeypatch):
    groups = exact.digests(docs).groupBy("sha").agg({"doc_id": "count"}).withColumnRenamed("count(doc_id)", "n")
    for most in (1_000_000, 0):
        assert exact.differing(docs, groups, most=most).count() == 0
    whole = {id(df): (exact.exact_duplicates(df).drop("text_sha256").collect(), exact.without_copies(df).collect()) for df in (docs, odd)}
    monkeypatch.setattr(exact.F, "sha2", lambda c, n: exact.F.lit("ab" * 32))
    for most in (1_000_000, 0):
        wrong = spark.createDataFrame([(bytes.fromhex("ab" * 32), 2)], "sha binary, n long")
        assert exact.differing(docs, wrong, most=most).count() == 1
    for df in (docs, odd):
        assert collections.Counter(exact.exact_duplicates(df).drop("text_sha256").collect()) == collections.Counter(whole[id(df)][0])
    monkeypatch.setattr(exact, "one_row", lambda docs, mark, kept: docs.limit(0))
    assert collections.Counter(exact.without_copies(odd).collect()) == collections.Counter(whole[id(odd)][1])


# 4


def slow_verdict(url, rules=urls.BASE_RULES + urls.OWN_RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
    form = "\x01".join((host, path, (re.search(r"(?s)[?#].*", url or "") or [""])[0].lower()))
    fits = [r for r in rules if re.search(r.pattern, form)]
    best = max(fits, key=lambda r: (r.base, len(r.rule), r.rule), default=None)
    return host, path, best.rule if best and best.base else None, best.verdict if best else "allow"


URLS = ["https://Blog.Example.NET/en/x?y#z", "https://example.net/EN/", "http://net/a", "http://net", "https://a.example.com/de/1", "https://badexample.com/de/1", "https://x.org/fr/", "https://x.org/fr", "no scheme", "", None,
        "https://casino.test/", "https://mycasino.test/", "https://a.test/?PHPSESSID=abcdef123456", "https://spam-farm.example.org/fr/2", "http://x.net?u=http://example.com/de/", "https://é.net/ü/"]


@pytest.mark.parametrize("inline", [2000, 0])
def test_urls(spark, inline):
    pages = spark.createDataFrame([(i, u, "r", "h") for i, u in enumerate(URLS)] + [(None, URLS[0], "r", "h")] * 2, "page_id long, url string, rule string, host string")
    got = urls.judge_urls(pages, inline=inline).collect()
    assert collections.Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == collections.Counter((r["page_id"], *slow_verdict(r["url"])) for r in pages.collect())
    assert urls.judge_urls(pages.limit(0), inline=inline).count() == 0


# 5


def manifest_of(root):
    return sorted((json.loads(x) for p in Path(root, "manifest").glob("part-*") for x in p.read_text().splitlines()), key=lambda r: r["name"])


def test_warc_round_trip(spark, tmp_path):
    long = "<html>" + "x" * 200
    rows = [(i, f"http://a/{i}\r\nX: y", f"<p>{i}</p>" * 30, "k") for i in range(60)]
    rows += [(100, "u", long, "k"), (101, None, long, "k"), (99, "u", long, "k"), (None, "u", long, "k"), (5, None, None, "k"), (6, "u", "", "k"), (7, "u", "short", "k"), (8, "u", "short", "k"), (9, "u", "é\0\r\n\r\n" * 50, "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    manifests = []
    for name, parts in (("a", 5), ("b", 3)):
        root = f"file://{tmp_path}/{name}"
        warc.write_warc(pages.repartition(parts), root, shard_bytes=8000, least_bytes=8000, roll_bytes=1500)
        manifests.append(manifest_of(tmp_path / name))
    assert manifests[0] == manifests[1] and len({f["shard"] for f in manifests[0]}) > 5 and max(f["nth"] for f in manifests[0]) > 0
    assert not Path(tmp_path, "a", "_attempts").exists()
    got = warc.read_warc(spark, f"file://{tmp_path}/a").collect()
    assert sum(f["records"] for f in manifests[0]) == len(got) == len(rows)
    html = {(r[0], len((r[2] or "").encode())): (r[2] or "").encode() for r in rows}
    for r in got:
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == html[(r["page_id"], r["payload_bytes"])]
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got if r["page_id"] not in (5, 6, 7, 8, 9)}
    assert kinds[99] == ("response", None, len(long)) and kinds[100] == kinds[101] == kinds[None] == ("revisit", 99, len(long))
    warc.write_warc(pages.limit(0), f"file://{tmp_path}/c")
    assert warc.read_warc(spark, f"file://{tmp_path}/c").count() == 0


def slow_warc(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = collections.Counter()
    for i, _, html in rows:
        t = html or ""
        refers = first.get(t) if len(t.encode()) >= 100 and first.get(t) != i else None
        out[(i, len(t.encode()), "response" if refers is None else "revisit", refers)] += 1
    return out


def test_warc_of_sparse_ids_long_pages_and_many_copies(spark, tmp_path):
    """Ids far apart share files; a page of megabytes is one record; copies of one row are dealt over shards."""
    rng = np.random.default_rng(8)
    rows = [(int(i), f"http://a/{i}", "".join(rng.choice(list("abcdef"), 500))) for i in rng.integers(-(1 << 62), 1 << 62, 60)]
    rows += [(3, "u", "z" * 3_000_000), (4, "v", "z" * 3_000_000), (None, "u", "y" * 400)] + [(7, "u", "x" * 300)] * 400 + [(8, None, "x" * 300)] * 400 + [(None, "w", "x" * 300)] * 100
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = warc.archived(pages, f"file://{tmp_path}/a").collect()
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == slow_warc(rows)
    assert len(manifest_of(tmp_path / "a")) <= 2
    warc.write_warc(pages, f"file://{tmp_path}/b", shard_bytes=100_000, least_bytes=100_000)
    split = manifest_of(tmp_path / "b")
    assert len(split) > 5 and max(f["records"] for f in split) < 400
    got = warc.read_warc(spark, f"file://{tmp_path}/b", payloads=False).collect()
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == slow_warc(rows)


# 6


def test_decontamination(spark, docs, odd):
    items = table(spark, SMALL, "benchmark")
    got = {(r["doc_id"], r["item_id"]) for r in queries.op6_benchmark_decontamination(spark, SMALL).collect()}
    plain = lambda t: " " + " ".join(w.decode() for w in licenses.words_of(t.lower().encode())) + " "
    want = set()
    benchmark = [(r["item_id"], plain(r["text"])) for r in items.collect()]
    for r in docs.collect():
        t = plain(r["text"] or "")
        want |= {(r["doc_id"], i) for i, x in benchmark if x in t}
    assert want and got == want
    clean = {r["doc_id"] for r in decontaminate.without_benchmark(docs, items).collect()}
    assert clean == {r["doc_id"] for r in docs.collect()} - {i for i, _ in want}
    odd_items = spark.createDataFrame([(1, None), (2, ""), (3, "no ID"), (3, "no id"), (4, "beta gamma delta epsilon alpha")], "item_id long, text string")
    assert decontaminate.benchmark_hits(odd, odd_items).count() == 1
    assert decontaminate.benchmark_hits(odd, odd_items.limit(0)).count() == 0


def slow_hits(held, ids, words, rows, similarity=0.8):
    """All windows of all lengths, by weighted Jaccard alone."""
    out = {}
    for row, (doc_id, text) in enumerate(rows):
        h, _ = decontaminate.word_hashes([text or ""])
        for i, item in enumerate(ids):
            k = min(5, words[i])
            s, size = decontaminate.shingles(h, k), words[i] - k + 1
            if len(np.intersect1d(s, held.held[i])):
                for at in range(max(1, len(s) - size + 1)):
                    if (x := held.similarity(collections.Counter(s[at : at + size].tolist()), i)) >= similarity:
                        key = (row, doc_id, item)
                        out[key] = max(out.get(key, (0,)), (round(x, 6), -at, min(words[i], len(h) - at)))
    return collections.Counter((d, i, -at, n, x) for (_, d, i), (x, at, n) in out.items()), {row for row, _, _ in out}


def planted(rng, vocabulary, items, docs):
    text = lambda n: list(rng.choice(vocabulary, n))
    rows = []
    for d in range(docs):
        words = items[int(rng.integers(len(items)))][1].split()
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(len(words)))
            words[at : at + int(rng.integers(0, 2))] = ["changed"] * int(rng.integers(0, 2))
        rows.append((d if d % 7 else None, " ".join(text(int(rng.integers(0, 60))) + words + text(int(rng.integers(0, 40))))))
    return rows


def test_decontamination_finds_all_windows_whatever_the_blocks(spark):
    """Items of several lengths, sharing a phrase, some twice, one without id; against all windows, in one block and in many."""
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    phrase = "which of the following statements is true about"
    items = [(i, f"{phrase} " * (i % 2) + " ".join(rng.choice(vocabulary, int(rng.integers(6, 40))))) for i in range(40)]
    items += [(5, items[6][1]), (7, items[7][1]), (None, "an item without id that has eight words"), (60, "two words"), (61, f"{phrase} {phrase}")]
    rows = planted(rng, vocabulary, items, 140) + [(900, f"{phrase} nothing"), (901, f"see {phrase} {phrase} two words"), (None, None), (902, "")]
    distinct = sorted(set(items), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    held = decontaminate.Items(distinct)
    want, hit = slow_hits(held, [r[0] for r in distinct], [len(r[1].split()) for r in distinct], rows)
    assert len(want) > 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table_ = spark.createDataFrame(items + [(70, None), (71, " . ")], "item_id long, text string")
    for item_bytes in (1 << 22, 1 << 10):
        got = decontaminate.benchmark_hits(docs, table_, item_bytes=item_bytes).collect()
        assert collections.Counter((r["doc_id"], r["item_id"], r["first_word"], r["n_words"], round(r["similarity"], 6)) for r in got) == want
        left = collections.Counter(tuple(r) for r in decontaminate.without_benchmark(docs, table_, item_bytes=item_bytes).collect())
        assert left == collections.Counter(r for i, r in enumerate(rows) if i not in hit)


def test_block_tables_find_all_within_the_radius():
    rng = np.random.default_rng(3)
    for n in (1, 50, 6000):
        prints = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)
        held = decontaminate.Prints(np.arange(n) + 10, prints)
        for _ in range(40):
            f = prints[int(rng.integers(n))] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 25)), replace=False)))
            assert held.near(f).tolist() == (np.flatnonzero(np.bitwise_count(prints ^ f) <= decontaminate.RADIUS) + 10).tolist()


def test_a_phrase_that_all_items_share_lays_no_windows():
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000)]
    items = [(i, "which of the following statements is true about " + " ".join(rng.choice(vocabulary, 20))) for i in range(1600)]
    text = " ".join("which of the following statements is true about " + " ".join(map(str, rng.integers(0, 10**6, 12))) for _ in range(50))
    held = decontaminate.Items(items)
    h, _ = decontaminate.word_hashes([text])
    (shape,) = held.shapes
    assert len(shape.hits(decontaminate.shingles(h, 5))[0]) == 0


# 7, 8


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    field = quality.Field(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), np.zeros(quality.FEATURES + 1), rng.normal(size=(2, 2)))
    counts = np.array([3, 1, 4])
    e = rng.normal(size=8)
    got, at = field.marginals(e, counts), 0
    for n in counts:
        weight = {}
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            weight[code] = np.exp(sum(e[at + i] * y[i] for i in range(n)) + sum(field.moves[a, b] for a, b in zip(y, y[1:])))
        for i in range(n):
            assert got[at + i] == pytest.approx(sum(w for c, w in weight.items() if c >> i & 1) / sum(weight.values()))
        at += n


def test_quality_held_out(spark, odd, none):
    d = "/root/testdata/sf0.01"
    want = {r["doc_id"]: r["quality"] for r in table(spark, d, "labels").collect()}
    got = [r for r in queries.op7_quality_classifier(spark, d).collect() if r["held_out"] and r["doc_id"] in want]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == want[r["doc_id"]] for r in got]) > 0.95
    scored = quality.score_quality(odd, table(spark, d, "labels")).collect()
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.score_quality(none, table(spark, d, "labels")).count() == 0
    assert quality.good_documents(odd, table(spark, d, "labels")).columns == odd.columns


def test_language_held_out(spark, odd, none):
    d = "/root/testdata/sf0.01"
    want = {r["doc_id"]: r["lang"] for r in table(spark, d, "documents").collect()}
    got = [r for r in queries.op8_language_id(spark, d).collect() if r["held_out"]]
    assert got and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got)
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in got]) > 0.97
    pred = collections.defaultdict(set)
    for r in language.identify(odd).collect():
        pred[r["doc_id"]].add(r["lang_pred"])
    assert pred[3] == pred[4] == pred[5] == pred[8] == {"und"} and pred[1] <= {"en", "de"}
    assert language.identify(none).count() == 0


def plain_ftrl(x, y, classes):
    """FTRL-proximal, one weight after the other."""
    d = x.shape[1]
    z, n, w = [[0.0] * classes for _ in range(d)], [[0.0] * classes for _ in range(d)], [[0.0] * classes for _ in range(d)]
    order = np.random.default_rng(7)
    for _ in range(language.EPOCHS):
        for at in np.array_split(order.permutation(len(x)), max(1, len(x) // language.BATCH)):
            grads = [[0.0] * classes for _ in range(d)]
            for i in at:
                scores = [sum(x[i, j] * w[j][c] for j in range(d)) for c in range(classes)]
                e = [np.exp(v - max(scores)) for v in scores]
                for c in range(classes):
                    error = e[c] / sum(e) - (c == y[i])
                    for j in range(d):
                        grads[j][c] += x[i, j] * error
            for j in range(d):
                for c in range(classes):
                    g = grads[j][c]
                    z[j][c] += g - ((n[j][c] + g * g) ** 0.5 - n[j][c] ** 0.5) / language.ALPHA * w[j][c]
                    n[j][c] += g * g
                    v = z[j][c]
                    w[j][c] = 0.0 if abs(v) <= language.L1 else -(v - np.sign(v) * language.L1) / ((language.BETA + n[j][c] ** 0.5) / language.ALPHA + language.L2)
    return np.array(w)


def test_ftrl_and_temperature_match_plain_ones():
    rng = np.random.default_rng(11)
    x, y = rng.random((90, 6)), rng.integers(0, 3, 90)
    x[np.arange(90), y] += 1
    x[:, 5] = 0
    w = language.ftrl(x, y, 3)
    assert np.allclose(w, plain_ftrl(x, y, 3)) and not w[5].any() and ((x @ w).argmax(1) == y).mean() > 0.9
    scores = rng.normal(size=(400, 3)) * 4
    truth = np.array([rng.choice(3, p=p) for p in language._softmax(scores / 2.5)])
    loss = lambda t: -np.log(language._softmax(scores / t)[np.arange(400), truth]).mean()
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 2000))
    best = grid[int(np.argmin([loss(t) for t in grid]))]
    assert language.temperature(scores, truth) == pytest.approx(best, rel=0.01) and language.temperature(scores[:0], truth[:0]) == 1
    assert loss(language.temperature(scores, truth)) < loss(1.0)


def test_tf_idf_of_n_grams():
    texts = ["Ab", "b", ""]
    counts = language.counts_of([t.encode() for t in texts])
    for t, row in zip(texts, counts):
        padded = f" {t.lower()} "
        assert row.sum() == sum(max(0, len(padded) - n + 1) for n in language.ORDERS)
    idf = np.full(language.BUCKETS, 2.0, np.float32)
    want = np.log1p(counts[0]) * 2
    assert np.allclose(language._tf_idf(counts, idf)[0], want / np.sqrt((want**2).sum()))


def test_language_learns_once_from_repeated_rows(spark, monkeypatch):
    rows = [(1, "the cat and the dog", "en")] * 300 + [(3, "der hund und die katze", "de")] * 5 + [(i, f"the {i} and the", "en") for i in range(10, 40)] + [(i, f"der {i} und die", "de") for i in range(50, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    first, again = (language.train(docs.repartition(n)) for n in (3, 5))
    assert first.classes == ["de", "en"] and np.array_equal(first.weights, again.weights)
    monkeypatch.setattr(language, "CLASSES", 1)
    with pytest.raises(ValueError):
        language.train(docs)


def test_gradient_of_the_field():
    """What fit() follows is the slope of the labels' likelihood, by differences."""
    rng = np.random.default_rng(4)
    counts, labels = np.array([3, 2]), np.array([1, 0])
    z = rng.normal(size=(5, 4))
    y = np.repeat(labels, counts)

    def loss(at):
        field = quality.Field(np.zeros(4), np.ones(4), at[:4], at[4:].reshape(2, 2))
        e = z @ at[:4]
        _, _, logs = field.marginals(e, counts, pairs=True)
        own = sum(e[i] * y[i] for i in range(5)) + sum((n - 1) * field.moves[k, k] for n, k in zip(counts, labels))
        return logs.sum() - own

    at = rng.normal(size=8)
    field = quality.Field(np.zeros(4), np.ones(4), at[:4], at[4:].reshape(2, 2))
    good, moves, _ = field.marginals(z @ at[:4], counts, pairs=True)
    seen = np.array([[1.0, 0], [0, 2.0]])
    slope = np.concatenate((z.T @ (good - y), (moves - seen).ravel()))
    step = 1e-5
    assert np.allclose(slope, [(loss(at + step * d) - loss(at - step * d)) / (2 * step) for d in np.eye(8)], atol=1e-5)


# 9, 10

STRANGE = ["", "   ", "aaaaaaaa aaaaaaaaaaaaa", "x<|endoftext|>y <|endoftext|>", "don't we'll", "é ü 日本語 🙂🙂  x", "  a\x1c\x1d b\x85c", "\0abc \0", " '", "''s"]


def test_tokens_match_the_library(spark, texts, odd, none):
    t, m = tokenizer(), tokens.merger(tokens.vocabulary_path())
    some = STRANGE + ["".join(chr(c) for c in range(a, a + 150)) for a in range(0, 0x3000, 150)]
    rng = np.random.default_rng(1)
    some += ["".join(rng.choice(list("etaoinshrdlu"), n)) for n in (129, 1000, 300_000)] + ["a" * 5000, "ab" * 4000, "x " + "aa" * 400 + "b", "日本" * 900, "1" * 999]
    assert [np.frombuffer(x, "<u4").tolist() for x in m.encode(some)] == [e.ids for e in t.encode_batch(some, add_special_tokens=False)]
    for r in queries.op9_token_counts(spark, SMALL).collect():
        n = len(t.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 512)
    assert tokens.count_tokens(odd).count() == len(ODD) and tokens.count_tokens(none).count() == 0


def check_pieces(pieces, rows, size=1024):
    t = tokenizer()
    per_doc, per_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        per_doc[p["doc_id"]].append(p)
        per_sequence[p["sequence_id"]].append(p)
    for doc_id, texts in rows.items():
        want = collections.Counter()
        wholes = [np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4") for x in texts]
        assert sum(len(w) for w in wholes) == sum(p["length"] for p in per_doc[doc_id])
        for p in per_doc[doc_id]:
            assert any(p["doc_tokens"] == len(w) and zlib.crc32(w[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for w in wholes)
        want.update(i for w in wholes for i in range(len(w)))
        assert want == collections.Counter(i for p in per_doc[doc_id] for i in range(p["start"], p["start"] + p["length"]))
    assert sorted(per_sequence) == list(range(len(per_sequence)))
    for own in per_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at == size or (at < size and at & (at - 1) == 0)


def test_packing(spark, texts, odd, none):
    check_pieces(queries.op10_packing(spark, SMALL).collect(), {i: [t] for i, t in texts.items()})
    rows = collections.defaultdict(list)
    for r in ODD:
        rows[r[0]].append(r[1])
    check_pieces(packing.pack(odd).collect(), rows)
    assert packing.pack(none).count() == 0


def exact_sum(lengths, need, size):
    """The least number of sequences in the linear program, by a check that no filling is worth more than one at its prices."""
    columns, x, bound = packing.program(lengths, need, size, 0, 0, 0)
    y = np.maximum(np.linalg.inv(columns).sum(0), 0)

    def best(room, at):
        if at < 0:
            return 0.0
        return max(k * y[at] + best(room - k * int(lengths[at]), at - 1) for k in range(room // int(lengths[at]) + 1))

    assert best(size, len(lengths) - 1) <= 1 + 1e-6
    assert np.allclose(columns @ x, need, rtol=1e-3) and x.min() >= 0
    return x.sum(), float(y @ need)


def test_the_program_reaches_the_optimum():
    rng = np.random.default_rng(6)
    for _ in range(8):
        lengths = np.sort(rng.choice(np.arange(3, 32), 9, replace=False))
        need = rng.integers(1, 500, 9).astype(float)
        primal, dual = exact_sum(lengths, need, 32)
        assert primal == pytest.approx(dual, rel=1e-3)


def share_and_gaps(counts, size=1024):
    chosen, used = packing.patterns(counts, size), collections.Counter()
    for pattern, n in chosen:
        assert 0 < sum(a * b for a, b in pattern.items()) <= size and n > 0
        for length, copies in pattern.items():
            used[length] += n * copies
    assert all(used[x] <= counts[x] for x in used)
    whole, placed = sum(x * n for x, n in counts.items() if 0 < x < size), sum(x * n for x, n in used.items())
    gaps = sum(n * (size - sum(a * b for a, b in p.items())) for p, n in chosen)
    assert gaps <= whole - placed < gaps + 2 * size
    return placed / whole


def test_patterns_place_nearly_all_remainders(docs):
    rng = np.random.default_rng(4)
    assert share_and_gaps(collections.Counter((rng.exponential(300, 60_000).astype(int) % 1023 + 1).tolist())) > 0.99
    assert share_and_gaps({1000: 50}) > 0.95 and share_and_gaps({5: 1}) == 0
    assert share_and_gaps({x: int(n) for x, n in zip(rng.choice(1023, 300, replace=False) + 1, rng.integers(1, 200, 300))}) > 0.95
    assert packing.patterns({}) == []
    t = tokenizer()
    table_ = table(docs.sparkSession, "/root/testdata/sf0.01", "documents")
    r = collections.Counter((len(e.ids) + 1) % 1024 for e in t.encode_batch([x["text"] or "" for x in table_.select("text").collect()], add_special_tokens=False))
    assert share_and_gaps(r) > 0.9 and share_and_gaps({x: 100 * n for x, n in r.items()}) > 0.98


def test_packing_of_many_copies(spark):
    """A third of the rows alike, rows without id, and long documents among them."""
    rows = [(10_007, "one text that stands here many times")] * 3000 + [(None, None)] * 2500 + [(i, "word " * (i % 900)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    pieces = packing.pack(docs).collect()
    spans = collections.defaultdict(list)
    for p in pieces:
        spans[p["sequence_id"]].append((p["offset"], p["length"]))
    for s in spans.values():
        assert sum(n for _, n in s) == 1024 or bin(sum(n for _, n in s)).count("1") == 1
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(s), sorted(s)[1:]))
    assert sorted(spans) == list(range(len(spans)))
    copies = [p for p in pieces if p["doc_id"] == 10_007]
    n = copies[0]["doc_tokens"]
    assert collections.Counter(i for p in copies for i in range(p["start"], p["start"] + p["length"])) == {i: 3000 for i in range(n)}


# the pipeline


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents")
    columns, labels = docs.columns, {r["doc_id"]: r["quality"] for r in table(spark, d, "labels").collect()}
    seen = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d).cache()
        assert docs.columns == columns
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
        assert set(seen[-1]) <= set(seen[-2])
    source, good, single, near, clean = seen
    assert not any(labels.get(i) == 0 for i in good) and sum(labels.get(i) == 1 and i not in good for i in source) <= 2
    best = {}
    for i, t in good.items():
        k = re.sub("[\x20\x09-\x0d]", "", t)
        best[k] = min(best.get(k, (0, 1 << 60)), (-len(t), i))
    assert set(single) == {i for _, i in best.values()}
    assert set(near) == slow_kept(single) and len(near) < len(single)
    hit = {r["doc_id"] for r in decontaminate.benchmark_hits(spark.createDataFrame(list(near.items()), "doc_id long, text string"), table(spark, d, "benchmark")).collect()}
    assert hit and set(clean) == set(near) - hit
    check_pieces(corpus_pipeline.packing_stage(spark, docs, d).collect(), {i: [t] for i, t in clean.items()})


def test_pipeline_stages_on_odd_rows_and_empty_tables(spark, odd, none):
    """Null and repeated ids, empty and long texts, columns with clashing names: every stage against what it says."""
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    key = lambda r: tuple(r)
    rows = [tuple(r) for r in odd.collect()]
    for (_, stage), want in zip(
        corpus_pipeline.STAGES[:-1],
        (
            [r for r, s in zip(rows, quality.score_texts(quality.train(odd, table(spark, d, "labels")), [(r[1] or "").encode() for r in rows])) if s >= quality.THRESHOLD],
            None,
            None,
            rows,
        ),
    ):
        got = stage(spark, odd, d)
        assert got.columns == odd.columns
        got = collections.Counter(map(key, got.collect()))
        assert not got - collections.Counter(rows)
        if want is not None:
            assert got == collections.Counter(want)
        assert stage(spark, none, d).count() == 0 and stage(spark, none, d).columns == none.columns
    exact_kept = [tuple(r) for r in corpus_pipeline.exact_stage(spark, odd, d).collect()]
    texts = lambda rows: collections.Counter(re.sub("[\x20\x09-\x0d]", "", r[1] or "") for r in rows)
    assert texts(exact_kept) == collections.Counter(set(texts(rows)))
    near_kept = [(r[0], r[1]) for r in corpus_pipeline.near_stage(spark, odd, d).collect()]
    assert collections.Counter(t for _, t in near_kept if t and t.strip()) == collections.Counter({"Alpha beta gamma delta epsilon": 1, "no id here": 1, "word " * 30_000: 1, ODD[9][1]: 1, "12345 !!!": 1})
    assert len(near_kept) == 6 and corpus_pipeline.packing_stage(spark, none, d).count() == 0


def test_stages_keep_columns_of_any_name_and_type(spark, monkeypatch):
    """Names that the operators use themselves, names with dots, maps and arrays; where equal digests differ in text too."""
    import corpus_pipeline

    names = "doc_id long, text string, n string, hot int, _mark string, row string, key string, sha string, mark int, `a.b` int, many map<string,int>, list array<int>, norm string, rank int"
    extra = ("x", 1, "m", "r", "k", "s", 5, 7, {"a": 1}, [1, 2], "z", 3)
    texts = ["one two three four five six", "one  two three four five six", "another text of some words here", None, "", None]
    rows = [(i if i != 4 else None, t, *extra) for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, names)
    kept = lambda df: collections.Counter((r["doc_id"], r["text"]) for r in df.collect())
    want = {(1, texts[1]): 1, (2, texts[2]): 1, (3, None): 1}
    for hashed in (False, True):
        if hashed:  # all texts under few digests
            monkeypatch.setattr(exact, "differing", lambda docs, groups, *a: groups.select("sha"))
        got = corpus_pipeline.exact_stage(spark, docs, SMALL)
        assert got.columns == docs.columns and kept(got) == want and got.first()["a.b"] == 7
    near = corpus_pipeline.near_stage(spark, docs, SMALL)
    assert near.columns == docs.columns and kept(near) == {(0, texts[0]): 1, (2, texts[2]): 1, (3, None): 1}
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.decontamination_stage):
        assert stage(spark, docs, SMALL).columns == docs.columns
    assert corpus_pipeline.packing_stage(spark, docs, SMALL).count() >= len(rows)
