"""op11: words are aligned once a chunk, texts are put together from them."""

from collections import Counter

from pyspark.sql import functions as F

from offerlane.llm import align


def test_words_are_aligned_once_a_chunk(spark):
    texts = ["unbelievable tokenizers", "tokenizers  are unbelievable\n", "", None, "é日 tokenizers", "Ａ wide"]
    docs = spark.createDataFrame([(i, texts[i % len(texts)]) for i in range(600)], "doc_id long, text string").repartition(3, "doc_id")
    dealt = align._dealt(docs, "doc_id", "text", align.VOCABULARY, align.PIECES, "short", 1 << 20).collect()
    words = Counter(r["row"] for r in dealt if r["n_left"] is not None)
    assert 0 < len(words) <= 3 * 8 and set(words.values()) == {1}
    assert len([r for r in dealt if r["n_left"] is None]) == 600
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) for r in align.link_scores(docs).collect()}
    cut = F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1))
    rows = align.stretches(docs).groupBy("doc_id").agg(F.count("a"), F.count("b"), cut, F.count("end"))
    assert got == {r[0]: tuple(r)[1:] for r in rows.collect()}
    assert got[0] == got[6] and got[0][0] > 0 and got[2] == got[3] == (0, 0, 0, 0)
