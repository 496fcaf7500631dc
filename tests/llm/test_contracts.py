"""Cases that once broke a contract."""

import random

import numpy as np

from tallgrass.llm import common, langid, mixing, quality, sharding, simhash, substrings


def test_bytes_that_repeat_in_another_row_of_the_same_id(spark):
    r = random.Random(8)
    shared = "".join(r.choice("abcdefghijklmnop") for _ in range(400))
    rows = spark.createDataFrame([(1, "one:" + shared), (1, "another beginning;" + shared)], "doc_id long, text string")
    assert sorted(r.n_removed for r in substrings.dedup_bytes(rows).collect()) == [0, 400]


def test_unlike_long_words_have_unlike_hashes():
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    data = np.frombuffer((one + one.translate(str.maketrans("ab", "ba")) + one).encode(), np.uint8)
    a, b, c = common.span_hashes(data, np.array([0, 1024, 2048]), np.array([1024, 2048, 3072])).tolist()
    assert a == c != b


def test_letters_without_a_known_gram_get_a_language(spark):
    docs = spark.createDataFrame([(i, f"plain english words number {i}", "en") for i in range(40)] + [(100, "\u041f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440", None), (101, "\u6f22\u5b57", None), (102, "12 !", None)], "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert [found[i] for i in (100, 101, 102)] == ["en", "en", "und"]


def test_clashing_columns_pass_through(spark):
    names = ["m", "base", "want", "words", "code", "book", "row", "bits", "size_of", "k1", "k2", "c", "node"]
    docs = spark.range(6).selectExpr("id AS doc_id", "concat('some text ', id) AS text", "'s' AS source", *[f"'{n}' AS {n}" for n in names])
    for out in (mixing.mix(docs), sharding.shard(docs, 20), simhash.keep_one(docs)):
        assert all(r[n] == n for r in out.collect() for n in names) and out.count() == 6


def test_stage_keeps_unlike_rows_of_one_id(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (2, "m n o p q r"), (2, "m n o p q r")], "doc_id long, text string")
    assert sorted(r.text[0] for r in simhash.keep_one(docs).collect()) == ["a", "g", "m"]


def test_quality_counts_all_labels(spark):
    docs = spark.range(150_000).selectExpr("id AS doc_id", "concat('word', id % 997) AS text")
    ratio, _ = quality.fit(docs, docs.selectExpr("doc_id", "1 AS quality"))
    assert not ratio.any()  # all documents are good ones, so the two multinomials are one


def test_quality_is_the_same_however_labels_are_joined(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.limit(9)).union(docs.selectExpr("CAST(NULL AS BIGINT)", "text").limit(3))
    labels = spark.createDataFrame([(i, (i // 3) % 2) for i in range(0, 200, 2)] + [(4, 0), (4, 1), (None, 1), (6, None), (10**6, 1)], "doc_id long, quality int")
    want = quality.judge(docs, labels).collect()
    monkeypatch.setattr(quality, "BROADCAST", 10)
    got = quality.judge(docs, labels).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len({r.kept for r in got}) == 2


def test_links_send_no_cells_or_balls_through_the_driver(spark):
    fps = spark.range(300).selectExpr("id * 7 AS fp")
    for df in (simhash._met(fps), simhash._balls(fps.distinct())):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
