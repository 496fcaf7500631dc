"""The wide near-duplicate step against brute force."""

import random

import numpy as np

from tallgrass.llm import common, similar, simhash


def grams(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(pairs, ids):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {i: top(i) for i in ids}


def corpus(seed=1):
    r = random.Random(seed)
    out = []
    for _ in range(30):
        base = [f"w{r.randrange(900)}" for _ in range(r.randrange(40, 160))]
        out.append(" ".join(base))
        for _ in range(r.randrange(4)):
            copy = list(base)
            for _ in range(r.randrange(1, 4)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
            out.append(" ".join(copy))
    shared = " ".join(f"p{i}" for i in range(60))
    out += [shared + " " + " ".join(f"w{r.randrange(10**6)}" for _ in range(40)) for _ in range(20)]  # a common passage is no copy
    return [*out, "a b", "A B", "c", "", None, "long " * 9000]


def test_groups_match_brute_force(spark):
    docs = list(enumerate(corpus()))
    sets = {i: grams(t) for i, t in docs}
    true = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(x.a, x.b) for x in similar.similar_links(df).collect()]
    assert set(got) <= set(true) and len(true) > 20
    assert groups(got, sets) == groups(true, sets)
    gone = {i for i, g in groups(true, sets).items() if i != g}
    assert {x.doc_id for x in similar.repeated(df).collect()} == gone


def test_stage_keeps_one_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(1, base, "s"), (2, base, "s"), (3, base.replace("w50", "other"), "s"), (4, " ".join(f"v{i}" for i in range(100)), "s"), (None, base, "s"), (5, None, None), (5, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "None"]
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_links_past_a_shared_leader(spark):
    r = random.Random(7)
    hub = [f"w{i}" for i in range(204)]

    def changed(at):
        return " ".join(hub[:at] + [f"x{r.randrange(10**9)}" for _ in range(16)] + hub[at + 16 :])

    # all reach the hub (0.818); the last reaches nothing else, and earlier ids lead in every key it shares with the hub
    texts = [*[changed(10 + 3 * (i % 50)) for i in range(60)], " ".join(hub), " ".join(hub[:-20] + [f"y{i}" for i in range(20)])]
    docs = list(enumerate(texts))
    sets = {i: grams(t) for i, t in docs}
    true = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert [p for p in true if 61 in p] == [(60, 61)]
    got = [(x.a, x.b) for x in similar.similar_links(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert set(got) <= set(true) and groups(got, sets) == groups(true, sets)


def test_stage_follows_the_links_of_dropped_copies(spark):
    def prints(*texts):
        raw = [t.encode() for t in texts]
        return simhash.fingerprints_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))

    def share(a, b):
        return len(grams(a) & grams(b)) / len(grams(a) | grams(b))

    r = random.Random(5)
    while True:  # 1 and 2 differ in a word (fingerprints within 2 bits); 3 just reaches 0.8 with 2, but not with 1
        words = [f"w{r.randrange(10**6)}" for _ in range(454)]
        one, three = list(words), words[:-50] + [f"y{r.randrange(10**6)}" for _ in range(50)]
        one[100] = "other"
        texts = [" ".join(one), " ".join(words), " ".join(three)]
        x, y, z = prints(*texts).tolist()
        if (x ^ y).bit_count() <= 2 < min((x ^ z).bit_count(), (y ^ z).bit_count()):
            break
    assert share(texts[0], texts[2]) < 0.8 <= share(texts[1], texts[2])
    df = spark.createDataFrame([*enumerate(texts, 1), (4, "quite another text of a few words")], "doc_id long, text string")
    assert sorted(d.doc_id for d in simhash.keep_one(df).collect()) == [1, 4]


def test_large_sets_match_brute_force(spark):
    r = random.Random(11)
    texts = []
    for size in (1028, 1100, 2052, 2300, 4100):  # about the sizes at which sets get twice as many parity bits
        base = [f"w{r.randrange(10**6)}" for _ in range(size)]
        texts.append(" ".join(base))
        for change in (0.02, 0.105, 0.115, 0.3):  # of a run of words: similarities about 0.96, 0.81, 0.79, 0.54
            n = int(size * change)
            texts.append(" ".join(base[: size - n] + [f"x{r.randrange(10**9)}" for _ in range(n)]))
        texts.append(" ".join(base[: int(size * 0.83)]))  # fewer bits, or as many
        texts.append(" ".join(base + [f"y{r.randrange(10**9)}" for _ in range(size // 5)]))
    docs = list(enumerate(texts))
    sets = {i: grams(t) for i, t in docs}
    true = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    got = [(x.a, x.b) for x in similar.similar_links(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert set(got) <= set(true) and len(true) > 20
    assert groups(got, sets) == groups(true, sets)


def test_folded_parities_are_those_of_fewer_bits():
    found = np.random.default_rng(3).integers(0, 1 << 63, 5000, np.uint64)
    wide, half = similar.parities(found, 128), similar.parities(found, 64)
    assert (wide[:64] ^ wide[64:] == half).all()


def test_leaders_do_not_go_through_the_driver(spark, monkeypatch):
    plans = []

    def recorded(df, label="stage"):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return common.staged(df, label)

    monkeypatch.setattr(similar, "staged", recorded)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(k, " ".join([*words[:k], "x", *words[k:]])) for k in range(40)], "doc_id long, text string")
    assert similar.similar_links(docs).count() >= 39
    met = [plan for label, plan in plans if label == "pairs"]
    assert met and not any("Broadcast" in plan for plan in met)


def test_members_are_dealt_out_once(spark):
    rows = [(k % 7, k, 5, k % 7 if k % 7 < 4 else k) for k in range(70)]  # keys 0 to 3 have members of one group
    staged = common.staged(spark.createDataFrame(rows, "band long, node long, n int, c long"))
    split = similar._split(staged)
    assert sorted(map(tuple, split.collect())) == sorted(x for x in rows if x[0] > 3)
    assert split._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1


def test_parts_are_one_bucketed_table(spark):
    whole = spark.range(500).withColumnRenamed("id", "node")
    with common.bucketed([whole.where(f"node % 3 = {p}") for p in range(3)], "node") as table:
        assert sorted(x.node for x in table.collect()) == list(range(500))
        grouped = table.groupBy("node").count()
        assert grouped.count() == 500 and "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()


def test_marks_miss_no_row(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 3000, 3)
    bitmap, size = simhash.marks(rows, F.xxhash64("id"))
    spots = spark.range(3000).select("id", F.pmod(F.xxhash64("id"), F.lit(size)).alias("spot"))
    bits = {x.word: x.bits for x in bitmap.collect()}
    hit = {x.id for x in spots.collect() if bits.get(x.spot >> 6, 0) >> (x.spot & 63) & 1}
    assert hit >= set(range(0, 3000, 3)) and len(hit) < 1300


def test_texts_that_stay_are_not_dealt_out(spark):
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(40)) for _ in range(300)]
    rows = [*enumerate(texts), (300, texts[0]), (301, texts[1]), (None, texts[2]), (5, texts[5]), (6, texts[7])]
    docs = common.staged(spark.createDataFrame(rows, "doc_id long, text string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.keep_one(docs)
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        got = sorted((x.doc_id is None, x.doc_id or 0, x.text) for x in kept.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = [x for x in enumerate(texts) if x[0] != 7] + [(6, texts[7])]
    assert got == sorted([(False, *x) for x in want] + [(True, 0, texts[2])])
    anti = plan[plan.index("LeftAnti") :]
    assert "Union" in plan and "getbit" in anti[: anti.index("Relation")].lower()
