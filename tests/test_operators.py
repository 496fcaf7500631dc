import duckdb
import pytest
from pyspark.sql import functions as F

from tallgrass.functions import text as T
from tallgrass.operators import changes, events, graph, memory, prose, search
from tallgrass.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple("~" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False)), cols


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got, want = rows(registry.queries()[name](spark, SF).toPandas()), rows(duck.sql(registry.oracle_sql()[name]).df())
    assert got == want


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("text,tokens", [("", 0), ("a", 1), ("abcd", 1), ("abcde", 2), ("ññññ", 1), (None, 0)])
def test_token_estimate(spark, text, tokens):
    assert one(spark, text, T.token_estimate) == tokens


def test_line_stages(spark):
    ten = "\n".join(map(str, range(1, 11)))
    assert one(spark, "hello world", lambda c: T.truncate_lines(c, 5)) == "hell…"
    assert one(spark, ten, lambda c: T.head_tail(c, 2, 2)).split("\n") == ["1", "2", "…", "9", "10"]
    assert one(spark, "1\n2\n3\n4\n5", lambda c: T.max_lines(c, 2)).endswith("[+3 lines truncated]")
    assert one(spark, "\u001b[31mred\u001b[0m", T.strip_ansi) == "red"


def test_lint_predicates(spark):
    assert one(spark, "──────────────", T.is_banner) and not one(spark, "----", T.is_banner)
    assert one(spark, "// Layer 3 cache", T.has_layer_label) and not one(spark, "multilayer 3", T.has_layer_label)
    assert one(spark, "a world-class thing", T.marketing_phrase) == "world-class"
    assert one(spark, "## Goals", T.is_goal_header)


def test_jaccard(spark):
    df = spark.createDataFrame([(["foo", "bar", "baz"], ["foo", "bar", "qux"]), ([], [])], "a array<string>, b array<string>")
    assert [r.x for r in df.select(T.jaccard(F.col("a"), F.col("b")).alias("x")).collect()] == [0.5, 0.0]


def test_loops_are_capped(spark):
    df = spark.createDataFrame([("s", i, "user", "please fix the failing build now") for i in range(5)], "session_id string, turn int, stream string, text string")
    assert [r.is_loop for r in events.detect_loops(df).orderBy("turn").collect()] == [False, True, True, False, False]


def test_read_decisions(spark):
    data = [("s", "a", 1, 1.0, 10, False), ("s", "a", 2, 1.0, 10, False), ("s", "a", 3, 2.0, 10, False), ("s", "a", 4, 3.0, 10**9, False), ("s", "b", 5, 1.0, 10, True)]
    got = events.read_decisions(spark.createDataFrame(data, "session_id string, path string, seq int, mtime double, size long, blocked boolean")).orderBy("seq")
    assert [r.decision for r in got.collect()] == ["allow", "redundant", "delta", "allow", "blocked"]


def test_decay(spark):
    df = spark.createDataFrame([("guardrail", 1.0, 0), ("project", 1.0, 0), ("reference", 1.0, 0)], "kind string, relevance double, last_seen long")
    at = lambda days: {r.kind: r.x for r in df.select("kind", memory.decayed(days * 86400).alias("x")).collect()}
    assert at(30)["guardrail"] == 1.0 and 0.7 < at(30)["project"] < 1.0 and at(10000)["reference"] == 0.2


def test_snapshot_difference(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    old = spark.createDataFrame([("b", "2"), ("c", "4"), ("d", "5")], "path string, hash string")
    assert {r.path: r.change for r in changes.difference(new, old).collect()} == {"a": "added", "b": "unchanged", "c": "modified", "d": "removed"}


def test_search_helpers():
    assert search.query_words("Delta, delta! DELTA cache") == ["delta", "cache"]
    assert search.minimal_span("alpha one two three delta cache beta", ["delta", "cache"]) == 11
    assert search.minimal_span("only delta here", ["delta", "cache"]) is None


def test_prose():
    assert prose.tighten("In conclusion, we leverage the robust pipeline.")[0] == "We use the pipeline."
    assert prose.tighten("Keep `in order to` and https://x.y/very as is.")[0] == "Keep `in order to` and https://x.y/very as is."
    assert prose.shorten("Please note that you can use this to read the file at ./the/path") == "use to read file at ./the/path"
    assert prose.delta("a\nb", "a\nb")["adds"] == 0 and prose.delta("a\nb", "a\nc")["dels"] == 1
    assert "too long" in prose.delta("x\n" * 2001, "y")["body"]
    assert abs(float((prose.embed("read cache delta") ** 2).sum()) - 1) < 1e-5
    assert [c["content"] for c in prose.cut_paragraphs("# Title of it all\nbody\n\nshort\n\nanother paragraph here")] == ["# Title of it all\nbody", "another paragraph here"]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_digest_lists_all_targets(spark):
    turns = [(1, i, tool, f"{tool} {i % 8}", "timeout" if i == 8 else "ok") for tool in ("Read", "Write", "Grep", "WebFetch") for i in range(9)]
    turns += [(1, i, "Bash", f"cmd{i % 7} -x {i}", "err" if i == 7 else "ok") for i in range(8)] + [(1, i, "mcp__crux__crux_recall", f"m{i}", "ok") for i in range(3)] + [(1, 1, "mcp__crux__crux_execute", None, "ok")]
    got = events.digest_buckets(spark.createDataFrame(turns, "session_id long, turn long, tool string, target string, status string")).toPandas()
    assert got.groupby("bucket").size().to_dict() == {"read": 8, "edit": 8, "search": 8, "bash": 7, "other": 5, "memory": 3, "execute": 1}
    assert got[got.place == 1].set_index("bucket").loc["bash", ["item", "n", "errors"]].tolist() == ["cmd0", 2, 1]
    assert got[(got.bucket == "read") & (got.place == 1)][["item", "n", "errors"]].values.tolist() == [["Read 0", 2, 1]]
    assert got.groupby("bucket").more.max().to_dict() == {"read": 0, "edit": 0, "search": 0, "bash": 0, "other": 4, "memory": 0, "execute": 0}


def test_digest_query_takes_commands_as_its_sql_does(spark, tmp_path):
    said = [(1, 0, "user", "a\tb c"), (1, 1, "assistant", "Ends.\nNext one"), (1, 2, "assistant", "Ends. Next"), (1, 3, "assistant", " b"), (1, 4, "assistant", "\tEnds. b"), (1, 5, "assistant", None), (1, 6, None, "x\ny z")]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    name = "session_digest_buckets"
    assert rows(registry.queries()[name](spark, str(tmp_path)).toPandas()) == rows(c.sql(registry.oracle_sql()[name]).df())


def test_minimal_span_matches_brute_force():
    import random

    draw = random.Random(5)
    for _ in range(300):
        words = draw.sample(["a", "ab", "abc", "bcc", "ca"], draw.randint(1, 4))
        text = "".join(draw.choice("abc ") for _ in range(draw.randint(0, 25)))
        spots = [(i, i + len(w), w) for w in words for i in range(len(text)) if text.startswith(w, i)]
        kinds, want = {w for *_, w in spots}, None
        if len(kinds) > 1:
            spans = [(s, e) for s, *_ in spots for _, e, _ in spots if {w for b, f, w in spots if s <= b and f <= e} == kinds]
            want = min(e - s for s, e in spans)
        got = search.minimal_span(text, words)
        assert got == want, (text, words)


def test_impact_plans_do_not_grow(spark):
    chain = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(12)], "source string, target string")
    got = graph.impact(chain, "n0", 10)
    assert {(r.qn, r.depth) for r in got.collect()} == {(f"n{i}", i) for i in range(1, 11)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 12


def test_lexical_rankers_cut_a_text_once(spark):
    docs = spark.createDataFrame([(1, "Alpha beta"), (2, None), (3, "gamma beta beta")], "id long, text string")
    plan = search.bm25(docs, ["alpha", "beta", "gamma"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert search.trigram_bm25(docs, ["alpha", "beta"])._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
