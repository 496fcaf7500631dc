"""Python functions over Arrow batches: many small rows share a batch, large ones do not pile up; results as by single rows."""

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from tallgrass.functions import text as T
from tallgrass.functions.arrow import RUN_BYTES, RUN_ROWS, runs
from tallgrass.operators import extract, lint, prose


def test_many_small_files_share_batches():
    """A batch per file cost more than its parsing did."""
    files_ = pa.RecordBatch.from_pydict({"path": [f"a/{i}.py" for i in range(5000)], "lang": ["python"] * 5000, "text": [f"def f{i}(): g()" for i in range(4998)] + ["def (", None]})
    out = list(extract._extracted(iter([files_])))
    assert len(out) <= 5000 // 4096 + 1
    rows = [r for b in out for r in b.to_pylist()]
    got = {(r["node"]["kind"], r["node"]["qn"]) for r in rows if r["node"]}
    assert len(got) == 9998 and ("Function", "a::7::f7") in got and ("File", "a::4999:file") in got
    assert [r["edge"]["source"] for r in rows if r["edge"]] == [f"a::{i}::f{i}" for i in range(4998)]


def test_calls_are_resolved_in_one_pass(spark):
    """Each of three passes over the files parsed them again."""
    src = "from x import f\nfrom y import f, g as h\ndef own(): pass\ndef k():\n    own(); own.m(); f(); h.m(); a.b.c(); self.f(); no()\n"
    found = extract.extract(spark.createDataFrame([("m.py", "python", src), ("n.py", "python", "def k():\n    own()\n")], "path string, lang string, text string"))
    done = extract.resolve(found)
    assert done._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = [("m::own", 0.8), ("m::own.m", 0.8), ("x::f", 0.8), ("y::g.m", 0.8), ("a.b.c", 0.6), ("self.f", 0.6), ("no", 0.6), ("own", 0.6)]
    calls = lambda df: sorted((r.target, r.confidence) for r in df.where("kind = 'Calls'").collect())
    assert calls(done) == calls(extract.resolve_calls(extract.nodes_of(found), extract.edges_of(found))) == sorted(want)
    assert done.where("kind = 'ImportsFrom'").count() == 2


def test_lines_of_many_small_files_share_batches():
    """A frame per file cost more than its lines did."""
    texts = ["# a\r\nb\n\n", None, "```\nx\n```", "x"] * 1000
    files_ = pa.RecordBatch.from_pydict({"path": [f"{i}.md" for i in range(4000)], "lang": ["hash", "hash", "markdown", "none"] * 1000, "text": texts})
    out = list(lint._lines_of(iter([files_]), ("path", "lang", "line", "kind", "body", "raw")))
    assert len(out) == 1
    rows = [tuple(r.values()) for r in out[0].to_pylist()]
    want = [(f"{i}.md", lang, n, kind, body, raw) for i, (lang, src) in enumerate(zip(["hash", "hash", "markdown", "none"] * 1000, texts, strict=True)) for n, ((kind, body), raw) in enumerate(zip(lint.line_kinds(src or "", lang), (src or "").replace("\r\n", "\n").split("\n"), strict=False), 1)]
    assert rows == want
    assert [tuple(r.values()) for b in lint._lines_of(iter([files_]), ("path", "kind")) for r in b.to_pylist()] == [(w[0], w[3]) for w in want]


def test_report_is_as_of_whole_lines(spark):
    files_ = spark.createDataFrame([("a.toml", "# ==========\nx\n# a world-class thing"), ("b.toml", "x"), ("c.bin", "# =========="), ("d.toml", None), ("e.rs", "//! a\n" * 7)], "path string, text string")
    assert tuple(lint.report(lint.classify(files_, "path"), lint.violations(lint.classify(files_))).first()) == (4, 2, 3, 2)


def test_embedding_hashes_words_in_batches():
    """Each byte of each word and pair was hashed on its own, in every text anew."""
    words = [f"w{i}" for i in range(200)]
    texts = ["", "A", "É é K ſ a_b _ 😀", " ".join(words), " ".join(words * 3), "word" * 500 + " b", "a a a A"]

    def plain(text):
        found = [w.translate(str.maketrans(T.UPPER, T.LOWER)) for w in regex.findall(r"[\p{L}\p{N}_]+", text)]
        out = np.zeros(256, np.float32)
        for gram in found + [f"{a}_{b}" for a, b in zip(found, found[1:], strict=False)]:
            h = 0xCBF29CE484222325
            for byte in gram.encode():
                h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
            out[h % 256] += 1 if h >> 63 else -1
        return out / np.linalg.norm(out) if out.any() else out

    assert np.array_equal(prose.embed_all(texts), [plain(t) for t in texts])
    assert prose.embed_all([]).shape == (0, 256) and np.array_equal(prose.embed(texts[3]), plain(texts[3]))


def test_embedding_of_a_table(spark):
    got = {r.id: r.embedding for r in prose.hash_embed(spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "id long, text string")).collect()}
    assert {k: list(v) for k, v in got.items()} == {1: prose.embed("a b").tolist(), 2: [0.0] * 256, 3: prose.embed("c").tolist()}


def test_prose_patterns_are_tried_where_their_words_occur(monkeypatch):
    """All hundred patterns ran over every text; a word with a long s failed the job."""
    assert prose.tighten("It utilizeſ the very best.") == ("It uses the best.", 2)
    assert prose.tighten("in ORDER to terminate, due to the fact that it is not. Sure! a horse is able to run") == ("To end, because it's not. Sure! A horse can run", 5)
    tried = []

    class Watched:
        def subn(self, new, part):
            tried.append(part)
            return part, 0

    for name in ("_STRIKE", "_DROP", "_WORD", "_OPENERS"):
        monkeypatch.setattr(prose, name, Watched())
    monkeypatch.setattr(prose, "_PHRASE_HEADS", [(h, Watched(), n) for h, _, n in prose._PHRASE_HEADS])
    prose.tighten("Nothing of these lists stands here.")
    assert not tried
    prose.tighten("juſt")  # a letter that a pattern takes for s
    assert tried


def test_runs_hold_few_bytes_or_rows():
    """A worker held the texts and results of ten thousand rows at once."""
    batch = pa.RecordBatch.from_pydict({"id": range(9000), "old": ["x" * 400_000] * 10 + [None] * 8990, "new": ["y" * 300_000] * 10 + ["z"] * 8990})
    cut = list(runs(iter([batch, batch.slice(0, 0), batch.slice(5, 7)]), "old", "new"))
    assert pa.Table.from_batches(cut).column("id").to_pylist() == [*range(9000), *range(5, 12)]
    assert all(0 < c.num_rows <= RUN_ROWS for c in cut) and all(c.num_rows == 1 or sum(len(t or "") for k in ("old", "new") for t in c.column(k).to_pylist()) <= RUN_BYTES for c in cut)


def test_text_transforms_go_by_runs(spark):
    table = spark.createDataFrame([(1, "a\nb\nin order to test this"), (2, None), (3, "")], "id long, text string")
    pairs = table.withColumn("old", F.col("text")).withColumn("new", F.regexp_replace("text", "b", "c"))
    for df in (prose.line_delta(pairs), prose.humanise(table), prose.shrink(table), prose.chunk(table), prose.hash_embed(table)):
        assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in prose.line_delta(pairs).orderBy("id").collect()] == [(1, 1, 1, "  a\n- b\n+ c\n  in order to test this"), (2, 0, 0, "  "), (3, 0, 0, "  ")]
    assert [tuple(r) for r in prose.humanise(table).orderBy("id").collect()] == [(1, 25, 16, 1, "A\nb\nto test this"), (2, None, 0, 0, ""), (3, 0, 0, 0, "")]
    assert [tuple(r) for r in prose.shrink(table).orderBy("id").collect()] == [(1, "b\nto test this"), (2, ""), (3, "")]
    assert [tuple(r) for r in prose.chunk(table).collect()] == [(1, "a", "a\nb\nin order to test this", 1, 3)]
