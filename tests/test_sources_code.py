"""Command filters, permissions, hygiene, extraction, sources and sinks on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import extract, filters, lint
from tallgrass.sources import files, sinks

STATUS = "On branch main\nYour branch is up to date.\n\nChanges not staged for commit:\n  (use \"git add\" to update)\n\tmodified:   src/lib.rs\n\nUntracked files:\n  (use \"git add\")\n\tnew.txt\n"
CASES = [
    ("git status", "On branch main\n\nnothing to commit, working tree clean\n", "git status: clean", "matched"),
    ("git status", STATUS, "branch: main\nunstaged:\n  modified: src/lib.rs\nuntracked:\n\tnew.txt", "filtered"),
    ("cargo build", "   Compiling a v0.1.0\n    Finished `dev` profile in 1s\n", "cargo: ok", "on_empty"),
    ("git log", "commit abc\n\n    msg line\n", "commit abc\n\n    msg line", "filtered"),
    ("npx jest", "PASS  src/x.test.ts\n  ✓ adds (3 ms)\n\nTests: 2 passed\n", "Tests: 2 passed", "filtered"),
    ("npm i", "up to date, 12 packages in 1s\n", "npm: up to date", "matched"),
    ("ls", "\x1b[31mred\x1b[0m\n", "red", "filtered"),
    ("ls", None, "", "filtered"),
    ("ls", "\n".join(map(str, range(300))), "\n".join([*map(str, range(200)), "… [+100 lines truncated]"]), "filtered"),
    ("git log --oneline", "\n".join(map(str, range(50))), "\n".join([*map(str, range(30)), "…", *map(str, range(45, 50))]), "filtered"),
]


def test_filters(spark):
    df = spark.createDataFrame([(i, c, t) for i, (c, t, _, _) in enumerate(CASES)], "i int, command string, text string")
    got = {r.i: (r.filtered, r.kind) for r in filters.run(df).collect()}
    assert got == {i: (want, kind) for i, (_, _, want, kind) in enumerate(CASES)}


def test_filter_toml_and_passthrough(spark, tmp_path):
    (tmp_path / "a.toml").write_text('[filters.x]\nmatch_command = "^x"\nmax_lines = 1\n[[filters.x.replace]]\npattern = "b+"\nreplacement = "B"\n')
    own = filters.load(str(tmp_path))
    df = spark.createDataFrame([("x", "abb\nc"), ("y", "abb\n")], "command string, text string")
    assert [(r.filtered, r.kind) for r in filters.run(df, own).orderBy("command").collect()] == [("aB\n… [+1 lines truncated]", "filtered"), ("abb\n", "passthrough")]


def test_permissions(spark):
    assert filters.parse_rule(" Bash(rm -rf:*) ") == ("Bash", "rm -rf", "Bash(rm -rf:*)") and filters.parse_rule("(x)") is None and filters.parse_rule("") is None
    df = spark.createDataFrame([("bash", "rm -rf /"), ("bash", "ls"), ("python", "rm -rf /"), ("node", "x")], "r string, c string")
    got = [x.p.decision for x in df.select(filters.permission(F.col("r"), F.col("c"), ["Bash(ls:*)"], ["sh(rm -rf:*)", "Bash", "js(y)"]).alias("p")).collect()]
    assert got == ["deny", "allow", "allow", "allow"]


RUST = '//! One\n//! Two\n/// Doc\nfn a() {\n    let s = "// not\n// a comment";\n    // Layer 3 here\n    /* open\n     * Goal: x\n     */\n    let r = r#"/*"#; // tail\n}\n// ==========\n'


def test_line_kinds():
    kinds = [k for k, _ in lint.line_kinds(RUST, "rust")]
    assert kinds == ["module_doc", "module_doc", "doc", "code", "code", "code", "line", "block", "block", "block", "code", "code", "line", "blank"]
    assert [k for k, _ in lint.line_kinds("a\n```\nx\n```\n\n", "markdown")] == ["prose", "markdown_code", "markdown_code", "markdown_code", "blank", "blank"]
    assert [k for k, _ in lint.line_kinds('"""d\nmore"""\nx = 1\n# c\n', "python")] == ["module_doc", "module_doc", "code", "line", "blank"]
    assert lint.line_kinds("/* /* */ still */ x", "rust")[0] == ("block", "/*") and lint.line_kinds("x", "none") == []


def test_violations_and_report(spark):
    df = spark.createDataFrame([("a.rs", RUST), ("b.md", "A world-class tool\nLayer 3 is fine here\n"), ("c.bin", "x"), ("d.rs", None), ("e.rs", "// todo: ==========\n")], "path string, text string")
    lines = lint.classify(df)
    found = {(r.path, r.line, r.rule_id, r.severity) for r in lint.violations(lines, most_doc_lines=1).collect()}
    assert found == {("a.rs", 1, "long_module_doc", "error"), ("a.rs", 7, "layer_label", "warn"), ("a.rs", 9, "goal_section", "error"), ("a.rs", 13, "decorative_banner", "error"), ("b.md", 1, "marketing_phrase", "warn")}
    assert lint.report(lines, lint.violations(lines)).first().asDict() == {"files_scanned": 4, "files_with_violations": 2, "violations": 4, "errors": 2}


def test_fix_and_strip(spark):
    assert lint.fix("// ==========\n// Goals:\n// - a\n// text\nfn a() {}\n", "rust") == ("// text\nfn a() {}\n", 3)
    assert lint.fix("//! a\n//! b\n//! c\nx\n", "rust", most_doc_lines=2) == ("//! a\nx\n", 2)
    assert lint.fix("x\n\n\n", "rust") == ("x\n\n\n", 0)
    assert lint.strip("// gone\n\nfn a() {} // tail\n\n// SAFETY: kept\n\n// gone\n\nlet x;\n", "rust")[0] == "fn a() {} // tail\n\n// SAFETY: kept\n\nlet x;\n"
    assert lint.strip("/// ```\n/// code\nfn a() {}\n", "rust")[1] == 0
    df = spark.createDataFrame([("a.rs", "// x\nfn a() {}\n"), ("b.rs", "fn b() {}\n")], "path string, text string")
    assert [(r.path, r.new_text, r.lines_removed) for r in lint.rewrite(df, "strip").collect()] == [("a.rs", "fn a() {}\n", 1)]


@pytest.mark.parametrize(
    ("path", "lang", "src", "nodes", "edges"),
    [
        ("src/lib.rs", "rust", "fn answer() -> i32 { helper() }\nimpl Foo {\n  fn bar(&self) { self.x(); }\n}\n", {("answer", "Function"), ("bar", "Method")}, {"helper", "self.x"}),
        ("foo.py", "python", "class Foo:\n    def bar(self):\n        return baz(1)\n", {("Foo", "Class"), ("bar", "Method")}, {"baz"}),
        ("a.js", "javascript", "function main() { greet('hi(x)'); }\nclass A { m() { if (x) { y() } } }\n", {("main", "Function"), ("A", "Class"), ("m", "Method")}, {"greet", "y"}),
        ("a.lua", "lua", "function M.go(x)\n  if x then work(x) end\nend\n", {("go", "Method")}, {"work"}),
        ("a.sh", "bash", "release() {\n  build now\n}\n", {("release", "Function")}, {"build"}),
    ],
)
def test_extraction(path, lang, src, nodes, edges):
    got_nodes, got_edges = extract.parse(path, lang, src)
    assert {(n[1], n[0]) for n in got_nodes if n[0] != "File"} == nodes
    assert {e[2] for e in got_edges if e[0] == "Calls"} == edges


def test_extraction_details():
    nodes, edges = extract.parse("src/x.ts", "typescript", "export default function bar() { return 1; }\n")
    assert [n[2] for n in nodes] == ["src/x:file", "src/x::bar"] and [(e[0], e[2]) for e in edges] == [("ExportsDefault", "src/x::bar")]
    assert next(n for n in extract.parse("a.rs", "rust", "#[test]\nfn it_works() { }\n")[0] if n[1] == "it_works")[-1]
    assert [n[0] for n in extract.parse("a.py", "python", "def (")[0]] == ["File"]
    assert extract.imports("use crate::util::{delta, inner::{self, Foo as Bar}};") == [("delta", "crate::util::delta"), ("inner", "crate::util::inner"), ("Bar", "crate::util::inner::Foo")]
    assert extract.imports("import d, { a as b } from 'm'") == [("d", "m::d"), ("b", "m::a")]
    assert extract.imports("from x.y import z as w") == [("w", "x::y::z")]


def test_resolution(spark):
    src = "use crate::util::delta;\nfn helper() { }\nfn main() { helper(); delta(); other(); }\n"
    found = extract.extract(spark.createDataFrame([("m.rs", "rust", src), ("n.rs", "rust", None)], "path string, lang string, text string"))
    got = {r.target: r.tier for r in extract.resolve_calls(extract.nodes_of(found), extract.edges_of(found)).where("kind = 'Calls'").collect()}
    assert got == {"m::helper": "resolved", "crate::util::delta": "resolved", "other": "inferred"}


def test_file_sources(spark, tmp_path):
    for name, text in {"a.rs": b"fn a(){}", "node_modules/b.js": b"x", ".git/c.py": b"x", "d/e.py": b"\xff\xfe", "notes.md": b"# hi", "skip.md": b"no", "f.bin": b"x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text)
    assert {(r.path, r.lang, r.text, r.skipped) for r in files.code_files(spark, str(tmp_path)).collect()} == {("a.rs", "rust", "fn a(){}", False), ("d/e.py", "python", None, True)}
    assert [r.path for r in files.prose_files(spark, str(tmp_path), ("skip.md",)).collect()] == ["notes.md"]
    assert [r.text for r in files.memory_files(spark, [str(tmp_path), str(tmp_path)], ("notes.md",), "d").where("path = 'notes.md'").collect()] == ["# hi"]


def test_events_and_config(spark, tmp_path):
    df = spark.createDataFrame([('{"sessionId": "s", "tool": "Read", "original_tokens": 5}',), ("nope",), (None,), ("[1]",)], "value string")
    got = files.json_events(df).collect()
    assert (got[0].session_id, got[0].tool_name, got[0].original_tokens, got[0].status) == ("s", "Read", 5, "ok") and [r.malformed for r in got] == [False, True, True, True]
    assert files.layered_config({"a": {"x": 1, "y": 2}, "b": {}}, "[a]\nx = 3") == {"a": {"x": 3}, "b": {}}
    assert files.parse_jsonc('{"a": "//x", /* c */ "b": [1, 2,], // d\n}') == {"a": "//x", "b": [1, 2]}
    (tmp_path / "base.json").write_text('{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "@/lib/*": ["lib/*"]}}}')
    (tmp_path / "tsconfig.json").write_text('{"extends": "./base"}')
    config = files.compiler_config(str(tmp_path / "tsconfig.json"))
    assert files.resolve_alias("@/lib/x", config) == [f"{tmp_path}/lib/x", f"{tmp_path}/src/lib/x"]
    assert files.normal_path("/a/./b/../../../c") == "/c"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "user", 5, False, "one"), (2, "user", 9, False, "two"), (3, "other", 1, False, "x"), (4, "user", 9, True, "z")], "id long, kind string, importance int, archived boolean, title string")
    target = tmp_path / "out" / "m.md"
    assert sinks.export_markdown(df, ("user",), str(target), "t1") == "written" and sinks.export_markdown(df, ("user",), str(target), "t2") == "unchanged"
    assert "## user\n\n- [9] two\n- [5] one" in target.read_text()
    target.write_text("mine")
    assert sinks.export_markdown(df, ("user",), str(target), "t3") == "refused"
    assert json.loads(sinks.ndjson(df.orderBy("id")).first().value)["title"] == "one"
