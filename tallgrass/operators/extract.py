"""Symbols and calls from source files, and their resolution (GRF-1, 2, 5, 13, JN-15, STR-25/26).

One Arrow-batched function per file finds definitions, calls and imports; resolution is a set of joins. Python goes
through the standard parser. Brace languages, Lua and Bash go through one scheme: strings and comments are blanked out,
definitions are matched by pattern, their ends by counting brackets, and each call belongs to the innermost definition
around it. A file that does not parse gives its file node only.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions.arrow import runs
from tallgrass.operators.lint import _C_TOKENS, _block_end

NODE = "kind string, name string, qn string, file string, line long, line_end long, parent string, signature string, is_test boolean"
EDGE = "kind string, source string, target string, file string, line long, confidence double, tier string"
_ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
_NODE, _EDGE = (pa.struct([(c.split()[0], _ARROW[c.split()[1]]) for c in x.split(", ")]) for x in (NODE, EDGE))


def module_name(path: str, lang: str) -> str:
    """The path without extension, with the language's separator."""
    stem = path[: path.rfind(".")] if "." in path else path
    return stem.replace("/", {"rust": "::", "python": "::", "lua": "."}.get(lang, "/"))


@dataclass
class Definition:
    kind: str
    name: str
    start: int
    body: int
    end: int


_WORDY = r"[A-Za-z_$][\w$]*"
_DEFINE = {
    "rust": [("impl", re.compile(rf"\bimpl\b(?:\s*<[^{{;]*?>)?\s+(?:[\w:<>,&' ]+?\s+for\s+)?(?:[\w]+::)*({_WORDY})[^{{;]*\{{")), ("fn", re.compile(rf"\bfn\s+({_WORDY})")), ("Class", re.compile(rf"\b(?:struct|enum|type)\s+({_WORDY})")), ("Type", re.compile(rf"\btrait\s+({_WORDY})")), ("Module", re.compile(rf"\bmod\s+({_WORDY})(?=\s*\{{)"))],
    "js": [("Class", re.compile(rf"\bclass\s+({_WORDY})[^{{]*(?=\{{)")), ("fn", re.compile(rf"\bfunction\s*\*?\s*({_WORDY})\s*(?=[(<])")), ("Constant", re.compile(rf"\b(?:const|let|var)\s+({_WORDY})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*\)|{_WORDY})\s*(?::[^=\n]+)?=>")), ("Method", re.compile(rf"(?m)(?:^|(?<=[{{}};]))[ \t]*(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*\*?({_WORDY})\s*\([^;{{}}]*\)\s*(?::[^{{;\n]+)?(?=\{{)"))],
    "lua": [("fn", re.compile(rf"\bfunction\s+({_WORDY}(?:[.:]{_WORDY})*)"))],
    "bash": [("fn", re.compile(r"(?m)^[ \t]*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\)\s*(?=\{)|^[ \t]*function\s+([A-Za-z_][\w-]*)\s*(?=\{)"))],
}
_KEYWORDS = frozenset("if for while switch catch return match loop fn function else elseif end do then and or not in of let const var new typeof await async super class struct enum impl pub use mod where move unsafe as yield delete void throw with local repeat until case import export".split())
_CALL = {"rust": re.compile(rf"(?<![\w.!]){_WORDY}(?:(?:::|\.){_WORDY})*(?=\s*(?:::<[^()]*>)?\()"), "js": re.compile(rf"(?<![\w.]){_WORDY}(?:\??\.{_WORDY})*(?=\s*\()"), "lua": re.compile(rf"(?<![\w.:]){_WORDY}(?:[.:]{_WORDY})*(?=\s*\()"), "bash": re.compile(r"(?m)(?:^|[;|&])[ \t]*([A-Za-z_][\w-]*)(?=[ \t]|$|;)")}
_IMPORT = {"rust": re.compile(r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+[^;]+;"), "js": re.compile(r"(?m)^[ \t]*import\s[^;\n]*(?:\{[^}]*\}[^;\n]*)?;?"), "lua": re.compile(r"\brequire\s*\(?\s*[\"'][^\"']+[\"']\s*\)?"), "bash": re.compile(r"(?m)^[ \t]*(?:source|\.)[ \t]+\S+")}
_LUA_BLOCK = re.compile(r"\b(?:function|do|if|repeat|end|until)\b")
_PLAIN = {"lua": re.compile(r"--\[\[.*?(?:\]\]|\Z)|--[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S), "bash": re.compile(r"(?<!\S)#[^\n]*|\"(?:\\.|[^\"\\])*\"|'[^']*'", re.S)}


def masked(src: str, lang: str) -> str:
    """The text with strings and comments blanked out; offsets and line breaks stay."""
    out, at = [], 0
    pattern = _PLAIN.get(lang) or _C_TOKENS[lang]
    while m := pattern.search(src, at):
        end = _block_end(src, m.start(), lang == "rust") if m[0] == "/*" else m.end()
        out += [src[at : m.start()], re.sub(r"[^\n]", " ", src[m.start() : end])]
        at = max(end, m.start() + 1)
    return "".join(out) + src[at:]


def _brackets(code: str) -> dict[int, int]:
    """End of each brace pair by its start."""
    stack, ends = [], {}
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            ends[stack.pop()] = m.end()
    return ends | {start: len(code) for start in stack}


def _lua_end(code: str, at: int) -> int:
    depth = 0
    for m in _LUA_BLOCK.finditer(code, at):
        depth += -1 if m[0] in ("end", "until") else 1
        if not depth:
            return m.end()
    return len(code)


def definitions(code: str, lang: str) -> list[Definition]:
    """Definitions of blanked-out code by start; a pattern that names no definition (a keyword) is left out."""
    ends, out, taken = _brackets(code) if lang != "lua" else {}, [], set()
    opens = sorted(ends)
    for kind, pattern in _DEFINE[lang]:
        for m in pattern.finditer(code):
            name = m[1] or m[2] if pattern.groups > 1 else m[1]
            if name in _KEYWORDS or m.start(1) in taken:
                continue
            taken.add(m.start(1))
            if lang == "lua":
                body, end = m.end(), _lua_end(code, m.start())
            elif kind == "impl":
                body, end = m.end() - 1, ends.get(m.end() - 1, len(code))
            else:
                semi = code.find(";", m.end())
                k = bisect.bisect_left(opens, m.end())
                opened = opens[k] if k < len(opens) and (lang != "rust" or semi < 0 or opens[k] < semi or "[" in code[m.end() : semi]) else None
                body, end = (opened, ends[opened]) if opened is not None and (kind != "Constant" or code[m.end() : opened].isspace() or opened == m.end()) else (m.end(), (semi + 1 if semi >= 0 else len(code)))
            out.append(Definition(kind, name, m.start(), body, end))
    return sorted(out, key=lambda d: (d.start, -d.end))


def _scan(path: str, lang: str, src: str) -> tuple[list[tuple], list[tuple]]:
    code, module = masked(src, lang), module_name(path, lang)
    breaks = [m.start() for m in re.finditer("\n", src)]
    line = lambda at: bisect.bisect_left(breaks, at) + 1
    nodes, edges, scopes, bodies = [], [], [], []
    for d in definitions(code, lang):
        while scopes and scopes[-1][0].end <= d.start:
            scopes.pop()
        parent = next((qn for s, qn in reversed(scopes) if s.kind in ("impl", "Class", "Type", "Module")), None)
        inside = next((s for s, _ in reversed(scopes)), None)
        if lang == "js" and d.kind == "Method" and not (inside and inside.kind == "Class"):
            continue
        name = re.split("[.:]", d.name)[-1] if lang == "lua" else d.name
        qn = f"{parent or module}::{name}" if lang != "lua" else f"{module}::{d.name.replace(':', '.')}"
        scopes.append((d, qn))
        if d.kind == "impl":
            continue
        in_type = any(s.kind in ("impl", "Class", "Type") for s, _ in scopes[:-1])
        kind = d.kind if d.kind != "fn" else "Method" if (in_type and lang == "rust") or (lang == "lua" and re.search("[.:]", d.name)) else "Function"
        test = bool(re.search(r"#\[(?:\w+::)*test\b", src[max(0, d.start - 80) : d.start].rsplit("}", 1)[-1])) if lang == "rust" else lang in ("lua", "bash") and name.startswith("test")
        nodes.append((kind, name, qn, path, line(d.start), line(max(d.start, d.end - 1)), parent, src[d.start :].split("\n", 1)[0].split("{")[0].strip(), test))
        if kind in ("Function", "Method", "Constant"):
            bodies.append((d.body, d.end, qn))
    starts = {d.start for d in definitions(code, lang)}
    bodies.sort()
    open_: list[tuple[int, int, str]] = []
    k = 0
    for m in _CALL[lang].finditer(code):
        target, at = (m[1], m.start(1)) if _CALL[lang].groups else (m[0], m.start())
        while k < len(bodies) and bodies[k][0] <= at:
            open_.append(bodies[k])
            k += 1
        open_ = [b for b in open_ if b[1] > at]
        head = re.split(r"[.:?]", target)[0]
        if open_ and head not in _KEYWORDS and at not in starts and not re.search(r"\b(?:fn|function)\s+$", code[max(0, at - 12) : at]):
            edges.append(("Calls", open_[-1][2], target.replace("?.", "."), path, line(at), 0.5 if lang == "bash" else 0.6, "inferred"))
    for m in _IMPORT[lang].finditer(src):
        if lang in ("lua", "bash") or code[m.start() : m.start() + len(m[0]) - len(m[0].lstrip()) + 3].strip():
            edges.append(("ImportsFrom", f"{module}:file", m[0].strip(), path, line(m.start() + len(m[0]) - len(m[0].lstrip())), 0.7, "inferred"))
    if lang == "js":
        for m in re.finditer(rf"\bexport\s+default\s+(?:async\s+)?(?:(?:class|function)\b\s*\*?\s*)?({_WORDY})?", code):
            name = m[1] if m[1] and m[1] not in _KEYWORDS - {"default"} else "default"
            qn = next((n[2] for n in nodes if n[1] == name), None)
            if name == "default":
                qn = f"{module}::default"
                nodes.append(("Class" if "class" in m[0] else "Function", "default", qn, path, line(m.start()), line(m.start()), None, m[0].strip(), False))
            edges.append(("ExportsDefault", f"{module}:file", qn or name, path, line(m.start()), 1.0 if qn else 0.7, "resolved" if qn else "inferred"))
    return nodes, edges


def _python(path: str, src: str) -> tuple[list[tuple], list[tuple]]:
    module, nodes, edges = module_name(path, "python"), [], []
    lines = src.split("\n")

    def calls(body: list[ast.stmt], qn: str) -> None:
        for stmt in body:
            for n in ast.walk(stmt):
                if isinstance(n, ast.Call) and isinstance(n.func, ast.Name | ast.Attribute):
                    edges.append(("Calls", qn, n.func.id if isinstance(n.func, ast.Name) else ast.unparse(n.func), path, n.lineno, 0.6, "inferred"))

    def walk(body: list[ast.stmt], parent: str | None) -> None:
        for n in body:
            if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                qn = f"{parent or module}::{n.name}"
                is_class = isinstance(n, ast.ClassDef)
                kind = "Class" if is_class else "Method" if parent else "Function"
                nodes.append((kind, n.name, qn, path, n.lineno, n.end_lineno, parent, lines[n.lineno - 1].strip(), not is_class and n.name.startswith("test_")))
                if is_class:
                    walk(n.body, qn)
                else:
                    calls(n.body, qn)
            elif isinstance(n, ast.Import | ast.ImportFrom):
                edges.append(("ImportsFrom", f"{module}:file", ast.unparse(n), path, n.lineno, 0.7, "inferred"))
            else:
                for inner in ("body", "orelse", "finalbody"):
                    walk([x for x in getattr(n, inner, []) if isinstance(x, ast.stmt)], parent)

    walk(ast.parse(src).body, None)
    return nodes, edges


def parse(path: str, lang: str, src: str) -> tuple[list[tuple], list[tuple]]:
    """Rows of ``NODE`` and ``EDGE`` of one file; the first node is the file itself. Names that extend a module's own name
    are joined once."""
    lang = {"javascript": "js", "typescript": "js"}.get(lang, lang)
    whole = ("File", path.rsplit("/", 1)[-1], f"{module_name(path, lang)}:file", path, 1, src.count("\n") + 1, None, None, False)
    try:
        nodes, edges = _python(path, src) if lang == "python" else _scan(path, lang, src) if lang in _DEFINE else ([], [])
    except (SyntaxError, ValueError, RecursionError):  # the file does not parse
        nodes, edges = [], []
    return [whole, *nodes], edges


def _structs(rows: list[tuple], kind: pa.StructType) -> pa.StructArray:
    columns = zip(*rows, strict=True) if rows else ([] for _ in kind)
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in runs(batches, "text"):
        nodes, edges = [], []
        for path, lang, src in zip(*(run.column(c).to_pylist() for c in ("path", "lang", "text")), strict=True):
            own = parse(path, lang, src or "")
            nodes += own[0]
            edges += own[1]
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([_structs(nodes, _NODE), pa.nulls(len(edges), _NODE)]), pa.concat_arrays([pa.nulls(len(nodes), _EDGE), _structs(edges, _EDGE)])], ["node", "edge"])


def extract(files: DataFrame) -> DataFrame:
    """``files`` (path, lang, text) as one table with a row for each node (column ``node``) and each edge (``edge``); take
    ``nodes_of`` and ``edges_of``, or ``resolve`` it as it is."""
    return files.select("path", "lang", "text").where(F.col("path").isNotNull() & F.col("lang").isNotNull()).mapInArrow(_extracted, f"node struct<{NODE.replace(' ', ':').replace(',:', ', ')}>, edge struct<{EDGE.replace(' ', ':').replace(',:', ', ')}>")


def nodes_of(found: DataFrame) -> DataFrame:
    return found.where(F.col("node").isNotNull()).select("node.*")


def edges_of(found: DataFrame) -> DataFrame:
    return found.where(F.col("edge").isNotNull()).select("edge.*")


def leaf(c) -> Column:
    """The last segment of a qualified name (STR-26)."""
    return F.regexp_extract(c, "([^.:]*)$", 1)


def _rust_use(path: str, prefix: str = "") -> Iterator[tuple[str, str]]:
    """(local name, full path) of a use tree."""
    path = path.strip()
    head, brace, rest = path.partition("{")
    if brace:
        depth, start, inner = 0, 0, rest[: rest.rfind("}")] if "}" in rest else rest
        for i, c in enumerate(inner + ","):
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                if inner[start:i].strip():
                    yield from _rust_use(inner[start:i], prefix + head.strip())
                start = i + 1
    elif path and not path.endswith("*"):
        full, _, alias = path.partition(" as ")
        full = (prefix + full.strip()).removesuffix("::self")
        yield (alias.strip() or full.rsplit("::", 1)[-1]), full


def imports(statement: str) -> list[tuple[str, str]]:
    """(local name, full name) pairs of an import statement of Rust, Python or JavaScript (STR-25)."""
    text = " ".join(statement.split()).rstrip(";")
    if m := re.match(r"(?:pub(?:\([^)]*\))? )?use (.+)", text):
        return list(_rust_use(m[1]))
    if m := re.fullmatch(r"import (.+?) from ['\"](.+)['\"]", text):
        out = []
        for name in re.sub(r"\{([^}]*)\}", r"\1", m[1]).split(","):
            full, _, alias = name.strip().removeprefix("type ").partition(" as ")
            if full == "*":
                out.append((alias.strip(), m[2]))
            elif full:
                out.append(((alias or full).strip(), f"{m[2]}::{full.strip()}"))
        return out
    if m := re.fullmatch(r"from (\S+) import \(?(.+?)\)?", text):
        split = (x.strip().partition(" as ") for x in m[2].split(",") if x.strip() not in ("", "*"))
        return [((alias or name).strip(), f"{m[1].replace('.', '::')}::{name.strip()}") for name, _, alias in split]
    if m := re.fullmatch(r"import ([\w., ]+)", text):
        split = (x.strip().partition(" as ") for x in m[1].split(","))
        return [((alias or name.split(".")[0]).strip(), name.strip().replace(".", "::")) for name, _, alias in split]
    return []


def resolve(found: DataFrame) -> DataFrame:
    """GRF-5: the edges of ``found`` (as of ``extract``, read once) with calls rewritten within their file. A bare name
    becomes the only symbol of that name, else what the first import of that name says; ``head::member`` and ``head.member``
    have their head rewritten likewise. Resolved calls gain 0.2 confidence."""

    @F.pandas_udf("array<struct<leaf:string, full:string>>")
    def pairs(statement: pd.Series) -> pd.Series:
        return statement.map(lambda s: [{"leaf": a, "full": b} for a, b in imports(s)] if isinstance(s, str) else None)

    node, edge = F.col("node"), F.col("edge")
    is_node, is_edge = node.isNotNull() & (node["kind"] != "File"), edge.isNotNull()
    parts = F.split(edge["target"], "::|\\.")
    simple = (edge["kind"] == "Calls") & (F.size(parts) <= 2) & ~parts[0].isin("self", "Self", "super", "crate", "this")
    row = lambda *values: F.struct(*[v.alias(n) for v, n in zip(values, ("file", "head", "own", "brought", "edge"), strict=True)])
    no_name, no_import, no_edge = F.lit(None).cast("string"), F.lit(None).cast("struct<line:long, at:int, full:string>"), F.lit(None).cast(found.schema["edge"].dataType)
    itself = F.when(is_edge, F.array(row(edge["file"], F.when(simple, parts[0]), no_name, no_import, edge))).when(is_node, F.array(row(node["file"], node["name"], node["qn"], no_import, no_edge))).otherwise(F.array())
    names = lambda p, at: row(edge["file"], p["leaf"], no_name, F.struct(edge["line"].alias("line"), at.alias("at"), p["full"].alias("full")), no_edge)
    split = found.select("node", "edge", pairs(F.when(edge["kind"] == "ImportsFrom", edge["target"])).alias("pairs"))
    rows = split.select(F.inline(F.concat(itself, F.coalesce(F.transform("pairs", names), F.array()))))
    same = Window.partitionBy("file", "head")
    known = rows.withColumn("least", F.min("own").over(same)).withColumn("most", F.max("own").over(same)).withColumn("first", F.min("brought").over(same)).where(is_edge)
    to = F.when(F.col("file").isNotNull() & F.col("head").isNotNull(), F.coalesce(F.when(F.col("least") == F.col("most"), F.col("least")), F.col("first.full")))
    done = known.select("edge.*", to.alias("_to"), F.when(F.size(parts) == 2, F.regexp_extract(edge["target"], "((?:::|\\.).*)$", 1)).otherwise("").alias("_member"))
    known_to = F.col("_to").isNotNull()
    done = done.withColumn("target", F.when(known_to, F.concat("_to", "_member")).otherwise(F.col("target")))
    done = done.withColumn("confidence", F.when(known_to, F.round(F.least(F.lit(1.0), F.col("confidence") + 0.2), 6)).otherwise(F.col("confidence"))).withColumn("tier", F.when(known_to, "resolved").otherwise(F.col("tier")))
    return done.drop("_to", "_member")


def resolve_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``resolve`` of nodes and edges that are tables of their own."""
    null = lambda df: F.lit(None).cast(df.schema)
    rows = lambda df: F.struct(*[F.col(c) for c in df.columns])
    return resolve(nodes.select(rows(nodes).alias("node"), null(edges).alias("edge")).unionByName(edges.select(null(nodes).alias("node"), rows(edges).alias("edge"))))
