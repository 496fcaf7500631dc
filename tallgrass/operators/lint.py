"""Source hygiene: line kinds per language, rules, fixes and stripping (STR-19..24, 34, FLT-9/10, WIN-7, AGG-10, SNK-7).

Line kinds come from one scan of the file with a token pattern (strings and comments), by file as an Arrow-batched
function; rules are then predicates over a table of lines, and runs of module documentation are gaps and islands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions import text as T
from tallgrass.functions.arrow import runs

# Languages by file extension.
LANGUAGES = {"rs": "rust", "ts": "js", "tsx": "js", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "toml": "hash", "yaml": "hash", "yml": "hash", "md": "markdown", "markdown": "markdown", "py": "python"}
# Kinds of comment lines, marks of comments to keep, marks of generated files, folders never linted.
COMMENTS = ("line", "block", "doc", "module_doc")
SAFETY = ("safety:", "unsafe:", "security:", "warning:", "todo:", "fixme:", "xxx:", "hack:", "note:")
CRITICAL = ("safety:", "security:", "warning:", "invariant:", "todo:", "fixme:")

_C_TOKENS = {
    "rust": re.compile(r'//[^\n]*|/\*|b?r(#*)"(?:(?!"\1).|\n)*(?:"\1|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|\'(?:\\[^\n]|[^\\\'\n])\'', re.S),
    "js": re.compile(r"//[^\n]*|/\*|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*(?:`|\Z)", re.S),
}
_NESTED = re.compile(r"/\*|\*/")


def _block_end(src: str, at: int, nested: bool) -> int:
    """Where the block comment that opens at ``at`` ends; the end of the text if it stays open."""
    if not nested:
        end = src.find("*/", at + 2)
        return len(src) if end < 0 else end + 2
    depth = 0
    for m in _NESTED.finditer(src, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(src)


def _spans(src: str, lang: str) -> Iterator[tuple[int, int, bool]]:
    """Strings and block comments that may cross lines: (start, end, is a comment)."""
    at = 0
    while m := _C_TOKENS[lang].search(src, at):
        at = m.end()
        if m[0] == "/*":
            at = _block_end(src, m.start(), lang == "rust")
            yield m.start(), at, True
        elif "\n" in m[0]:
            yield m.start(), at, False


def _bare(raw: str) -> str:
    """A line of a block comment without its decoration."""
    return raw.lstrip().lstrip("*").lstrip(" \t").removesuffix("*/").rstrip()


def _c_lines(src: str, lang: str) -> list[tuple[str, str]]:
    spans, out, at, k = list(_spans(src, lang)), [], 0, 0
    for raw in src.split("\n"):
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        inside = k < len(spans) and spans[k][0] < at
        body = raw.lstrip(" \t")
        if inside and spans[k][2]:
            out.append(("block", _bare(raw)))
        elif inside:
            out.append(("code" if raw else "blank", ""))
        elif not body:
            out.append(("blank", ""))
        elif body.startswith("//"):
            kind = {"//!": "module_doc", "///": "doc"}.get(body[:3], "line") if lang == "rust" else "line"
            out.append((kind, body[3 if kind != "line" else 2 :].lstrip()))
        elif body.startswith("/*"):
            out.append(("block", body[2:].split("*/")[0].strip()))
        else:
            out.append(("code", ""))
        at += len(raw) + 1
    return out


def _hash_lines(src: str, lang: str) -> list[tuple[str, str]]:
    bodies = [raw.lstrip() for raw in src.split("\n")]
    return [("blank", "") if not b else ("line", b[1:].lstrip()) if b[0] == "#" else ("code", "") for b in bodies]


def _markdown_lines(src: str, lang: str) -> list[tuple[str, str]]:
    out, fenced = [], False
    for body in (raw.lstrip() for raw in src.split("\n")):
        mark = body.startswith(("```", "~~~"))
        out.append(("markdown_code", "") if mark or fenced else ("prose", body) if body else ("blank", ""))
        fenced ^= mark
    return out


def _python_lines(src: str, lang: str) -> list[tuple[str, str]]:
    """A triple-quoted string that starts a line counts as module documentation, to its end."""
    out, quote = [], ""
    for raw in src.split("\n"):
        body = raw.lstrip()
        if quote:
            out.append(("module_doc", body.removesuffix(quote)))
            quote = "" if quote in raw else quote
        elif body[:3] in ('"""', "'''"):
            quote, rest = body[:3], body[3:]
            out.append(("module_doc", rest.removesuffix(quote).strip()))
            quote = "" if quote in rest else quote
        else:
            out.append(_hash_lines(raw, lang)[0])
    return out


_KINDS = {"rust": _c_lines, "js": _c_lines, "hash": _hash_lines, "markdown": _markdown_lines, "python": _python_lines}


def line_kinds(src: str, lang: str) -> list[tuple[str, str]]:
    """(kind, body) of every line; carriage returns before a break do not count. Unknown languages have no lines."""
    return _KINDS[lang](src.replace("\r\n", "\n"), lang) if lang in _KINDS else []


def language(path) -> Column:
    """The language of a file by its extension; null if it is not linted."""
    ext = F.lower(F.regexp_extract(path, "\\.([A-Za-z]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p]), F.when(ext != "", ext))


def _lines_of(batches: Iterator[pa.RecordBatch], wanted: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for run in runs(batches, "text"):
        files, numbers, kinds, bodies, raws = [], [], [], [], []
        for i, (lang, src) in enumerate(zip(run.column("lang").to_pylist(), run.column("text").to_pylist(), strict=True)):
            src = src or ""
            found = line_kinds(src, lang)
            files += [i] * len(found)
            numbers += range(1, len(found) + 1)
            kinds += [k for k, _ in found]
            if "body" in wanted:
                bodies += [b for _, b in found]
            if "raw" in wanted and found:
                raws += src.replace("\r\n", "\n").split("\n")[: len(found)]
        at = pa.array(files, pa.int64())
        columns = {"path": lambda: run.column("path").take(at), "lang": lambda: run.column("lang").take(at), "line": lambda: pa.array(numbers, pa.int64()), "kind": lambda: pa.array(kinds, pa.string()), "body": lambda: pa.array(bodies, pa.string()), "raw": lambda: pa.array(raws, pa.string())}
        yield pa.RecordBatch.from_arrays([columns[c]() for c in wanted], list(wanted))


_LINES = {"path": "string", "lang": "string", "line": "long", "kind": "string", "body": "string", "raw": "string"}


def classify(files: DataFrame, *wanted: str) -> DataFrame:
    """``files`` (path, text[, lang]) as one row per line: ``path, lang, line, kind, body, raw``, or the ``wanted`` ones of
    these, since Spark leaves out no column of what Python makes."""
    wanted = wanted or tuple(_LINES)
    lang = F.col("lang") if "lang" in files.columns else language(F.col("path"))
    return files.select("path", lang.alias("lang"), "text").where(F.col("lang").isNotNull()).mapInArrow(lambda batches: _lines_of(batches, wanted), ", ".join(f"{c} {_LINES[c]}" for c in wanted))


def _starts(body, marks: tuple[str, ...]) -> Column:
    return T.ascii_lower(body).rlike("^\\s*(?:" + "|".join(marks) + ")")


def violations(lines: DataFrame, banner_run: int = 10, most_doc_lines: int = 5) -> DataFrame:
    """``path, line, rule_id, severity, snippet``: the first rule that a line breaks, and overlong module documentation."""
    comment, body = F.col("kind").isin(*COMMENTS), F.col("body")
    rule = (
        F.when(comment & T.is_banner(body, banner_run), "decorative_banner").when(T.is_goal_header(body), "goal_section").when(T.is_surface_header(body), "public_surface_section")
        .when(T.has_adapted_mark(body), "pattern_adapted_from").when(comment & T.has_layer_label(body), "layer_label").when(T.marketing_phrase(body).isNotNull(), "marketing_phrase")
    )
    checked = lines.where((comment | (F.col("kind") == "prose")) & ~_starts(body, SAFETY)).withColumn("rule_id", rule).where(F.col("rule_id").isNotNull())
    order = Window.partitionBy("path").orderBy("line")
    docs = lines.where((F.col("kind") == "module_doc") & (F.col("lang") == "rust")).withColumn("run", F.col("line") - F.row_number().over(order))
    runs = docs.groupBy("path", "run").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("n"), F.min_by("raw", "line").alias("raw")).where(F.col("n") > most_doc_lines).withColumn("rule_id", F.lit("long_module_doc"))
    severe = F.when(F.col("rule_id").isin("decorative_banner", "goal_section", "public_surface_section", "long_module_doc"), "error").otherwise("warn")
    cols = ["path", "line", "rule_id", "raw"]
    return checked.select(cols).unionByName(runs.select(cols)).select("path", "line", "rule_id", severe.alias("severity"), F.rtrim("raw").alias("snippet"))


def report(lines: DataFrame, found: DataFrame) -> DataFrame:
    """AGG-10: files scanned, files with violations and violations by severity, in one row."""
    scanned = lines.agg(F.count_distinct("path").alias("files_scanned"))
    broken = found.agg(F.count_distinct("path").alias("files_with_violations"), F.count(F.lit(1)).alias("violations"), F.count_if(F.col("severity") == "error").alias("errors"))
    return scanned.join(F.broadcast(broken))  # one row each


_PY_BANNER = re.compile(r"\s*([" + re.escape(T.BANNER_CHARS) + r"])(?:[ \t]*\1)*\s*")
_HEADER = re.compile(r"[# \t]*(?:goals?\s*$|goals?:|public surface|public api:)", re.I)
_BULLET = re.compile(r"\s*(?:[-*+\[]|[123]\.|$)")


def _runs(kinds: list[str], wanted: tuple[str, ...]) -> Iterator[tuple[str, range]]:
    at = 0
    for kind, group in groupby(kinds):
        n = len(list(group))
        if kind in wanted:
            yield kind, range(at, at + n)
        at += n


def fix(src: str, lang: str, banner_run: int = 10, most_doc_lines: int = 5) -> tuple[str, int]:
    """STR-23: without banners and goal or surface sections; long module documentation keeps its first filled line."""
    found = line_kinds(src, lang) if lang != "markdown" else []
    gone: set[int] = set()
    for i, (kind, body) in enumerate(found):
        if kind not in COMMENTS or body.lstrip().lower().startswith(SAFETY):
            continue
        if _PY_BANNER.fullmatch(body) and len(body.strip()) >= banner_run:
            gone.add(i)
        elif _HEADER.match(body):
            gone.add(i)
            for j in range(i + 1, len(found)):
                if found[j][0] != kind or not _BULLET.match(found[j][1]):
                    break
                gone.add(j)
    if lang == "rust":
        for _, run in _runs([k for k, _ in found], ("module_doc",)):
            left = [i for i in run if i not in gone]
            if len(left) > most_doc_lines:
                gone |= set(left) - {next((i for i in left if found[i][1].strip()), left[0])}
    if not gone:
        return src, 0
    text = src.replace("\r\n", "\n")
    out = "\n".join(raw for i, raw in enumerate(text.split("\n")) if i not in gone)
    ends = len(text) - len(text.rstrip("\n"))
    return out + "\n" * max(0, ends - (len(out) - len(out.rstrip("\n")))), len(gone)


def strip(src: str, lang: str) -> tuple[str, int]:
    """STR-24: without comments, but for critical ones and documentation runs with a code fence; blank runs become one."""
    found = line_kinds(src, lang) if lang in ("rust", "js") else []
    fenced = {i for _, run in _runs([k for k, _ in found], ("doc", "module_doc")) if any(found[i][1].lstrip().startswith(("```", "~~~")) for i in run) for i in run}
    gone = {i for i, (kind, body) in enumerate(found) if kind in COMMENTS and i not in fenced and not body.lstrip().lower().startswith(CRITICAL)}
    if not gone:
        return src, 0
    raws = src.replace("\r\n", "\n").split("\n")
    kept: list[str] = []
    for raw in (r for i, r in enumerate(raws) if i not in gone):
        if raw.strip() or (kept and kept[-1].strip()):  # no blank line at the start or after another
            kept.append(raw)
    out = "\n".join(kept)
    return out + ("\n" if src.endswith("\n") and not out.endswith("\n") else ""), len(raws) - len(kept)


def rewrite(files: DataFrame, mode: str = "fix") -> DataFrame:
    """``path, new_text, lines_removed`` of the files that ``mode`` (fix or strip) changes (SNK-7); writing is up to the
    caller."""
    act = {"fix": fix, "strip": strip}[mode]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [act(t or "", g) for t, g in zip(batch["text"], batch["lang"], strict=True)]
            yield pd.DataFrame({"path": batch["path"], "new_text": [t for t, _ in done], "lines_removed": pd.Series([n for _, n in done], dtype="int64")})

    lang = F.col("lang") if "lang" in files.columns else language(F.col("path"))
    return files.select("path", "text", lang.alias("lang")).where(F.col("lang").isNotNull()).mapInPandas(of, "path string, new_text string, lines_removed long").where("lines_removed > 0")
