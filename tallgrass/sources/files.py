"""Sources: code and prose files, memory files, JSON events, layered TOML configuration, commented JSON (SRC-1..3, 6, 7, 9..11)."""

from __future__ import annotations

import json
import re
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code languages by extension, prose extensions, size limits in bytes.
CODE = {"rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "lua": "lua", "sh": "bash", "bash": "bash"}
PROSE = ("md", "markdown", "txt", "rst", "mdx")
CODE_BYTES, PROSE_BYTES = 5 << 20, 2 << 20
# Folders that no walk enters.
EXCLUDED = (".git", "target", "node_modules", "dist", "build", ".next", "vendor", "_refs", "third_party", "third-party", "external", "submodules", "deps", ".venv", "venv", "env", "__pycache__", ".mypy_cache", ".pytest_cache", ".tox", ".cache", ".idea", ".vscode")


def _walk(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` with ``path`` relative to it. Contents are read only if a later column asks for them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://", 1)[-1].rstrip("/") + "/"
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:(?://[^/]*)?(?=/)", ""), "^" + re.escape(base), "")
    return found.withColumn("path", relative)


def _extension(path) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))


def _entered(path) -> Column:
    """No folder of the path is excluded or hidden."""
    folders = F.split(path, "/")
    return ~F.exists(F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0))), lambda x: x.isin(*EXCLUDED) | x.startswith("."))


def _utf8(content) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def code_files(spark: SparkSession, root: str, ignore: str | None = None) -> DataFrame:
    """SRC-1: ``path, lang, text, size_bytes, mtime_epoch, content_hash, skipped``. Files over 5 MiB or not in UTF-8 keep a row
    with ``skipped`` set and no text. ``ignore`` is a regular expression of paths to leave out."""
    lang = F.element_at(F.create_map(*[F.lit(x) for p in CODE.items() for x in p]), _extension(F.col("path")))
    found = _walk(spark, root).withColumn("lang", lang).where(F.col("lang").isNotNull() & _entered(F.col("path")))
    if ignore:
        found = found.where(~F.col("path").rlike(ignore))
    skipped = (F.col("length") > CODE_BYTES) | ~_utf8(F.col("content"))
    return found.select("path", "lang", F.when(~skipped, F.col("content").cast("string")).alias("text"), *_facts(), skipped.alias("skipped"))


def _facts() -> list[Column]:
    return [F.col("length").alias("size_bytes"), F.unix_timestamp("modificationTime").alias("mtime_epoch"), F.sha2("content", 256).alias("content_hash")]


def prose_files(spark: SparkSession, root: str, reserved: tuple[str, ...] = ()) -> DataFrame:
    """SRC-2: prose of at most 2 MiB outside hidden and excluded folders, but for files of a reserved name."""
    name = F.substring_index("path", "/", -1)
    found = _walk(spark, root).where(_extension(F.col("path")).isin(*PROSE) & _entered(F.col("path")) & (F.col("length") <= PROSE_BYTES))
    if reserved:
        found = found.where(~name.isin(*reserved))
    return found.where(_utf8(F.col("content"))).select("path", F.col("content").cast("string").alias("text"), *_facts())


def memory_files(spark: SparkSession, roots: list[str], names: tuple[str, ...], folder: str) -> DataFrame:
    """SRC-3: files of fixed names in each root, then those of its memory folder by name; a path counts once, first seen first."""
    parts = [_walk(spark, root).where(F.col("path").isin(*names) | F.col("path").startswith(f"{folder}/")).withColumn("place", F.lit(i)) for i, root in enumerate(roots)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    row = F.struct("place", F.col("content").cast("string").alias("text"), F.sha2("content", 256).alias("content_hash"))
    return found.groupBy("path").agg(F.min_by(row, "place").alias("r")).select("path", "r.text", "r.content_hash")


# Fields of tool events, with the names they may come under.
EVENT_FIELDS = {"session_id": ("session_id", "sessionId"), "tool_name": ("tool_name", "tool"), "target": ("target", "file_path"), "status": ("status",), "original_tokens": ("original_tokens",), "compressed_tokens": ("compressed_tokens",), "summary": ("summary",)}
EVENT_DEFAULTS = {"session_id": "default", "tool_name": "unknown", "status": "ok", "original_tokens": "0", "compressed_tokens": "0", "summary": ""}


def json_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """SRC-7: one event per JSON line; fields under their aliases, else defaults. Lines that are no JSON object have
    ``malformed`` set."""
    parsed = lines.withColumn("__j", F.try_parse_json(column))
    cols = []
    for name, aliases in EVENT_FIELDS.items():
        value = F.coalesce(*[F.try_variant_get("__j", f"$.{a}", "string") for a in aliases], *([F.lit(EVENT_DEFAULTS[name])] if name in EVENT_DEFAULTS else []))
        cols.append((value.try_cast("long") if name.endswith("tokens") else value).alias(name))
    return parsed.select(*cols, F.coalesce(~F.schema_of_variant("__j").startswith("OBJECT"), F.lit(True)).alias("malformed"))


def layered_config(defaults: dict, *sources: str) -> dict:
    """SRC-9: each later TOML text replaces whole sections of what came before."""
    found = dict(defaults)
    for source in sources:
        found |= tomllib.loads(source)
    return found


_JSONC = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?(?:\*/|\Z)|,(?=\s*(?:(?://[^\n]*\n|/\*.*?\*/)\s*)*[}\]])', re.S)


def parse_jsonc(source: str) -> dict:
    """JSON with comments and trailing commas."""
    return json.loads(_JSONC.sub(lambda m: m[1] or "", source))


def compiler_config(path: str, depth: int = 16) -> dict:
    """SRC-10: ``baseUrl`` and ``paths`` of a project file after its ``extends`` chain; own values win. Cycles and chains
    deeper than ``depth`` end the walk."""
    chain, seen, at = [], set(), Path(path)
    while at.is_file() and at.resolve() not in seen and len(chain) <= depth:
        seen.add(at.resolve())
        spec = parse_jsonc(at.read_text("utf-8"))
        options = spec.get("compilerOptions", {})
        chain.append({k: (str((at.parent / v).resolve()) if k == "baseUrl" else v) for k, v in options.items() if k in ("baseUrl", "paths")})
        up = spec.get("extends")
        if not isinstance(up, str):
            break
        at = at.parent / up
        at = at if at.suffix == ".json" else at.with_name(at.name + ".json")
    out: dict = {}
    for options in reversed(chain):
        out |= options
    return out


def resolve_alias(specifier: str, config: dict) -> list[str]:
    """STR-28: paths an import may name by the aliases of ``compiler_config``; the alias with the longest fixed part first."""
    base, out = config.get("baseUrl", ""), []
    for alias, targets in sorted(config.get("paths", {}).items(), key=lambda p: (-len(p[0].partition("*")[0]), "*" in p[0])):
        head, star, tail = alias.partition("*")
        fits = specifier.startswith(head) and specifier.endswith(tail) and len(specifier) >= len(head) + len(tail) if star else specifier == alias
        if fits:
            middle = specifier[len(head) : len(specifier) - len(tail)] if star else ""
            out += [normal_path(f"{base}/{t.replace('*', middle)}") for t in targets]
    return out


def normal_path(path: str) -> str:
    """Without ``.`` and ``..`` segments and doubled separators; an absolute path does not leave its root."""
    out: list[str] = []
    for part in path.split("/"):
        if part == ".." and out and out[-1] != "..":
            out.pop()
        elif part not in ("", ".") and not (part == ".." and path.startswith("/")):
            out.append(part)
    return ("/" if path.startswith("/") else "") + "/".join(out)
