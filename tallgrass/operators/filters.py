"""Filters of command output and permission rules, as column expressions (STR-9/10/33, FLT-12/13/15).

A filter is a record of stages. All filters of a table become one ``when`` chain over the array of lines, so a row is
split once, only its own filter's branch runs, and nothing leaves the JVM.
"""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.functions import text as T

MAX_BYTES = 1 << 20


@dataclass(frozen=True)
class Filter:
    name: str
    command: str
    replace: tuple[tuple[str, str], ...] = ()
    match: tuple[tuple[str, str], ...] = ()
    strip: tuple[str, ...] = ()
    width: int | None = None
    head: int = 0
    tail: int = 0
    most: int | None = None
    on_empty: str | None = None
    ansi: bool = True


# The built-in filters in their order (first match of the command wins).
_HOME = ("/home/[^/\\s]+(/[^\\s]*)", "~$1")
_BORDER = "^\\s*[─━═╌┄┈┌┐└┘├┤┬┴┼╔╗╚╝╠╣╦╩╬│║┃ ]+\\s*$"
_FIELD = ("^(\\s*[A-Za-z][\\w .-]*?):\\s{2,}", "$1: ")
BUILTIN: tuple[Filter, ...] = (
    Filter("git-branch", "^git\\s+branch(\\s|$)", width=120, most=100),
    Filter("git-diff-stat", "^git\\s+diff\\s+(--stat|--shortstat)\\b", most=80),
    Filter("git-log-oneline", "^git\\s+log\\s+--oneline\\b", head=30, tail=5, most=60),
    Filter("git-log-verbose", "^git\\s+log(\\s|$)", head=80, tail=5, most=120),
    Filter(
        "git-status", "^git\\s+status(\\s|$)", width=200, most=80,
        replace=(("^On branch (\\S+).*$", "branch: $1"), ("^Changes not staged for commit:.*$", "unstaged:"), ("^Changes to be committed:.*$", "staged:"), ("^Untracked files:.*$", "untracked:"), ("^\\s+(modified|new file|deleted|renamed):\\s+", "  $1: ")),
        match=(("nothing to commit, working tree clean", "git status: clean"),), strip=("^$", "^Your branch ", "^\\s+\\(use "),
    ),
    Filter("cargo-build", "^cargo\\s+(build|check|run)(\\s|$)", most=80, on_empty="cargo: ok", strip=("^\\s*Compiling\\s", "^\\s*Finished\\s", "^\\s*Updating\\s", "^\\s*Downloaded\\s", "^\\s*Downloading\\s", "^\\s*Building\\s", "^\\s*Fresh\\s", "^\\s*Documenting\\s", "^$")),
    Filter("cargo-clippy", "^cargo\\s+clippy(\\s|$)", head=60, tail=20, most=100, strip=("^\\s*Checking\\s", "^\\s*Finished\\s")),
    Filter("cargo-test", "^cargo\\s+(test|nextest)(\\s|$)", head=30, tail=30, most=80, strip=("^\\s*Compiling\\s", "^\\s*Finished\\s", "^\\s*Running\\s+unittests\\s", "^\\s*Running\\s+tests/", "^\\s*Doc-tests\\s", "^running\\s+0\\s+tests")),
    Filter(
        "npm-install", "^(npm|pnpm|yarn)\\s+(install|i|ci|add)(\\s|$)", head=10, tail=5, most=30, match=(("^up to date,? \\d+ packages? in \\d", "npm: up to date"),),
        strip=("^npm warn", "^npm notice", "^npm timing", "^\\s*[⠋⠙⠹⠸⠼⠴⠦⠧⠇⠏]", "^Resolving:", "^Downloading:", "^Building fresh packages", "^[➕]\\s", "^Already up to date"),
    ),
    Filter("npm-run", "^(npm|pnpm|yarn)\\s+(run|test|start|build|dev)(\\s|$)", head=30, tail=30, most=80),
    Filter("jest", "^(npx\\s+)?(jest|vitest)(\\s|$)", most=100, strip=("^PASS\\s", "^\\s+✓\\s", "^\\s*\\([0-9]+ ms\\)$")),
    Filter(
        "openclaw-logs", "^openclaw\\s+logs(\\s|$)", width=240, tail=80, most=120, on_empty="openclaw logs: empty", strip=("\\b(?:DEBUG|TRACE)\\b", "^$"),
        replace=(("^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}(?:\\.\\d+)?(?:Z|[+-]\\d{2}:?\\d{2})?\\s+", ""), ("\\bINFO\\b", "INF"), ("\\bWARN(?:ING)?\\b", "WRN"), ("\\bERROR\\b", "ERR"), _HOME),
    ),
    Filter("openclaw-mcp-list", "^openclaw\\s+mcp\\s+list(\\s|$)", width=120, head=12, tail=4, most=25, strip=(_BORDER, "^$"), match=(("(?i)\\bno\\s+(?:mcp\\s+)?servers?\\s+(?:configured|registered)\\b", "openclaw mcp: empty"),), replace=(_HOME,)),
    Filter("openclaw-mcp-show", "^openclaw\\s+mcp\\s+show\\b", width=200, head=30, tail=10, most=50, strip=(_BORDER, "^$", "^\\s*#\\s+[A-Z][A-Za-z ]+\\s*#\\s*$"), replace=(_HOME, _FIELD)),
    Filter(
        "openclaw-status", "^openclaw\\s+status(\\s|$)", width=120, head=18, tail=6, most=30, strip=(_BORDER, "^$", "^\\s+\\(use ", "^\\s+ℹ️?\\s", "^\\s*[#*=]{6,}\\s*$"),
        match=(("(?i)\\bno\\s+issues?\\s+(?:found|detected)\\b", "openclaw status: ok"), ("(?i)\\ball\\s+(?:agents|servers|hooks)\\s+healthy\\b", "openclaw status: ok")),
        replace=(_HOME, ("^\\s*✅\\s*", "ok: "), ("^\\s*❌\\s*", "err: "), ("^\\s*⚠️?\\s*", "warn: "), _FIELD),
    ),
    Filter("generic", ".*", width=500, most=200),
)


def from_toml(source: str) -> tuple[Filter, ...]:
    """Filters of one TOML text, by name (SRC-8)."""
    found = []
    for name, spec in sorted(tomllib.loads(source).get("filters", {}).items()):
        pairs = lambda key, value: tuple((("(?m)" if key == "replace" and r.get("multiline") and not r["pattern"].startswith("(?") else "") + r["pattern"], r[value]) for r in spec.get(key, ()))  # noqa: B023, E731
        found.append(Filter(name, spec.get("match_command", "(?!)"), pairs("replace", "replacement"), pairs("match_output", "message"), tuple(spec.get("strip_lines_matching", ())), spec.get("truncate_lines_at"), spec.get("head_lines") or 0, spec.get("tail_lines") or 0, spec.get("max_lines"), spec.get("on_empty"), spec.get("strip_ansi", False)))
    return tuple(found)


def load(*paths: str) -> tuple[Filter, ...]:
    """Filters of TOML files and of folders of them, in order; folders by file name."""
    files = [f for p in map(Path, paths) for f in (sorted(p.glob("*.toml")) if p.is_dir() else [p])]
    return tuple(f for file in files for f in from_toml(file.read_text("utf-8")))


def _java(pattern: str, lines: bool = False) -> str:
    """Unicode classes, and only a line feed ends a line."""
    return ("(?dUm)" if lines else "(?dU)") + pattern


def which(command, filters: tuple[Filter, ...] = BUILTIN) -> Column:
    """FLT-12: the name of the first filter whose pattern the command has; null if none."""
    return F.coalesce(*[F.when(command.rlike(_java(f.command)), F.lit(f.name)) for f in filters]) if filters else F.lit(None).cast("string")


def stages(text, f: Filter) -> Column:
    """STR-9: the stages of one filter on a text, as ``struct<text, kind>``."""
    lines = T.lines(T.strip_ansi(text) if f.ansi else text)
    if f.replace:
        lines = F.transform(lines, lambda x: reduce(lambda c, r: F.regexp_replace(c, _java(r[0]), r[1]), f.replace, x))
    whole, found = F.array_join(lines, "\n"), lines
    if f.strip:
        found = F.filter(found, lambda x: ~x.rlike(_java("|".join(f"(?:{p})" for p in f.strip))))
    if f.width is not None:
        found = F.transform(found, lambda x: F.when(F.char_length(x) > f.width, F.concat(F.substring(x, 1, max(0, f.width - 1)), F.lit("…"))).otherwise(x))
    if f.head or f.tail:
        last = F.slice(found, F.size(found) - f.tail + 1, f.tail) if f.tail else F.array().cast("array<string>")
        found = F.when(F.size(found) <= f.head + f.tail, found).otherwise(F.concat(F.slice(found, 1, f.head), F.array(F.lit("…")), last))
    if f.most is not None:
        found = F.when(F.size(found) <= f.most, found).otherwise(F.concat(F.slice(found, 1, f.most), F.array(F.format_string("… [+%d lines truncated]", F.size(found) - f.most))))
    kept = T.trim_blank(F.array_join(found, "\n"))
    blank = kept.rlike(_java("^\\s*$"))
    empty = F.struct(F.lit(f.on_empty if f.on_empty is not None else "").alias("text"), F.lit("filtered" if f.on_empty is None else "on_empty").alias("kind"))
    out = F.when(blank, empty).otherwise(F.struct(kept.alias("text"), F.lit("filtered").alias("kind")))
    for pattern, message in reversed(f.match):
        out = F.when(whole.rlike(pattern if pattern.startswith("(?") else _java(pattern, True)), F.struct(F.lit(message).alias("text"), F.lit("matched").alias("kind"))).otherwise(out)
    return out


def run(outputs: DataFrame, filters: tuple[Filter, ...] = BUILTIN) -> DataFrame:
    """``outputs`` (command, text) with ``filter``, ``filtered``, ``kind`` and the token estimates before and after
    (STR-33). Rows whose command or text exceeds 1 MiB are dropped, as oversize input is rejected (FLT-15). Null texts
    count as empty; without a filter the text passes through."""
    fits = (F.octet_length(F.coalesce("command", F.lit(""))) <= MAX_BYTES) & (F.octet_length(F.coalesce("text", F.lit(""))) <= MAX_BYTES)
    named = outputs.where(fits).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("filter", which(F.col("command"), filters))
    done = F.struct(F.col("text").alias("text"), F.lit("passthrough").alias("kind"))
    for f in reversed(filters):
        done = F.when(F.col("filter") == f.name, stages(F.col("text"), f)).otherwise(done)
    return named.withColumn("__done", done).withColumn("filtered", F.col("__done.text")).withColumn("kind", F.col("__done.kind")).drop("__done").withColumn("tokens_before", T.token_estimate(F.col("text"))).withColumn("tokens_after", T.token_estimate(F.col("filtered")))


# The tool names that stand for a runtime; ``*`` stands for all.
RUNTIMES = {"bash": ("bash", "exec", "shell", "sh"), "python": ("python", "py", "python3"), "node": ("node", "js", "javascript", "deno")}


def parse_rule(spec: str) -> tuple[str, str, str] | None:
    """``Tool(pattern)`` or ``Tool`` as (tool, needle, raw); null for blank rules and for patterns without a tool."""
    raw = spec.strip()
    m = re.fullmatch(r"([^(]*)\((.*)\)[^)]*", raw, re.S)
    tool, pattern = (m[1].strip(), m[2].strip()) if m else (raw, "")
    return (tool, pattern.lstrip("*").rstrip("*").rstrip(":").lstrip(":").strip(), raw) if tool else None


def permission(runtime, code, allow: list[str], deny: list[str]) -> Column:
    """FLT-13: ``struct<decision, rule>``. An allowing rule wins; then the first denying one; else allowed. A rule
    without a needle fits all code."""

    def hit(rule: tuple[str, str, str]) -> Column:
        fits = F.lit(True) if rule[0] == "*" else runtime.isin([k for k, names in RUNTIMES.items() if rule[0].lower() in names])
        return fits & F.contains(code, F.lit(rule[1])) if rule[1] else fits

    allowed = [r for r in map(parse_rule, allow) if r]
    out = F.struct(F.lit("allow").alias("decision"), F.lit(None).cast("string").alias("rule"))
    for rule in reversed([r for r in map(parse_rule, deny) if r]):
        out = F.when(hit(rule), F.struct(F.lit("deny").alias("decision"), F.lit(rule[2]).alias("rule"))).otherwise(out)
    if allowed:
        out = F.when(reduce(lambda a, b: a | b, map(hit, allowed)), F.struct(F.lit("allow").alias("decision"), F.lit(None).cast("string").alias("rule"))).otherwise(out)
    return out
