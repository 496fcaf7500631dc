"""Column functions for text: tokens, lines, estimates, filter stages, lint predicates. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(c, UPPER, LOWER)


def token_estimate(c) -> Column:
    """One token per four code points, rounded up; 0 for null or empty (SRCH-4)."""
    return F.coalesce(F.ceil(F.char_length(c) / 4), F.lit(0)).cast("long")


def lines(c) -> Column:
    """Lines without a trailing empty one; carriage returns before a break are dropped."""
    parts = F.split(F.regexp_replace(c, "\r\n", "\n"), "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def words_of(c, keep_underscore: bool = True, least: int = 1) -> Column:
    """Lower-cased words of letters and digits (and ``_``), in order, repeats kept (STR-32)."""
    parts = F.split(ascii_lower(c), "[^\\p{L}\\p{N}_]+" if keep_underscore else "[^\\p{L}\\p{N}]+")
    return F.filter(parts, lambda x: F.char_length(x) >= least)


def distinct_words(c, least: int = 1) -> Column:
    return F.array_distinct(words_of(c, True, least))


def jaccard(a, b) -> Column:
    """Share of common elements of two sets; 0 if both are empty (MTH-10)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def strip_ansi(c) -> Column:
    return F.regexp_replace(c, "\u001b(?:\\[[0-?]*[ -/]*[@-~]|\\][^\u0007\u001b]*(?:\u0007|\u001b\\\\)|[@-Z\\\\-_])", "")


def drop_lines(c, patterns: list[str]) -> Column:
    """Without the lines that match any pattern (STR-4)."""
    if not patterns:
        return c
    any_of = "|".join(f"(?:{p})" for p in patterns)
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~x.rlike(any_of)), "\n")


def truncate_lines(c, width: int) -> Column:
    """Longer lines end with an ellipsis at ``width`` characters (STR-5)."""
    return F.array_join(F.transform(F.split(c, "\n"), lambda x: F.when(F.char_length(x) > width, F.concat(F.substring(x, 1, width - 1), F.lit("…"))).otherwise(x)), "\n")


def head_tail(c, head: int, tail: int) -> Column:
    """First and last lines with an ellipsis line between, if there are more (STR-6)."""
    parts = F.split(c, "\n")
    return F.when(F.size(parts) <= head + tail, c).otherwise(F.array_join(F.concat(F.slice(parts, 1, head), F.array(F.lit("…")), F.slice(parts, F.size(parts) - tail + 1, tail) if tail else F.array()), "\n"))


def max_lines(c, most: int) -> Column:
    """At most so many lines, then a note of how many were cut (STR-7)."""
    parts = F.split(c, "\n")
    return F.when(F.size(parts) <= most, c).otherwise(F.concat(F.array_join(F.slice(parts, 1, most), "\n"), F.format_string("\n… [+%d lines truncated]", F.size(parts) - most)))


def trim_blank(c) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^(?:[ \\t]*\n)+", ""), "(?:\n[ \\t]*)+$", "")


#: Characters that make a decorative banner.
BANNER_CHARS = "─═-=*#~_·━┄┈╌╍┉⎯"
#: Phrases without technical content.
MARKETING_PHRASES = (
    "revolutionary", "cutting-edge", "cutting edge", "seamlessly", "seamless integration", "robust and scalable", "highly scalable", "state-of-the-art",
    "state of the art", "groundbreaking", "best-in-class", "best in class", "world-class", "world class", "next-generation", "next generation",
    "game-changing", "game changing", "synergistic", "paradigm shift", "paradigm-shifting",
)
#: Marks of borrowed patterns.
ADAPTED_NEEDLES = ("pattern adapted from", "adapted from pattern", "inspired by pattern")


def is_banner(c, run: int = 10) -> Column:
    """A run of one banner character, at least ``run`` characters long, with blanks allowed between (STR-20)."""
    t = F.regexp_replace(c, "^\\s+|\\s+$", "")
    first = F.substring(t, 1, 1)
    return F.coalesce((F.char_length(t) >= run) & F.instr(F.lit(BANNER_CHARS), first).cast("boolean") & (F.regexp_replace(F.replace(t, first, F.lit("")), "[ \\t]", "") == "") & (first != ""), F.lit(False))


def is_goal_header(c) -> Column:
    t = ascii_lower(F.regexp_replace(F.regexp_replace(c, "^[# \\t]+", ""), "^\\s+|\\s+$", ""))
    return t.rlike("^goals?:|^goals?$")


def is_surface_header(c) -> Column:
    t = ascii_lower(F.regexp_replace(F.regexp_replace(c, "^[# \\t]+", ""), "^\\s+|\\s+$", ""))
    return t.rlike("^public surface|^public api:")


def has_adapted_mark(c) -> Column:
    return ascii_lower(c).rlike("|".join(ADAPTED_NEEDLES))


def has_layer_label(c) -> Column:
    return ascii_lower(c).rlike("(?<![a-z0-9_])layer (?:[0-9]+|[xn])(?![a-z0-9_])")


def marketing_phrase(c) -> Column:
    """The first phrase (in listed order) that occurs; null if none."""
    low = ascii_lower(c)
    return F.coalesce(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in MARKETING_PHRASES])


def glob_regex(patterns: list[str]) -> str:
    """One anchored alternation for ignore globs: ``**`` any run, ``*`` within a segment, ``?`` one character (FLT-8)."""
    import re

    def one(p: str) -> str:
        out, i = "", 0
        while i < len(p):
            if p.startswith("**", i):
                out, i = out + ".*", i + 2
            else:
                out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(p[i], re.escape(p[i])), i + 1
        return out

    return "^(?:" + "|".join(one(p) for p in patterns[:200]) + ")$"


def ignored(path, patterns: list[str]) -> Column:
    """The full path or its last segment matches a glob."""
    if not patterns:
        return F.lit(False)
    regex = glob_regex(patterns)
    return path.rlike(regex) | F.substring_index(path, "/", -1).rlike(regex)
