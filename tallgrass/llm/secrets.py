"""Secret scan by a trigram inverted index.

Each rule's regex yields a Boolean query over trigrams (every match contains them): literal runs give AND, alternatives
give OR, and what has no bounded set of literals gives "anything". A shard (a slice of about 1 MB of texts in a task)
gets an inverted index of the rules' trigrams: postings from trigram to texts of the shard, over ASCII-lowercased
bytes. A rule's query intersects and unites postings; only candidates are verified by the regex itself. A rule without
mandatory trigrams scans every text of the shard.

No shuffle, no driver state, nothing that grows with the corpus; a lost task redoes its slice.

Defined cases: a null text is empty (no spans); positions are code points, end exclusive; kinds sort as listed in
``RULES``; other columns are not used.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser as P
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import slices


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules, then those that the method adds.
BASE = (
    Rule("assign", r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,255}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + ADDED

#: An exact set of strings larger than this is no longer tracked; its trigrams are taken and it becomes "anything".
SET = 64

_FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

# A query is True (anything), ("tri", t), ("and", parts) or ("or", parts).


def _and(*parts):
    flat = []
    for p in parts:
        if p is True:
            continue
        flat.extend(p[1] if p[0] == "and" else [p])
    flat = list(dict.fromkeys(flat))
    return True if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _or(*parts):
    if not parts or any(p is True for p in parts):
        return True
    parts = tuple(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", parts)


def _grams(strings):
    """The query of a set of strings one of which must occur."""
    return _or(*[_and(*[("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _broken(part):
    """A part whose matches are all known, as one of which only beginnings and ends are known."""
    query, exact, begins, ends = part
    return part if exact is None else (_and(query, _grams(exact)), None, exact, exact)


def _join(one, two):
    """Two parts in sequence."""
    if one[1] is not None and two[1] is not None and len(one[1]) * len(two[1]) <= SET:
        exact = {a + b for a in one[1] for b in two[1]}
        return _and(one[0], two[0]), exact, exact, exact
    begins, ends = one[2], two[3]
    if one[1] is not None and len(one[1]) * len(two[2]) <= SET:
        begins = {a + b for a in one[1] for b in two[2]}
    if two[1] is not None and len(one[3]) * len(two[1]) <= SET:
        ends = {a + b for a in one[3] for b in two[1]}
    # only an end and a beginning that touch make strings across the seam
    seam = _grams({a + b for a in one[3] for b in two[2]}) if len(one[3]) * len(two[2]) <= SET else True
    return _and(_broken(one)[0], _broken(two)[0], seam), None, begins, ends


def _exact(strings):
    return True, strings, strings, strings


ANYTHING = (True, None, {""}, {""})


def _chars(codes, flags):
    """One character of a few; no strings for what the folded bytes of a text may spell otherwise."""
    some = {chr(c).translate(_FOLD) for c in codes}
    loose = flags & re.IGNORECASE and not flags & re.ASCII
    return _exact(some) if len(some) <= 8 and all(c.isascii() and not (loose and c in "iks") for c in some) else ANYTHING


def _walk(items, flags):
    """Go through a parsed sequence. Returns a query, the set of all matches (None if not bounded), and two sets: every
    match begins with a string of the one and ends with a string of the other."""
    out = _exact({""})
    for op, arg in items:
        part = ANYTHING
        if op is C.LITERAL:
            part = _chars([arg], flags)
        elif op is C.IN and all(k in (C.LITERAL, C.RANGE) for k, _ in arg):
            part = _chars([c for k, v in arg for c in ([v] if k is C.LITERAL else range(v[0], min(v[1], v[0] + SET) + 1))], flags)
        elif op is C.SUBPATTERN:
            part = _walk(arg[3], (flags | arg[1]) & ~arg[2])
        elif op is C.BRANCH:
            sides = [_walk(side, flags) for side in arg[1]]
            if all(side[1] is not None and side[0] is True for side in sides):
                part = _exact(set().union(*[side[1] for side in sides]))
            else:
                sides = [_broken(side) for side in sides]
                part = _or(*[q for q, *_ in sides]), None, set().union(*[side[2] for side in sides]), set().union(*[side[3] for side in sides])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, body = arg
            inner = _walk(body, flags)
            if low == 0 and high == 1 and inner[0] is True and inner[1] is not None:
                part = _exact(inner[1] | {""})
            elif low >= 1 and low == high and inner[1] is not None and len(inner[1]) ** min(low, SET) <= SET and low <= SET:
                part = _exact({""})
                for _ in range(low):
                    part = _join(part, inner)
            elif low == high == 1:
                part = inner
            elif low >= 1:
                part = _broken(inner)
        elif op is C.AT:
            part = _exact({""})
        out = _join(out, part)
    return out


def trigram_query(pattern: str):
    """The Boolean trigram query of a regex (over lowercased text); True if it has no mandatory trigram."""
    parsed = P.parse(pattern)
    return _broken(_walk(parsed, parsed.state.flags))[0]


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams, query[1]))


def _code(t: str) -> int:
    a, b, c = t.encode("latin-1")
    return a << 16 | b << 8 | c


_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


class Index:
    """Postings of the given trigrams over the texts of a slice."""

    def __init__(self, wanted: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        self.n = len(offsets) - 1
        self.postings: dict[int, np.ndarray] = {}
        if len(data) < 3:
            return
        low = _LOWER[data]
        codes = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
        at = np.flatnonzero(wanted[codes])
        text = np.searchsorted(offsets, at, "right") - 1
        fits = at + 3 <= offsets[text + 1]
        pairs = np.unique(codes[at[fits]].astype(np.int64) << 32 | text[fits])
        if not len(pairs):
            return
        keys, first = np.unique(pairs >> 32, return_index=True)
        for key, rows in zip(keys.tolist(), np.split(pairs & 0xFFFFFFFF, first[1:]), strict=True):
            self.postings[key] = rows

    def find(self, query) -> np.ndarray:
        """Texts that satisfy a query, in order."""
        if query is True:
            return np.arange(self.n)
        if query[0] == "tri":
            return self.postings.get(_code(query[1]), np.zeros(0, np.int64))
        parts = [self.find(q) for q in query[1]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


def _scan(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    compiled = [(i, r, re.compile(r.pattern), trigram_query(r.pattern)) for i, r in enumerate(rules)]
    wanted = np.zeros(1 << 24, bool)
    for *_, query in compiled:
        wanted[[_code(t) for t in trigrams(query)]] = True
    for batch in batches:
        for rows, data, offsets in slices(batch):
            index, spans = Index(wanted, data, offsets), [[] for _ in range(len(offsets) - 1)]
            cache: dict[int, str] = {}
            for i, rule, regex, query in compiled:
                for t in index.find(query).tolist():
                    text = cache.get(t)
                    if text is None:
                        text = cache[t] = data[offsets[t] : offsets[t + 1]].tobytes().decode()
                    for m in regex.finditer(text):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            spans[t].append((m.start(), i, m.end()))
            for s in spans:
                s.sort()
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([[{"kind": rules[i].kind, "start": a, "end": e} for a, i, e in s] for s in spans], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "spans"],
            )


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, spans`` (array of kind, start, end; by start, then kind as listed) for each row of ``docs``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _scan(it, rules), "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: counts of the base kinds, SHA-256 of the base spans, all spans as text."""
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    count = lambda kind: F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as bigint)")
    return found.select(
        "doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(F.expr(joined.format(f"filter(spans, s -> s.kind in ({base}))")).cast("binary"), 256).alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"),
    )


def duckdb_sql() -> str:
    """The digest as SQL: positions from the lengths of the pieces between matches."""
    def finds(rule: Rule, order: int) -> str:
        pattern = rule.pattern.replace("(?ai:", "(?i:").replace("'", "''")
        group = f"regexp_extract(m[i], '{pattern}', {rule.group})" if rule.group else "m[i]"
        return (
            f"SELECT doc_id, text_id, '{rule.kind}' AS kind, {order} AS rank, s AS start, s + length(m[i]) AS stop FROM (SELECT doc_id, text_id, m, i, "
            f"list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s FROM ("
            f"SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, text_id, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS p FROM d))) WHERE length({group}) >= {rule.least}"
        )

    found = " UNION ALL ".join(finds(r, i) for i, r in enumerate(RULES))
    item = "concat(kind, ':', CAST(start AS BIGINT), ':', CAST(stop AS BIGINT))"
    kinds = ", ".join(f"'{r.kind}'" for r in BASE)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS text_id, coalesce(text, '') AS text FROM documents), found AS ({found}),
grouped AS (SELECT text_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
  coalesce(string_agg({item}, ',' ORDER BY start, rank) FILTER (kind IN ({kinds})), '') AS base, string_agg({item}, ',' ORDER BY start, rank) AS spans FROM found GROUP BY text_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN grouped USING (text_id)
"""
