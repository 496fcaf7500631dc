"""Text transforms without a relational form, as functions over Arrow batches: prose tightening, shrinking, hash embedding,
structural digest, chunking, line difference (STR-11..18, SRCH-1, SRCH-5)."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallgrass.functions import lexicon as L
from tallgrass.functions import text as T
from tallgrass.functions.arrow import runs

#: Spans that the prose passes never touch: fenced and inline code, links, paths, qualified names, calls, scopes, hex, addresses, constants.
PROTECTED = re.compile(r"```.*?```|`[^`\n]*`|https?://\S+|@[\w-]+/[\w-]+|\b\w+(?:::\w+)+|(?<!\w)\.{0,2}/[\w./-]+|\b\w+\([^()\n]*\)|\b0x[0-9a-fA-F]+\b|\b\d+(?:\.\d+){3}\b|\b[A-Z][A-Z0-9]*_[A-Z0-9_]+\b", re.S)


def _any(fragments: str) -> re.Pattern:
    return re.compile(r"(?<!\w)(?:" + fragments + r")(?!\w)[ \t]*", re.I)


_OPENERS = re.compile(r"(?:^|(?<=\n))[ \t]*(?:" + "|".join(L.OPENERS) + r")(?!\w)[ \t]*", re.I)
_STRIKE = _any("|".join(sorted(L.STRIKE, key=len, reverse=True)))
_DROP = _any("|".join(sorted(L.FLUFF + L.FILLERS, key=len, reverse=True)))
_PHRASES = [(re.compile(rf"\b{re.escape(a)}\b", re.I), b) for a, b in sorted(L.PHRASES, key=lambda p: -len(p[0]))]
_WORDS = dict(L.WORDS)
_WORD = re.compile(r"\b(?:" + "|".join(_WORDS) + r")\b", re.I)
_SHORT = [(re.compile(rf"\b{x}\b"), y) for x, y in L.CONTRACTIONS] + [(re.compile(r"\bI am\b"), "I'm")]


def _heads(fragments: tuple[str, ...]) -> tuple[str, ...]:
    """What each fragment begins with, in lower case: a text without any of these has no match."""
    return tuple({re.match(r"[\w' -]*", f)[0].lower() for f in fragments})


_STRIKE_HEADS, _DROP_HEADS, _WORD_HEADS, _OPENER_HEADS = _heads(L.STRIKE), _heads(L.FLUFF + L.FILLERS), _heads(tuple(_WORDS)), _heads(L.OPENERS)
_PHRASE_HEADS = [(a.lower(), pattern, new) for (pattern, new), (a, _) in zip(_PHRASES, sorted(L.PHRASES, key=lambda p: -len(p[0])), strict=True)]
_SHORT_HEADS = [(x, pattern, new) for (pattern, new), x in zip(_SHORT, [*(x for x, _ in L.CONTRACTIONS), "I am"], strict=True)]
#: Letters that a pattern takes for ASCII ones in disregard of case.
_ASCII = str.maketrans("\u0130\u0131\u017f\u212a", "iisk")
_FOLDED = re.compile("[\u0130\u0131\u017f\u212a]")


def _as_cased(old: str, new: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new


def tighten(text: str, professional: bool = False, contract: bool = True) -> tuple[str, int]:
    """The text with fillers cut and wordings shortened, and the number of edits. Protected spans stay."""
    edits, out, at, sentence = 0, [], 0, True
    folded = bool(_FOLDED.search(text))
    has = lambda heads: folded or any(h in low for h in heads)
    spans = [(m.start(), m.end()) for m in PROTECTED.finditer(text)] + [(len(text), len(text))]
    for start, end in spans:
        part = text[at:start]
        low = part.lower()
        for pattern, heads in ((_OPENERS, _OPENER_HEADS), (_STRIKE, _STRIKE_HEADS)):
            if has(heads):
                part, n = pattern.subn("", part)
                edits, low = edits + n, part.lower() if n else low
        for head, pattern, new in _PHRASE_HEADS:
            if folded or head in low:
                part, n = pattern.subn(lambda m, new=new: _as_cased(m[0], new) if m[0][0] != "I" else new, part)
                edits, low = edits + n, part.lower() if n else low
        if has(_WORD_HEADS):
            part, n = _WORD.subn(lambda m: _as_cased(m[0], _WORDS[m[0].translate(_ASCII).lower()]), part)
            edits, low = edits + n, part.lower() if n else low
        if not professional and has(_DROP_HEADS):
            part, n = _DROP.subn("", part)
            edits += n
        for head, pattern, new in _SHORT_HEADS if contract else ():
            if head in part:
                part, n = pattern.subn(new, part)
                edits += n
        part, n = re.subn(r"\b(\w+)(?: \1\b)+", r"\1", part)
        edits += n
        part = re.sub(r"(?<=\S)[ \t]{2,}(?=\S)", " ", re.sub(r"[ \t]+([,.;:!?])", r"\1", part))
        part = re.sub(r"(^|[.!?]\s+|\n)[,;:]\s*", r"\1", part)
        if sentence:
            part = re.sub(r"^(\s*)([a-z])", lambda m: m[1] + m[2].upper(), part)
        part = re.sub(r"([.!?]\s+)([a-z])", lambda m: m[1] + m[2].upper(), part)
        out += [part, text[start:end]]
        tail = (part + text[start:end]).rstrip()
        sentence, at = (not tail and sentence) or tail.endswith((".", "!", "?", "\n")), end
    joined, n = re.subn(r"\n{3,}", "\n\n", "".join(out))
    return "\n".join(line.rstrip() for line in joined.split("\n")).lstrip(" \t"), edits + n


_SHRINK_KEEP = re.compile(r"```.*?```|`[^`\n]*?`|(?:https?|ftp)://\S+|\.{0,2}/[\w./-]+|\b[A-Z][A-Z0-9_]{2,}\b|\b[A-Za-z_]\w*=\S+|\bv?\d+(?:\.\d+)+[\w.-]*\b|\b[A-Za-z_]\w*[.-][\w.-]+\b", re.S | re.A)
_SHRINK = [(re.compile(re.escape(a), re.I), b) for a, b in L.SHRINK_PHRASES]
_SHRINK_WORD = re.compile(r"(?<![A-Za-z])(?:" + "|".join(L.SHRINK_WORDS) + r")(?![A-Za-z])", re.I)


def shorten(text: str) -> str:
    """A description without filler words; code, links, paths, constants and versions stay."""
    out, at = [], 0
    for m in [*_SHRINK_KEEP.finditer(text), None]:
        part = text[at : m.start() if m else len(text)]
        for pattern, new in _SHRINK:
            part = pattern.sub(new, part)
        out += [_SHRINK_WORD.sub("", part), m[0] if m else ""]
        at = m.end() if m else at
    return re.sub(r"[ \t]+", " ", "".join(out)).strip()


_TOKEN = regex.compile(r"[\p{L}\p{N}_]+")


_START, _PRIME = 0xCBF29CE484222325, np.uint64(0x100000001B3)


def _hashed(states: np.ndarray, words: list[bytes], which: np.ndarray) -> np.ndarray:
    """FNV-1a of the words of numbers ``which``, each from its own state on; a pass for each byte position, over the words
    that reach it."""
    ends = np.cumsum(np.array([len(w) for w in words], np.int64))
    data = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.diff(ends, prepend=0)[which]
    order = np.argsort(-sizes, kind="stable")
    sizes, at = sizes[order], (ends[which] - np.diff(ends, prepend=0)[which])[order]
    h = states[order]
    k, n = 0, int(np.count_nonzero(sizes))
    while n > 64:
        h[:n] = (h[:n] ^ data[at[:n] + k]) * _PRIME
        k += 1
        n = int(np.searchsorted(-sizes, -k, "left"))  # words longer than k
    for i in range(n):  # a pass for a few long words costs more than their bytes do
        state = int(h[i])
        for byte in data[at[i] + k : at[i] + sizes[i]].tobytes():
            state = (state ^ byte) * int(_PRIME) & 0xFFFFFFFFFFFFFFFF
        h[i] = state
    out = np.empty_like(h)
    out[order] = h
    return out


def embed_all(texts: list[str], dim: int = 256) -> np.ndarray:
    """Signed feature hashing (FNV-1a, 64 bits) of words and adjacent pairs, scaled to length one; a row for each text."""
    found = [_TOKEN.findall(t.encode().lower().decode()) for t in texts]  # lower-case A-Z only
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for ws in found for w in ws], np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in found])
    words, n = [w.encode() for w in number], len(number)
    single = _hashed(np.full(n, _START, np.uint64), words, np.arange(n))
    follows = np.flatnonzero(owner[1:] == owner[:-1])
    pairs, which = np.unique(ids[follows] * n + ids[follows + 1], return_inverse=True)
    double = _hashed((single[pairs // max(n, 1)] ^ np.uint64(ord("_"))) * _PRIME, words, pairs % max(n, 1))
    h = np.concatenate([single[ids], double[which]])
    cells = np.concatenate([owner, owner[follows]]) * dim + (h % np.uint64(dim)).astype(np.int64)
    out = np.bincount(cells, np.where(h >> np.uint64(63), 1.0, -1.0), len(texts) * dim).astype(np.float32).reshape(-1, dim)
    for row in out:
        norm = np.linalg.norm(row)
        if norm:
            row /= norm
    return out


def embed(text: str, dim: int = 256) -> np.ndarray:
    return embed_all([text], dim)[0]


def cut_paragraphs(text: str, most: int = 4000, least: int = 16) -> list[dict]:
    """Paragraphs at blank lines or before ``most`` bytes are exceeded; shorter ones than ``least`` bytes are dropped."""
    out, buffer, size, first = [], [], 0, 1

    def flush(last: int) -> None:
        body = "\n".join(buffer).strip()
        if len(body.encode()) >= least:
            title = body.split("\n", 1)[0].lstrip("# ").strip()
            out.append({"title": title or None, "content": body, "line_start": first, "line_end": last})
        buffer.clear()

    for no, line in enumerate(text.split("\n"), 1):
        width = len(line.encode()) + 1
        if not line.strip() or size + width > most:
            if buffer:
                flush(no - 1)
            size, first = 0, no if line.strip() else no + 1
        if line.strip():
            buffer.append(line)
            size += width
    if buffer:
        flush(text.count("\n") + 1)
    return out


def delta(old: str, new: str, limit: int = 2000) -> dict:
    """Lines added and removed and a short rendering; files of over ``limit`` lines only get a note."""
    a, b = old.split("\n"), new.split("\n")
    if max(len(a), len(b)) > limit:
        return {"adds": 0, "dels": 0, "body": f"[too long: {len(a)} -> {len(b)} lines]"}
    adds = dels = 0
    out: list[str] = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            same = [f"  {x}" for x in a[i:j]]
            out += same if len(same) < 6 else [*same[:2], f"  … {len(same) - 4} unchanged", *same[-2:]]
        else:
            dels, adds = dels + j - i, adds + m - k
            out += [f"- {x}" for x in a[i:j]] + [f"+ {x}" for x in b[k:m]]
    return {"adds": adds, "dels": dels, "body": "\n".join(out)}


def _by_runs(docs: DataFrame, keep: tuple[str, ...], texts: tuple[str, ...], makes: str, of: Callable[..., list[pa.Array]]) -> DataFrame:
    """The columns ``keep`` and what ``of`` makes of the columns ``texts`` (a null text counts as empty), in runs of about
    ``RUN_BYTES``: a worker never holds the results of a whole batch of Spark's."""
    made = StructType.fromDDL(makes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, *texts):
            found = of(*([t or "" for t in rows.column(c).to_pylist()] for c in texts))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), *found], [*keep, *made.names])

    return docs.select(*keep, *texts).mapInArrow(run, StructType([*(docs.schema[c] for c in keep), *made]))


def humanise(docs: DataFrame) -> DataFrame:
    def of(texts: list[str]) -> list[pa.Array]:
        done = [tighten(t) for t in texts]
        return [pa.array([n for _, n in done], pa.int64()), pa.array([t for t, _ in done], pa.string())]

    sized = docs.select("id", F.char_length("text").cast("long").alias("chars_before"), F.col("text").alias("old"))
    return _by_runs(sized, ("id", "chars_before"), ("old",), "edits long, text string", of).select("id", "chars_before", F.char_length("text").cast("long").alias("chars_after"), "edits", "text")


def shrink(docs: DataFrame) -> DataFrame:
    return _by_runs(docs, ("id",), ("text",), "text string", lambda texts: [pa.array([shorten(t) for t in texts], pa.string())])


def hash_embed(docs: DataFrame, dim: int = 256) -> DataFrame:
    def of(texts: list[str]) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * dim, embed_all(texts, dim).ravel())]

    return _by_runs(docs, ("id",), ("text",), "embedding array<float>", of)


def chunk(docs: DataFrame) -> DataFrame:
    kind = pa.list_(pa.struct([("title", pa.string()), ("content", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32())]))
    made = "chunks array<struct<title:string,content:string,line_start:int,line_end:int>>"
    return _by_runs(docs, ("id",), ("text",), made, lambda texts: [pa.array([cut_paragraphs(t) for t in texts], kind)]).select("id", F.inline("chunks"))


def line_delta(pairs: DataFrame) -> DataFrame:
    def of(old: list[str], new: list[str]) -> list[pa.Array]:
        done = [delta(a, b) for a, b in zip(old, new, strict=True)]
        return [pa.array([d[k] for d in done], t) for k, t in (("adds", pa.int64()), ("dels", pa.int64()), ("body", pa.string()))]

    return _by_runs(pairs, ("id",), ("old", "new"), "adds long, dels long, body string", of)


def structural_digest(docs: DataFrame, most: int = 50) -> DataFrame:
    """Numbered lines that open a definition, or head and tail where there are none; JVM only."""
    lines = F.split("text", "\n")
    heads = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("no"), x.alias("line"))), lambda s: s["line"].rlike("^\\s*(?:def|class|fn|pub|struct|enum|impl|trait|function|export|const|async)\\b"))
    shown = F.array_join(F.transform(F.slice(heads, 1, most), lambda s: F.concat(F.lit("L"), s["no"].cast("string"), F.lit(": "), F.trim(s["line"]))), "\n")
    return docs.select("id", F.when(F.size(heads) > 0, shown).otherwise(T.head_tail(F.col("text"), 3, 3)).alias("digest"))
