"""Language identification by language-bitmask n-gram filters.

A model holds, for each language, the n-grams (2 to 4 letters, runs of other characters count as one space) whose share
of that language's n-grams of their length is at least ``MIN_SHARE``. All sets live in one bit-sliced Bloom filter: a
table of bit rows, one bit per language, so that the AND of an n-gram's ``HASHES`` rows gives all languages that
contain it at once. For a text, the hits of each language are counted over all n-grams; the expected false positives
of the language's filter are taken off, and the language with the largest corrected share wins (ties: first in order).

The fit reads a bounded sample: about ``SAMPLE`` labelled rows of each language, chosen by a hash of the id at a rate
found from one count per language. ``MIN_SHARE`` bounds what reaches the driver: at most ``1 / MIN_SHARE`` n-grams for
each language and length. Prediction is one pass without shuffle.

Defined cases: a null text or one without letters is ``und`` with score 0; a text with letters of which no n-gram is known
gets the language with most labelled rows (ties: first in order), with score 0; a null id is never learned from and not held
out; without any labelled row every text is ``und``; labels of null are not learned; very long texts are read in pieces
whose counts add up; other columns are not used.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.llm.common import gram_hashes, mix, slices

SIZES = (2, 3, 4)
MIN_SHARE = 1e-4
SAMPLE = 2000
HASHES = 3
#: Bits of the filter for each n-gram of the largest language.
BITS_PER_GRAM = 12
FOLDS, SEED = 5, 99
UNKNOWN = "und"
#: A text is rejected by the corpus pipeline below this score.
LEAST_SCORE = 0.3

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For each code point, whether it is a letter (built once per process)."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def _grams(texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Letters per text, and for each size the n-grams' hashes with their texts. N-grams without a letter are left out."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", np.uint32)
    which = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    letter = _is_letter()[points]
    n_letters = np.bincount(which[letter], minlength=len(texts))
    codes = np.where(letter, points, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each run of letters
    keep[0] = True
    codes, letter, which = codes[keep], letter[keep], which[keep]
    # a space in front of each text's first letter is the one after the text before, or index 0
    out = []
    for size in SIZES:
        hashes = gram_hashes(codes, size)
        m = len(hashes)
        inner = np.ones(m, bool)  # no space but at the ends
        for i in range(1, size - 1):
            inner &= letter[i : i + m]
        some = letter[:m] | letter[size - 1 : size - 1 + m]
        pick = inner & some
        out.append((hashes[pick] + np.uint64(size), which[size - 1 : size - 1 + m][pick]))
    return n_letters, out, which


#: A longer text is read in pieces of so many bytes; n-grams across a cut count as two starts.
PIECE_BYTES = 1 << 21


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[list[str], np.ndarray]]:
    """The texts of a slice as (pieces, text of each piece): all at once, but a long text a piece at a time."""
    if len(data) <= PIECE_BYTES:
        whole = data.tobytes()
        yield [whole[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.arange(len(offsets) - 1)
        return
    for i in range(len(offsets) - 1):
        at, end = int(offsets[i]), int(offsets[i + 1])
        while True:
            stop = min(end, at + PIECE_BYTES)
            while stop < end and data[stop] & 0xC0 == 0x80:
                stop -= 1
            yield [data[at:stop].tobytes().decode()], np.array([i])
            at = stop
            if at >= end:
                break


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # rows x words of 64 languages
    false_rate: np.ndarray
    #: The language of texts whose n-grams tell nothing.
    likeliest: int = 0

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each text of a slice."""
        n = len(offsets) - 1
        letters, total, hits = np.zeros(n), np.zeros(n), np.zeros((n, len(self.languages)))
        for texts, rows in _pieces(data, offsets):
            a, b, c = self.counts(texts)
            letters[rows] += a
            total[rows] += b
            hits[rows] += c
        return self.decide(letters, total, hits)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Letters, n-grams and hits per language of each text."""
        n, langs = len(texts), len(self.languages)
        total, hits = np.zeros(n), np.zeros((n, langs))
        n_letters, grams, _ = _grams(texts)
        for hashes, which in grams:
            found = _lookup(self.table, hashes)
            total += np.bincount(which, minlength=n)
            for k in range(langs):
                bit = (found[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
                hits[:, k] += np.bincount(which, weights=bit, minlength=n)
        return n_letters, total, hits

    def decide(self, n_letters, total, hits) -> tuple[list[str], np.ndarray]:
        rate = hits / np.maximum(total, 1)[:, None]
        true = np.clip((rate - self.false_rate) / (1 - self.false_rate), 0, 1)
        best = true.argmax(1) if len(self.languages) else np.zeros(len(total), int)
        score = true.max(1, initial=0)
        best = np.where(score > 0, best, self.likeliest)
        none = (n_letters == 0) | (not self.languages)
        score = np.where(none, 0.0, score)
        return [UNKNOWN if bad else self.languages[b] for bad, b in zip(none, best, strict=True)], score


def _slots(hashes: np.ndarray, rows: int) -> Iterator[np.ndarray]:
    step = mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    for i in range(HASHES):
        yield ((hashes + np.uint64(i) * step) >> np.uint64(20)) % np.uint64(rows)


def _lookup(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = None
    for slot in _slots(hashes, len(table)):
        out = table[slot] if out is None else out & table[slot]
    return out


def build(languages: list[str], grams: dict[str, np.ndarray]) -> Model:
    """The filter from each language's n-gram hashes (uint64)."""
    most = max((len(g) for g in grams.values()), default=0)
    rows = 1 << max(10, int(most * BITS_PER_GRAM).bit_length())
    table = np.zeros((rows, max(1, -(-len(languages) // 64))), np.uint64)
    for k, lang in enumerate(languages):
        for slot in _slots(grams[lang], rows):
            table[slot, k // 64] |= np.uint64(1 << (k % 64))
    fill = np.array([((table[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))])
    return Model(languages, table, fill**HASHES)


def fold(doc_id) -> F.Column:
    """crc32 of the id's text mod ``FOLDS``; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in slices(batch, 1):
            langs = np.array(part.column(0).to_pylist(), object).astype(str)
            for texts, rows in _pieces(data, offsets):
                names, code = np.unique(langs[rows], return_inverse=True)
                for size, (hashes, which) in zip(SIZES, _grams(texts)[1], strict=True):
                    for k, name in enumerate(names):
                        grams, n = np.unique(hashes[code[which] == k], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(np.full(len(grams), size, np.int32)), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "size", "gram", "n"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number per language
    if not sizes:
        return build([], {})
    rates = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))])
    unit = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.where(unit < F.element_at(rates, F.col("lang"))).select("lang", "text")
    counts = chosen.mapInArrow(_count, "lang string, size int, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("lang", "size"))
    frequent = counts.withColumn("total", total).where(F.col("n") >= F.col("total") * MIN_SHARE).select("lang", "gram").toPandas()  # at most 1 / MIN_SHARE a language and size
    languages = sorted(sizes)
    model = build(languages, {lang: np.sort(frequent.loc[frequent.lang == lang, "gram"].to_numpy(np.int64)).view(np.uint64) for lang in languages})
    model.likeliest = max(range(len(languages)), key=lambda k: (sizes[languages[k]], -k))
    return model


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in slices(batch):
            langs, score = model.judge(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row of ``docs``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _predict(it, model), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; the model is fitted on ``docs`` if none is given."""
    model = model or train(docs)
    return predict(docs, model).select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without the rows whose language is unknown or scores below ``least``; no join, rows stay whole."""
    model = train(docs)
    columns = docs.columns

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for rows, data, offsets in slices(batch, at):
                langs, score = model.judge(data, offsets)
                good = (np.array(langs, object) != UNKNOWN) & (score >= least)
                yield rows.filter(pa.array(good.astype(bool)))

    return docs.mapInArrow(decide, docs.schema).select(columns)
