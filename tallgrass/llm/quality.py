"""Quality rules and a hashed n-gram log-likelihood ratio.

Two multinomials over ``BUCKETS`` hashed word unigrams and bigrams: the trusted target (documents labelled good) and
the raw corpus (all documents). A document's score is the sum over its n-grams of log p(target) - log p(raw), divided
by their number. Every document is judged by the same threshold: the score that separates the labelled good from the
labelled bad documents best (most balanced accuracy; the lower score on ties), 0 where there are no labels of both kinds.

Counts cover all documents: each task adds up one vector of ``BUCKETS`` counts, and only these meet (a map-side partial
sum whose size does not depend on the data). All labels count. Up to ``BROADCAST`` of them are broadcast, and no text is
shuffled; more are joined by their ids, which deals out the texts once. The results are the same. The threshold comes from a histogram of ``STEPS`` score steps, not from rows.

Defined cases: a null text has no words; it and any text of fewer than 20 words fail the base rules; with several labels
of an id, a bad one wins; ids without label or with null labels are unlabelled; repeated rows are judged one by one;
other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm.common import gram_hashes, mix, scratch, slices, span_hashes, staged, word_bounds

BUCKETS = 1 << 16
#: Pseudo-counts added to each bucket of both multinomials, as a share of a uniform draw.
SMOOTH = 1.0
LOW, HIGH, STEPS = -4.0, 4.0, 1600
WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30
COUNTS = "bucket int, raw long, good long"
#: So many labels at most are broadcast (12 bytes each).
BROADCAST = 1_000_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


class Words:
    """Words of a slice with their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.n = len(offsets) - 1
        self.starts, self.ends, self.firsts = word_bounds(data, offsets)
        self.hashes = span_hashes(data, self.starts, self.ends)
        self.text = np.repeat(np.arange(self.n), np.diff(self.firsts))

    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and text of every unigram and bigram."""
        pairs = gram_hashes(self.hashes, 2)
        inside = self.text[1:] == self.text[:-1] if len(self.text) > 1 else np.zeros(0, bool)
        codes = np.concatenate([mix(self.hashes), pairs[inside] if len(pairs) else pairs])
        return (codes >> np.uint64(48)).astype(np.int64) % BUCKETS, np.concatenate([self.text, self.text[:-1][inside] if len(self.text) > 1 else np.zeros(0, np.int64)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for rows, data, offsets in slices(batch):
            bucket, text = Words(data, offsets).buckets()
            marks = rows.column(2).fill_null(-1).to_numpy(zero_copy_only=False)
            raw += np.bincount(bucket, minlength=BUCKETS)
            good += np.bincount(bucket[marks[text] == 1], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(good[some])], names=["bucket", "raw", "good"])


def base_figures(words: Words, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n = words.n
    n_words = np.diff(words.firsts)
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    point = (data & 0xC0) != 0x80
    depth = np.zeros(len(data) + 1, np.int32)
    np.add.at(depth, words.starts, 1)
    np.add.at(depth, words.ends, -1)
    inside = np.cumsum(depth[:-1]) > 0
    chars = np.bincount(text_of[point & inside], minlength=n)
    symbols = np.bincount(text_of[_SYMBOL[data]], minlength=n)
    # lines with a word that equal an earlier line of the same text
    dup = np.zeros(n, np.int64)
    breaks = np.zeros(len(data) + 1, bool)
    breaks[1:] = data == 10
    breaks[offsets[:-1][offsets[:-1] < len(data)]] = True
    begin = np.flatnonzero(breaks[: len(data)]) if len(data) else np.zeros(0, np.int64)
    if len(begin):
        line_text = text_of[begin]
        stop = np.append(begin[1:], len(data))
        stop = np.where((stop > begin) & (data[stop - 1] == 10), stop - 1, stop)
        seen = np.searchsorted(words.starts, stop) > np.searchsorted(words.starts, begin)
        begin, stop, line_text = begin[seen], stop[seen], line_text[seen]
        keys = mix(span_hashes(data, begin, stop) + line_text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first = np.unique(keys, return_index=True)
        again = np.ones(len(keys), bool)
        again[first] = False
        dup = np.bincount(line_text[again], minlength=n)
    # words in windows found twice or more
    repeat = np.zeros(n, np.int64)
    grams = gram_hashes(words.hashes, WINDOW)
    if len(grams):
        whole = words.text[: len(grams)] == words.text[WINDOW - 1 :]
        at = np.flatnonzero(whole)
        keys = mix(grams[at] + words.text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
        twice = at[times[inverse] > 1]
        cover = np.zeros(len(words.text) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + WINDOW, -1)
        repeat = np.bincount(words.text[np.cumsum(cover[:-1]) > 0], minlength=n)
    return [n_words, chars, symbols, dup, repeat]


def _base_failed(figures: list[np.ndarray]) -> np.ndarray:
    return (figures[0] < LEAST_WORDS) | (100 * figures[4] > REPEAT_PERCENT * figures[0])


def _score(words: Words, ratio: np.ndarray) -> np.ndarray:
    bucket, text = words.buckets()
    total = np.bincount(text, weights=ratio[bucket], minlength=words.n)
    return total / np.maximum(np.bincount(text, minlength=words.n), 1)


def labelled(labels: DataFrame) -> DataFrame:
    """``doc_id, good`` (1 or 0), one row per labelled id."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min(F.when(F.col("quality") == 1, 1).otherwise(0)).cast("int").alias("good"))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The log ratio of each bucket and the threshold."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(docs.sparkSession):
        marks = staged(labelled(labels), "labels")
        if marks.count() <= BROADCAST:
            marked = slim.join(F.broadcast(marks), slim.doc_id == marks.label_id, "left").select("doc_id", "text", "good")
            counted = marked.mapInArrow(_count, COUNTS)
        else:
            marked = staged(slim.join(marks, slim.doc_id == marks.label_id).select("doc_id", "text", "good"), "marked")
            every = slim.withColumn("good", F.lit(None).cast("int")).mapInArrow(_count, COUNTS)
            counted = every.unionByName(marked.mapInArrow(_count, COUNTS).withColumn("raw", F.lit(0).cast("long")))
        got = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()  # at most BUCKETS rows
        counts = np.zeros((2, BUCKETS))
        counts[0, got.bucket], counts[1, got.bucket] = got.raw, got.good
        if not counts[1].sum():
            return np.zeros(BUCKETS), 0.0
        share = (counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * BUCKETS)
        ratio = np.log(share[1]) - np.log(share[0])
        step = (HIGH - LOW) / STEPS
        seen = marked.where("good is not null").mapInArrow(lambda it: _scores(it, ratio), "good int, score double").groupBy("good", F.floor((F.greatest(F.lit(LOW), F.least(F.lit(HIGH), "score")) - LOW) / step).alias("at")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    tally = np.zeros((2, STEPS + 1))
    for row in seen.itertuples():
        tally[int(row.good), int(row.at)] += row.n
    if not tally.sum(1).all():
        return ratio, 0.0
    below = np.cumsum(tally, 1) / tally.sum(1, keepdims=True)
    gain = np.concatenate([[0.0], below[0] - below[1]])  # of the threshold below step i
    return ratio, LOW + step * int(gain.argmax())


def _scores(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in slices(batch):
            words = Words(data, offsets)
            passed = pa.array(~_base_failed(base_figures(words, data, offsets)))  # the others fail whatever the threshold
            yield pa.RecordBatch.from_arrays([rows.column(2), pa.array(_score(words, ratio))], names=["good", "score"]).filter(passed)


def _judge(batches: Iterator[pa.RecordBatch], ratio: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    for batch in batches:
        for rows, data, offsets in slices(batch):
            words = Words(data, offsets)
            figures = base_figures(words, data, offsets)
            failed = _base_failed(figures)
            score = _score(words, ratio)
            yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(f.astype(np.int64)) for f in figures], pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)], names=names)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The base figures, ``base_failed``, ``kept`` and ``score`` of each row of ``docs``."""
    ratio, threshold = fit(docs, labels)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _judge(it, ratio, threshold), schema)
