"""Retrieval: two lexical rankers, dense ranking, rank fusion, proximity, snippets, fuzzy correction (SRCH, WIN, JN-9)."""

from __future__ import annotations

from collections import deque
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions import text as T

K1, B, RRF_K = 1.2, 0.75, 60


def query_words(query: str, limit: int | None = None) -> list[str]:
    """Distinct lower-cased words of a query, in order."""
    import regex

    words = list(dict.fromkeys(w.translate(str.maketrans(T.UPPER, T.LOWER)) for w in regex.split(r"[^\p{L}\p{N}]+", query) if w))
    return words[:limit]


def _score(counts: list[Column], length: Column, stats) -> Column:
    """BM25 with the statistics as literals; document frequencies in the order of the terms."""
    parts = []
    for i, tf in enumerate(counts):
        idf = F.greatest(F.lit(1e-6), F.log((stats.n - stats[f"df{i}"] + F.lit(0.5)) / (stats[f"df{i}"] + F.lit(0.5))))
        parts.append(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (stats.average or 1.0))))
    return reduce(lambda a, b: a + b, parts)


def _ranked(scored: DataFrame, counts: list[Column], length: Column) -> DataFrame:
    stats = scored.agg(F.count(F.lit(1)).alias("n"), F.avg(length).alias("average"), *[F.count_if(c > 0).alias(f"df{i}") for i, c in enumerate(counts)]).first()  # one row
    return scored.where(reduce(lambda a, b: a | b, [c > 0 for c in counts])).select("id", F.round(_score(counts, length, stats), 6).alias("score"))


def _once(docs: DataFrame, value: Column, name: str, *kept: Column | str) -> DataFrame:
    """``kept`` columns and ``value``, computed once a row: the optimiser copies a projected expression into each of its
    uses and into filters, but nothing through a generator."""
    return docs.select("id", *kept, F.explode(F.array(value)).alias(name))


def _occurrences(word: str) -> Column:
    return F.size(F.filter("hits", lambda x: x == word))


def bm25(docs: DataFrame, words: list[str]) -> DataFrame:
    """SRCH-9 without stemming: ``(id, score)`` of documents with any of the words. A text is cut once a pass, and only its
    query words are counted, in place, so no postings are shuffled: one pass for statistics, one for scores."""
    cut = _once(docs, T.words_of("text", keep_underscore=False), "words")
    hits = _once(cut, F.filter("words", lambda x: x.isin(words)), "hits", F.size("words").alias("length"))
    counts = [_occurrences(w) for w in words]
    return _ranked(hits, counts, F.col("length"))


def trigram_bm25(docs: DataFrame, words: list[str]) -> DataFrame:
    """SRCH-10: the same over substrings; words under three characters match nothing."""
    low = _once(docs, T.ascii_lower(F.col("text")), "low")
    words = [w for w in words if len(w) >= 3]
    counts = [((F.char_length("low") - F.char_length(F.replace("low", F.lit(w), F.lit("")))) / len(w)).cast("int") for w in words]
    return _ranked(low, counts, F.greatest(F.char_length("low") - 2, F.lit(0)))


def top(scored: DataFrame, k: int = 50) -> DataFrame:
    return scored.orderBy(F.desc("score"), "id").limit(k)


def cosine(vectors: DataFrame, query: list[float]) -> DataFrame:
    """SRCH-12: cosine with one query vector (a literal), in double."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(q, q))
    return vectors.select("id", F.round(F.when(norm > 0, dot(F.col("embedding"), q) / norm).otherwise(0.0), 6).alias("score"))


def fuse(rankers: dict[str, DataFrame], k: int = RRF_K) -> DataFrame:
    """SRCH-13: reciprocal-rank fusion of short ranked lists (union and one aggregate instead of outer joins)."""
    ranked = [df.select("id", F.lit(name).alias("ranker"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long").alias("rank")) for name, df in rankers.items()]
    both = reduce(DataFrame.unionByName, ranked)
    ranks = [F.max(F.when(F.col("ranker") == n, F.col("rank"))).alias(f"{n}_rank") for n in rankers]
    score = reduce(lambda a, b: a + b, [F.coalesce(1.0 / (k + F.col(f"{n}_rank")), F.lit(0.0)) for n in rankers])
    fused = both.groupBy("id").agg(*ranks).withColumn("score", F.round(score, 6))
    return fused.na.fill(0, [f"{n}_rank" for n in rankers])  # 0: not ranked


def best_window(text, low, words: list[str], width: int = 160) -> Column:
    """SRCH-16/WIN-9: the window (stepping by half) with most distinct words, the earliest of equals. ``low`` is a column
    with the lower-cased text, so that it is not folded again for every window."""
    step = width // 2
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(text) - 1, F.lit(0)), F.lit(step))
    def hits(s):
        part = F.substring(low, s + 1, F.lit(width))
        return reduce(lambda a, b: a + b, [F.contains(part, F.lit(w)).cast("int") for w in words])
    best = F.array_max(F.transform(starts, lambda s: F.struct(hits(s).alias("hits"), (-s).alias("back"))))
    return F.substring(text, F.lit(1) - best["back"], F.lit(width))


def proximity_bonus(text, words: list[str]) -> Column:
    """SRCH-14: 0.05 / (1 + span / 40) where ``span`` is the shortest stretch with all query words present (two at least).

    Computed per row on the survivors only; the stretch is found by an Arrow UDF.
    """
    @F.pandas_udf("double")
    def bonus(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: 0.0 if (span := minimal_span(t or "", words)) is None else 0.05 / (1 + span / 40))

    return bonus(text)


def minimal_span(text: str, words: list[str]) -> int | None:
    """Bytes of the shortest stretch that covers all words present; None if fewer than two are."""
    low, found = text.encode().lower(), []
    for w in words:
        needle, at = w.encode(), -1
        while (at := low.find(needle, at + 1)) >= 0:
            found.append((at, at + len(needle), w))
    kinds = {w for *_, w in found}
    if len(kinds) < 2:
        return None
    found.sort()
    best, left, inside, ends = None, 0, {}, deque()  # ends: places of the window with falling ends, the first is the furthest
    for right, (_, end, w) in enumerate(found):
        inside[w] = inside.get(w, 0) + 1
        while ends and found[ends[-1]][1] <= end:
            ends.pop()
        ends.append(right)
        while len(inside) == len(kinds):
            span = found[ends[0]][1] - found[left][0]
            best = span if best is None else min(best, span)
            gone = found[left][2]
            inside[gone] -= 1
            if not inside[gone]:
                del inside[gone]
            if ends[0] == left:
                ends.popleft()
            left += 1
    return best


def correct(words: list[str], vocabulary: DataFrame) -> DataFrame:
    """SRCH-15: nearest vocabulary word within one edit for each query word that is not in the vocabulary."""
    asked = F.explode(F.array(*[F.lit(w) for w in words]))
    near = vocabulary.select(asked.alias("word"), "term").where(F.abs(F.char_length("word") - F.char_length("term")) <= 1).withColumn("distance", F.levenshtein("word", "term", 1)).where("distance >= 0")
    return near.groupBy("word").agg(F.min(F.struct("distance", "term")).alias("m")).select("word", "m.term", F.col("m.distance").cast("long").alias("distance"))


def hybrid(docs: DataFrame, vectors: DataFrame, query: str, vector: list[float], k: int = 50, limit: int = 10) -> DataFrame:
    """The whole pipeline: three rankers, fusion, proximity and snippet on the survivors."""
    words = query_words(query)
    fused = fuse({"bm25": top(bm25(docs, words), k), "trigram": top(trigram_bm25(docs, words), k), "dense": top(cosine(vectors, vector), k)})
    hits = docs.join(F.broadcast(fused), "id")  # at most 3 * k rows
    scored = hits.withColumn("score", F.round(F.col("score") + proximity_bonus(F.col("text"), words), 6)).orderBy(F.desc("score"), "id").limit(limit)
    shown = _once(scored, T.ascii_lower(F.col("text")), "low", "text", "score", "bm25_rank", "trigram_rank", "dense_rank")
    return shown.select("id", "score", "bm25_rank", "trigram_rank", "dense_rank", best_window(F.col("text"), F.col("low"), words).alias("snippet"))
