"""Phrase matching and BM25.

`scores` answers out of an index on disk where it is given one, out of tokenised chunks otherwise, with
equal results. `index_scores` reads the postings of the query's terms and nothing else: a query of one
word takes its hits as they stand there, others bring a chunk's few postings together. `scan_scores`
counts phrases inside each chunk's token arrays, without an index and without a shuffle.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.operators.index import WEIGHTS, Stored

K1, B, FLOOR = 1.2, 0.75, 1e-6


def occurrences(array: Column | str, phrase: list[str]) -> Column:
    """How often the phrase stands at consecutive places of a token array."""
    a = F.col(array) if isinstance(array, str) else array
    if len(phrase) == 1:
        return F.size(F.filter(a, lambda t: t == phrase[0]))
    # one pass for each token of the phrase: no access by index, which would evaluate the array anew for each place
    is_ = lambda t: lambda x: x == t
    hits = [F.transform(F.slice(a, k + 1, F.size(a)), is_(t)) for k, t in enumerate(phrase)]
    both = functools.reduce(lambda x, y: F.zip_with(x, y, lambda p, q: F.coalesce(p & q, F.lit(False))), hits)
    return F.size(F.filter(both, lambda x: x))


def idf(n_chunks: Column, n_with: Column) -> Column:
    raw = F.log((n_chunks - n_with + 0.5) / (n_with + 0.5))
    return F.when(raw <= 0, F.lit(FLOOR)).otherwise(raw)


def bm25(f: Column, dl: Column, avgdl: Column) -> Column:
    return f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avgdl))


def scores(held: Stored | DataFrame, phrases: list[list[str]], carry: tuple[str, ...] = ("location",)) -> DataFrame:
    """(chunk_id, file_id, ordinal, carried columns, score) of chunks that hold every phrase; lower is better."""
    if isinstance(held, Stored):
        if phrases and all(len(p) == 1 for p in phrases):
            return known_scores(held, [p[0] for p in phrases], carry)
        return index_scores(held.postings, held.stats, phrases, carry)
    return scan_scores(held, phrases, carry)


def scan_scores(tok: DataFrame, phrases: list[list[str]], carry: tuple[str, ...] = ("location",)) -> DataFrame:
    keep = ["chunk_id", "file_id", "ordinal", *carry]
    if not phrases or not all(phrases):
        return tok.select(*keep, F.lit(0.0).alias("score")).where(F.lit(False))
    names = [f"f{i}" for i in range(len(phrases))]
    counted = tok.select(*keep, "dl", *[(WEIGHTS[0] * occurrences("ft", p) + WEIGHTS[1] * occurrences("ct", p)).alias(n) for n, p in zip(names, phrases, strict=True)])
    return counted_scores(counted, names, keep)


def counted_scores(counted: DataFrame, names: list[str], keep: list[str], corpus: DataFrame | None = None) -> DataFrame:
    """`keep` and score of the rows in which no weighted number of occurrences is 0, out of these and dl.

    corpus: n_chunks and avgdl; without it counted holds every chunk."""
    with_n = [F.count_if(F.col(n) > 0).alias(f"n_{n}") for n in names]
    if corpus is None:
        stats = counted.agg(F.count("*").alias("n_chunks"), F.avg("dl").alias("avgdl"), *with_n)
    else:
        stats = counted.agg(*with_n).crossJoin(F.broadcast(corpus))  # one row each
    hits = counted.where(functools.reduce(operator.and_, [F.col(n) > 0 for n in names]))
    # one row of corpus figures beside every hit
    scored = hits.crossJoin(F.broadcast(stats))
    score = functools.reduce(operator.add, [idf(F.col("n_chunks"), F.col(f"n_{n}")) * bm25(F.col(n), F.col("dl"), F.col("avgdl")) for n in names])
    return scored.select(*keep, (-score).alias("score"))


def _weighted(places: Column) -> Column:
    """Occurrences by their column's weight; file-name places are negative."""
    return WEIGHTS[0] * F.size(F.filter(places, lambda x: x < 0)) + WEIGHTS[1] * F.size(F.filter(places, lambda x: x >= 0))


def phrase_counts(posts: DataFrame, phrases: list[list[str]], carry: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """chunk_id, file_id, ordinal, carried columns, dl and f0, f1, ...: each phrase's weighted occurrences in the
    chunks that have any term of the query; and the names of these."""
    keep, names = ["chunk_id", "file_id", "ordinal", *carry, "dl"], [f"f{i}" for i in range(len(phrases))]
    terms = sorted({t for p in phrases for t in p})
    found = posts.where(F.col("term").isin(terms))
    if len(terms) == 1 and phrases == [terms]:
        return found.select(*keep, _weighted(F.col("pos")).alias("f0")), names
    places = {t: f"p{i}" for i, t in enumerate(terms)}
    none = F.array().cast("array<int>")
    beside = found.groupBy(*keep).agg(*[F.coalesce(F.max(F.when(F.col("term") == t, F.col("pos"))), none).alias(c) for t, c in places.items()])

    def starts(phrase):
        shifted = lambda k: lambda x: x - k
        return functools.reduce(F.array_intersect, [F.transform(places[t], shifted(k)) for k, t in enumerate(phrase)])

    return beside.select(*keep, *[_weighted(starts(p)).alias(n) for p, n in zip(phrases, names, strict=True)]), names


def known_scores(held: Stored, terms: list[str], carry: tuple[str, ...]) -> DataFrame:
    """index_scores for single words: the index knows in how many chunks each stands, so hits are scored as they are read."""
    counted, names = phrase_counts(held.postings, [[t] for t in terms], carry)
    n_with = held.frequencies(sorted(set(terms)))
    mean, parts = held.avgdl or 1.0, []
    for t, n in zip(terms, names, strict=True):
        raw = math.log((held.n_chunks - n_with[t] + 0.5) / (n_with[t] + 0.5))
        parts.append(F.lit(raw if raw > 0 else FLOOR) * bm25(F.col(n), F.col("dl"), F.lit(mean)))
    hits = counted.where(functools.reduce(operator.and_, [F.col(n) > 0 for n in names]))
    return hits.select("chunk_id", "file_id", "ordinal", *carry, (-functools.reduce(operator.add, parts)).alias("score"))


def index_scores(posts: DataFrame, stats: DataFrame, phrases: list[list[str]], carry: tuple[str, ...] = ("location",)) -> DataFrame:
    """As scan_scores, out of postings and corpus_stats."""
    keep = ["chunk_id", "file_id", "ordinal", *carry]
    if not phrases or not all(phrases):
        return posts.select(*keep, F.lit(0.0).alias("score")).where(F.lit(False))
    counted, names = phrase_counts(posts, phrases, carry)
    return counted_scores(counted, names, keep, stats)
