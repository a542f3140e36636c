"""File-level search: whole files, three lanes, no phrases beyond single terms.

A query's terms are what white space parts; every term has to be found. A query of one or two CJK
characters takes the bigram lane, a longer one with a CJK character the trigram lane (a term is then
any substring of three or more characters; a shorter term finds nothing), any other the word lane.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions import tokens
from textmill.functions.snippet import snippet
from textmill.operators import index, match


def lane_of(query: str) -> tuple[str, list[str]]:
    """The lane and the query's terms in it."""
    terms = query.split()
    compact = "".join(terms)
    if not any(map(tokens.is_cjk, compact)):
        return "word", terms
    if len(compact) <= 2 and all(map(tokens.is_cjk, compact)):
        return "cjk", [compact]
    return ("trigram", terms) if len(compact) >= 3 else ("word", terms)


def _substrings(c: str, term: str) -> Column:
    """How often a lower-cased term stands in a column, overlaps counted: its run of trigrams in the column's."""
    return F.regexp_count(F.lower(c), F.lit("(?=" + re.sub(r"([^\w\s])", r"\\\1", term.lower()) + ")")) if len(term) >= 3 else F.lit(0)


def _trigram_scores(files: DataFrame, terms: list[str], keep: list[str]) -> DataFrame:
    count = lambda c: F.greatest(F.length(F.lower(c)) - 2, F.lit(0))
    w = index.WEIGHTS
    counted = files.select(*keep, (count("filename") + count("content")).alias("dl"), *[(w[0] * _substrings("filename", t) + w[1] * _substrings("content", t)).alias(f"f{i}") for i, t in enumerate(terms)])
    return match.counted_scores(counted, [f"f{i}" for i in range(len(terms))], keep)


def search(files: DataFrame, query: str) -> DataFrame:
    """The columns of files (at least file_id, filename, content) with snippet and score of every hit; lower is better.

    Corpus figures cover all rows of files, those without content too."""
    files = files.withColumn("content", F.coalesce("content", F.lit("")))
    lane, terms = lane_of(query)
    keep = files.columns
    if not terms:
        scored = files.select("*", F.lit(0.0).alias("score")).where(F.lit(False))
    elif lane == "trigram":
        scored = _trigram_scores(files, terms, keep)
    else:
        known = set(keep)
        tok = index.tokenised(files.withColumns({c: v for c, v in (("chunk_id", F.col("file_id")), ("ordinal", F.lit(0))) if c not in known}), lane)
        phrases = [terms] if lane == "cjk" else [tokens.query_words(t) for t in terms]
        scored = match.scan_scores(tok, phrases, tuple(c for c in keep if c not in ("chunk_id", "file_id", "ordinal"))).select(*keep, "score")
    return scored.withColumn("snippet", snippet("content", terms)).select(*[c for c in keep if c != "content"], "snippet", "score")


def page(hits: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Best first, then newest; at most 500."""
    return hits.orderBy("score", F.col("modified_time").desc(), "file_id").offset(max(0, offset)).limit(max(1, min(limit, 500)))
