"""The inverted index as DataFrames: tokenised chunks, postings, corpus statistics, and both on disk.

A posting is one row for a term in a chunk, with all its positions. File-name positions lie NAME below
those of the content, so one list holds both and neither runs on into the other.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.tokens import LANES
from textmill.sources import views
from textmill.sources.store import delete, fresh, stamp

#: Weight of an occurrence in the file name and in the content.
WEIGHTS = (5.0, 1.0)
NAME = 1 << 30
#: Bytes of a row group of postings: a query reads those that its terms' statistics do not rule out.
ROW_GROUP = 4 << 20
#: Tasks that a frequent term's postings are dealt out over.
PARTS = 32


def tokenised(chunks: DataFrame, lane: str = "word") -> DataFrame:
    """chunks with ft, ct (tokens of file name and content) and dl (their number)."""
    make = LANES[lane]
    # a generator of one row, so that later steps read the arrays and do not tokenise anew at each mention
    out = chunks.select("*", F.inline(F.array(F.struct(make("filename").alias("ft"), make("content").alias("ct")))))
    return out.withColumn("dl", F.size("ft") + F.size("ct"))


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later steps read as often as they like; inside a projection it would be evaluated anew each time."""
    return df.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def grouped(tok: DataFrame) -> DataFrame:
    """Tokenised chunks as postings (term, chunk_id, file_id, ordinal, location, dl, pos array<int>), without a shuffle: a
    chunk's tokens are sorted by term and place, and each run of one term is a row."""
    entry = lambda shift: lambda t, i: F.struct(t.alias("term"), (i - shift).alias("pos"))
    every = F.array_sort(F.concat(F.transform("ft", entry(NAME)), F.transform("ct", entry(0))))
    runs = _held(tok.where("dl > 0").select("chunk_id", "file_id", "ordinal", "location", "dl", "ft", "ct"), "s", every).drop("ft", "ct")
    first = lambda i: F.coalesce(F.get("s", i).term != F.get("s", i - 1).term, F.lit(True))
    runs = _held(runs, "begins", F.filter(F.sequence(F.lit(0), F.col("dl") - 1), first))
    run = lambda b, k: F.struct(F.get("s", b).term.alias("term"), F.transform(F.slice("s", b + 1, F.coalesce(F.get("begins", k + 1), F.col("dl")) - b), lambda x: x.pos).alias("pos"))
    return runs.select("chunk_id", "file_id", "ordinal", "location", "dl", F.inline(F.transform("begins", run))).select("term", "chunk_id", "file_id", "ordinal", "location", "dl", "pos")


def postings(chunks: DataFrame, lane: str = "word") -> DataFrame:
    return grouped(tokenised(chunks, lane))


def corpus_stats(tok: DataFrame) -> DataFrame:
    """One row: n_chunks and avgdl over every chunk of the lane, never of a filtered part."""
    return tok.agg(F.count("*").alias("n_chunks"), F.avg("dl").alias("avgdl"))


def vocabulary(posts: DataFrame) -> DataFrame:
    """Per term: documents (chunks) and occurrences."""
    return posts.groupBy("term").agg(F.count("*").alias("docs"), F.sum(F.size("pos")).alias("occurrences"))


@dataclass(frozen=True)
class Stored:
    """An index on disk. Chunks are tokenised once, when it is built."""

    spark: SparkSession
    base: str
    n_chunks: int
    avgdl: float | None

    @property
    def postings(self) -> DataFrame:
        """Sorted by term and chunk: a term's row groups are few and the others skipped."""
        return self.spark.read.parquet(f"{self.base}/postings")

    @property
    def chunks(self) -> DataFrame:
        """The chunks themselves, sorted by chunk_id, with dl."""
        return self.spark.read.parquet(f"{self.base}/chunks")

    @property
    def terms(self) -> DataFrame:
        """Per term, sorted: chunks that have it, and occurrences."""
        return self.spark.read.parquet(f"{self.base}/terms")

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """In how many chunks each of a query's terms stands; out of those row groups of `terms` alone."""
        found = {r.term: r.docs for r in self.terms.where(F.col("term").isin(terms)).select("term", "docs").collect()}
        return {t: found.get(t, 0) for t in terms}

    @property
    def stats(self) -> DataFrame:
        return self.spark.createDataFrame([(self.n_chunks, self.avgdl)], "n_chunks long, avgdl double")


def write(chunks: DataFrame, base: str, lane: str = "word") -> Stored:
    """Write the index of chunks (chunk_id, file_id, ordinal, filename, location, content): tokens once, then the
    postings by term, each term dealt out over at most PARTS tasks, and sorted by term and chunk."""
    spark = chunks.sparkSession
    tokenised(chunks, lane).write.parquet(f"{base}/tokens")
    tok = spark.read.parquet(f"{base}/tokens")
    dealt = grouped(tok).repartition(F.col("term"), F.pmod(F.xxhash64("chunk_id"), F.lit(PARTS)))
    dealt.sortWithinPartitions("term", "chunk_id").write.option("parquet.block.size", ROW_GROUP).parquet(f"{base}/postings")
    vocabulary(spark.read.parquet(f"{base}/postings")).repartitionByRange("term").sortWithinPartitions("term").write.option("parquet.block.size", ROW_GROUP).parquet(f"{base}/terms")
    tok.drop("ft", "ct").repartitionByRange("chunk_id").sortWithinPartitions("chunk_id").write.option("parquet.block.size", ROW_GROUP).parquet(f"{base}/chunks")
    n, mean = corpus_stats(tok).first()
    delete(spark, f"{base}/tokens")
    return Stored(spark, base, n, mean)


def backfilled(held: Stored, chunks: DataFrame, lane: str = "word") -> tuple[Stored, bool]:
    """The index as it is where it holds as many chunks as there are, else one written anew beside it; and which."""
    if chunks.count() == held.n_chunks:
        return held, False
    return write(chunks, f"{held.base}-{uuid.uuid4().hex}", lane), True


_built: dict[tuple, Stored] = {}


def of_tables(spark: SparkSession, sf_dir: str, lane: str = "word") -> Stored:
    """The index of a folder's search views, built at the first query that asks for it and kept, in the folder that
    all executors share, until the driver ends. A changed table has another stamp and gets another index."""
    key = (spark.sparkContext.applicationId, stamp(spark, f"{sf_dir}/documents.parquet"), lane)
    if key not in _built:
        chunks = views.chunks(spark, sf_dir) if lane == "word" else views.cjk(spark, sf_dir)
        _built[key] = write(chunks, fresh(spark, "index"), lane)
    return _built[key]

