"""The synthetic office workload: index build and warm query latency out of postings on disk.

    python bench_office.py [files] [folder]
"""

from __future__ import annotations

import json
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from textmill.operators import index, rank
from textmill.plans.query import parse
from textmill.sources import workload


def main(n: int, folder: str) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter()
    workload.files(spark, n).write.parquet(f"{folder}/files")
    workload.chunks(spark, n).repartition(8, "file_id").write.parquet(f"{folder}/chunks")
    files, chunks = spark.read.parquet(f"{folder}/files").cache(), spark.read.parquet(f"{folder}/chunks")
    corpus = time.perf_counter() - start
    start = time.perf_counter()
    held = {lane: index.write(chunks, f"{folder}/index-{lane}", lane) for lane in ("word", "cjk")}
    built = time.perf_counter() - start
    want, took = workload.expected(n), {}
    for name, raw in workload.QUERIES.items():
        q, times = parse(raw), []
        for _ in range(4):
            start = time.perf_counter()
            if q.terms:
                found = rank.file_hits(held[q.lane], files, q)
            else:
                found = files.where(rank.metadata(q.filters))
            found = found.cache()
            hit_count = found.count()
            rank.page(found, "relevance", 100, keyword=bool(q.terms)).collect()
            found.unpersist()
            times.append(time.perf_counter() - start)
        assert hit_count == want[name], (name, hit_count, want[name])
        took[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"files": n, "corpus_s": round(corpus, 1), "index_s": round(built, 1), "files_per_s": round(n / built, 1), "p50_s": took}))


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 10_000, sys.argv[2] if len(sys.argv) > 2 else tempfile.mkdtemp())
