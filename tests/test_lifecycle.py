import datetime as dt

import pytest
from pyspark.sql import functions as F

from textmill.operators import lifecycle, metrics
from textmill.streaming import watch

NOW = 1000.0
STATE = "path string, revision int, status string, updated_at double, source_modified_time double, source_size long, failure_count int, retry_after double, owner string, started_at double"


def test_classify(spark):
    listing = spark.createDataFrame([("/a/new.txt", 1.0, 5), ("/a/same.txt", 1.0, 5), ("/a/touched.txt", 2.0, 5), ("/a/wait.txt", 1.0, 5), ("/a/big.txt", 1.0, 500), ("/a/old.docx", 1.0, 5), ("/a/hollow.txt", 1.0, 5), ("/a/void.txt", 1.0, 5)], "path string, modified_time double, size long")
    names = ["same.txt", "touched.txt", "wait.txt", "old.docx", "hollow.txt", "void.txt", "gone.txt"]
    indexed = spark.createDataFrame([(i, f"/a/{n}", 1.0, 5) for i, n in enumerate(names)], "file_id long, path string, modified_time double, size long")
    status = {"wait.txt": "FAILED", "void.txt": "NO_TEXT"}
    state = spark.createDataFrame([(f"/a/{n}", 1, status.get(n, "INDEXED"), 0.0, 1.0, 5, 1, NOW + 5, None, None) for n in names], STATE)
    chunks = spark.createDataFrame([(0,), (1,), (3,)], "file_id long")
    got = {r.path[3:]: r.action for r in lifecycle.classify(listing, indexed, state, chunks, NOW, 100).collect()}
    assert got == {"new.txt": "new", "same.txt": "unchanged", "touched.txt": "changed", "wait.txt": "deferred", "big.txt": "oversize", "old.docx": "changed", "hollow.txt": "changed", "void.txt": "unchanged", "gone.txt": "missing"}
    paths = spark.createDataFrame([("/a/wait.txt",), ("/a/gone.txt",)], "path string")
    assert {r.path: r.action for r in lifecycle.update_precise(listing, indexed, state, chunks, paths).collect()} == {"/a/wait.txt": "changed", "/a/gone.txt": "missing"}


def test_failures_count_on_while_the_source_stays(spark):
    failed = spark.createDataFrame([("/a.txt", "X", 1.0, 5), ("/b.txt", "LegacyExtractionTimeout", 2.0, 5), ("/c.txt", "ParserCancelled", 1.0, 5)], "path string, error_code string, modified_time double, size long")
    state = spark.createDataFrame([(f"/{n}.txt", 1, "FAILED", 0.0, 1.0, 5, 2, 0.0, None, None) for n in "abc"], STATE)
    got = {r.path: (r.status, r.failure_count, r.retry_after) for r in lifecycle.record_failures(failed, state, NOW).collect()}
    assert got == {"/a.txt": ("FAILED", 3, NOW + 1200), "/b.txt": ("TIMEOUT", 1, NOW + 1800), "/c.txt": ("SKIPPED", 3, 0.0)}


def test_recovery(spark):
    rows = [("/dead", 1, "EXTRACTING", 0.0, 1.0, 5, 0, 0.0, "r1", 0.0), ("/third", 1, "EXTRACTING", 0.0, 1.0, 5, 2, 0.0, "r1", 0.0), ("/alive", 1, "EXTRACTING", 0.0, 1.0, 5, 0, 0.0, "r2", 0.0), ("/fresh", 1, "EXTRACTING", NOW - 1, 1.0, 5, 0, 0.0, None, None), ("/done", 1, "INDEXED", 0.0, 1.0, 5, 0, 0.0, "r1", 0.0)]
    got = lifecycle.recover(spark.createDataFrame(rows, STATE), spark.createDataFrame([("r2",)], "owner string"), NOW).collect()
    assert {r.path: (r.status, r.failure_count) for r in got} == {"/dead": ("INTERRUPTED", 1), "/third": ("QUARANTINED", 3)}


def test_upsert_and_replace(spark):
    old = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 5.0)], "path string, error_code string, updated_at double")
    new = spark.createDataFrame([("a", "y", 1.0), ("b", "y", 4.0), ("c", "y", 0.0)], "path string, error_code string, updated_at double")
    assert {r.path: r.error_code for r in lifecycle.upsert(old, new).collect()} == {"a": "y", "b": "x", "c": "y"}


def test_retry_plan(spark):
    issues = spark.createDataFrame([("/r/a.txt",), ("/r/sub/b.txt",), ("/r/sub/dir",), ("/r/sub/dir",), ("/q/c.txt",), ("/rx/d.txt",)], "path string")
    roots = spark.createDataFrame([("/r",), ("/r/sub",)], "root string")
    assert sorted((r.kind, r.path) for r in lifecycle.retry_plan(issues, roots).collect()) == [("file", "/r/a.txt"), ("rescan", "/r/sub"), ("skipped", "/q/c.txt"), ("skipped", "/rx/d.txt")]


def event(at, kind, src, dest=None, folder=False):
    return (dt.datetime(2026, 1, 1) + dt.timedelta(seconds=at), kind, folder, src, dest)


EVENT = "ts timestamp, event_type string, is_directory boolean, src_path string, dest_path string"


def test_changes(spark):
    rows = [event(0, "created", "/a/x.txt"), event(1, "opened", "/a/x.txt"), event(2, "moved", "/a/~$y.docx", "/a/y.docx"), event(3, "modified", "/out/z.txt"), event(4, "deleted", "/a/dir", folder=True), event(5, "moved", "/out/d", "/out/e", True), event(6, "moved", "/out/d", "/a/e", True), event(7, "modified", "/outer/q.pdf"), event(8, "modified", "/a/w.tmp")]
    got = watch.changes(spark.createDataFrame(rows, EVENT), ("/out",)).orderBy("ts").collect()
    assert [(r.path, r.rescan) for r in got] == [("/a/x.txt", False), ("/a/y.docx", False), (None, True), (None, True), ("/outer/q.pdf", False)]


def test_debounce_is_capped(spark):
    rows = [event(t / 2, "modified", f"/a/f{t % 3}.txt") for t in range(50)] + [event(40, "created", "/a/late.txt")]
    found = watch.changes(spark.createDataFrame(rows, EVENT)).withColumn("root", F.lit("/a"))
    got = watch.debounce(found, "root").orderBy("first_ts").collect()
    assert [(r.first_ts - dt.datetime(2026, 1, 1)).total_seconds() for r in got] == [0.0, 10.0, 20.0, 40.0]
    assert got[0].paths == ["/a/f0.txt", "/a/f1.txt", "/a/f2.txt"] and got[3].paths == ["/a/late.txt"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [event(t, "modified", f"/a/f{i % 4}.txt") for i, t in enumerate([0, 0.5, 1, 5, 5.2, 30, 31, 31.1])]
    df = spark.createDataFrame(rows, EVENT).coalesce(1)
    df.write.parquet(f"{tmp_path}/in/events")
    spark.createDataFrame([event(500, "modified", "/a/end.txt")], EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/events")
    source = watch.changes(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/events")).withColumn("root", F.lit("/a"))
    query = watch.stream_batches(source, "root", "10 seconds").writeStream.format("memory").queryName("batches").option("checkpointLocation", f"{tmp_path}/ckpt").start()
    query.processAllAvailable()
    query.stop()
    live = sorted((r.first_ts, tuple(r.paths)) for r in spark.table("batches").collect())
    found = watch.changes(df).withColumn("root", F.lit("/a"))
    rest = sorted((r.first_ts, tuple(r.paths)) for r in watch.flush(watch.sessions(found, "root"), ["root", "session"]).collect())
    assert live == rest[: len(live)] and len(live) >= 2


def test_stream_debounce_equals_batch(spark, tmp_path):
    rows = [event(t / 2, "modified", f"/a/f{t % 3}.txt") for t in range(50)] + [event(40, "created", "/a/late.txt"), event(41, "deleted", "/a/d", folder=True)]
    df = spark.createDataFrame(rows, EVENT)
    for i, part in enumerate((df.where("ts < '2026-01-01 00:00:13'"), df.where("ts >= '2026-01-01 00:00:13'"), spark.createDataFrame([event(500, "modified", "/a/end.txt")], EVENT), spark.createDataFrame([event(900, "modified", "/a/end.txt")], EVENT))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/events")
        source = watch.changes(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in/events")).withColumn("root", F.lit("/a"))
        query = watch.stream_debounce(source, "root", "5 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ckpt").outputMode("append").start()
        query.processAllAvailable()
        query.stop()
    live = sorted((r.first_ts, tuple(r.paths), r.full_rescan) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    found = watch.changes(df).withColumn("root", F.lit("/a"))
    want = sorted((r.first_ts, tuple(r.paths), r.full_rescan) for r in watch.debounce(found, "root").collect())
    assert live[: len(want)] == want and len(want) == 4 and live[3][2]


def test_run_hands_over_batches(spark, tmp_path):
    df = spark.createDataFrame([event(0, "created", "/a/x.txt")], EVENT)
    df.write.parquet(f"{tmp_path}/in/events")
    seen = []
    query = watch.run(watch.changes(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in/events")), lambda b, i: seen.extend(r.path for r in b.collect()), f"{tmp_path}/ckpt")
    query.processAllAvailable()
    query.stop()
    assert seen == ["/a/x.txt"]


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("r", "x", 1)], "query_id string, item string, rank int")
    relevance = spark.createDataFrame([("q", "b", 3.0), ("q", "d", 1.0), ("r", "y", 0.0)], "query_id string, item string, gain double")
    get = lambda df, c: {r.query_id: r[c] for r in df.collect()}
    assert get(metrics.recall(ranked, relevance, 2), "recall") == {"q": 0.5, "r": 0.0}
    assert get(metrics.mrr(ranked, relevance), "mrr") == {"q": 0.5, "r": 0.0}
    ndcg = get(metrics.ndcg(ranked, relevance, 2), "ndcg")
    assert ndcg["r"] == 1.0 and ndcg["q"] == pytest.approx((7 / 1.584962500721156) / (7 + 1 / 1.584962500721156))
    empty = spark.createDataFrame([], "query_id string, recall double, mrr double, ndcg double")
    assert tuple(metrics.mean(empty).first()) == (1.0, 1.0, 1.0)
    times = spark.createDataFrame([("a", float(v)) for v in range(1, 21)] + [("b", 7.0)], "g string, v double")
    assert {r.g: (r.p50, r.p95) for r in metrics.latency(times, "g", "v").collect()} == {"a": (10.5, 19.0), "b": (7.0, 7.0)}
