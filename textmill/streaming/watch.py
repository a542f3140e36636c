"""The change stream: which events count, and when a batch of them is flushed.

Events: ts (timestamp), event_type, is_directory, src_path, dest_path. The same functions run on
batch tables and streams; `debounce` is the batch form of the capped quiet period, `stream_debounce` its
streaming form with state of its own, and `stream_batches` a plain session window without the cap.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.sources import formats

KINDS = ("created", "modified", "deleted", "moved")
QUIET, CAP = 1.2, 10.0


def _supported(path: Column, enabled: tuple[str, ...]) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).isin(*enabled) & ~name.startswith("~$") & ~name.endswith(".tmp")


def _excluded(path: Column, excluded: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for root in excluded:
        out = out | formats.under(path, F.lit(root))
    return out


def changes(events: DataFrame, excluded: tuple[str, ...] = (), enabled: tuple[str, ...] = formats.DEFAULT_ENABLED) -> DataFrame:
    """(ts, path, rescan): a supported file's path, or a rescan for a directory outside the excluded ones."""
    kept = events.where(F.col("event_type").isin(*KINDS))
    both_out = _excluded(F.col("src_path"), excluded) & (F.col("dest_path").isNull() | _excluded(F.col("dest_path"), excluded))
    sides = F.filter(F.array("src_path", "dest_path"), lambda p: p.isNotNull())
    wanted = F.filter(sides, lambda p: ~_excluded(p, excluded) & _supported(p, enabled))
    entry = F.when(F.col("is_directory"), F.when(~both_out, F.array(F.struct(F.lit(None).cast("string").alias("path"), F.lit(True).alias("rescan"))))).otherwise(F.transform(wanted, lambda p: F.struct(p.alias("path"), F.lit(False).alias("rescan"))))
    return kept.select("ts", F.explode(entry).alias("c")).select("ts", "c.path", "c.rescan")


def sessions(found: DataFrame, key: str, quiet: float = QUIET) -> DataFrame:
    """changes with a session number: a gap of `quiet` seconds or more ends one. `key` splits the stream, e.g. by root."""
    w = Window.partitionBy(key).orderBy("ts")
    gap = F.col("ts").cast("double") - F.lag(F.col("ts").cast("double")).over(w)
    return found.withColumn("session", F.sum(F.when(gap >= quiet, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def flush(found: DataFrame, by: list[str]) -> DataFrame:
    """Per batch: sorted distinct paths and whether to rescan."""
    return found.groupBy(*by).agg(F.min("ts").alias("first_ts"), F.array_sort(F.collect_set("path")).alias("paths"), F.bool_or("rescan").alias("full_rescan"))


def debounce(found: DataFrame, key: str, quiet: float = QUIET, cap: float = CAP) -> DataFrame:
    """Batches of each key: flushed after `quiet` seconds without a change, or `cap` seconds after the batch's first.

    Only sessions that last longer than the cap are walked change by change; distinct times of one session at a time."""
    seconds = F.col("ts").cast("double")
    placed = sessions(found, key, quiet)
    ends = placed.groupBy(key, "session").agg(F.min(seconds).alias("from"), F.max(seconds).alias("to"))
    short = placed.join(ends.where(F.col("to") - F.col("from") < cap), [key, "session"]).withColumn("batch", F.col("from"))
    long = placed.join(ends.where(F.col("to") - F.col("from") >= cap), [key, "session"])
    start = F.struct(F.lit(None).cast("double").alias("first"), F.array().cast("array<double>").alias("begins"))

    def step(acc, t):
        new = acc["first"].isNull() | (t - acc["first"] >= cap)
        return F.struct(F.when(new, t).otherwise(acc["first"]).alias("first"), F.when(new, F.concat(acc["begins"], F.array(t))).otherwise(acc["begins"]).alias("begins"))

    times = long.groupBy(key, "session").agg(F.array_sort(F.collect_set(seconds)).alias("t"))
    marks = times.select(key, "session", F.aggregate("t", start, step)["begins"].alias("begins"))
    walked = long.join(marks, [key, "session"]).withColumn("batch", F.array_max(F.filter("begins", lambda b: b <= seconds)))
    columns = [*found.columns, "batch"]
    return flush(short.select(*columns).unionByName(walked.select(*columns)), [key, "batch"])


def stream_batches(found: DataFrame, key: str, late: str = "30 seconds", quiet: str = "1200 milliseconds") -> DataFrame:
    """Streaming: one row for each key and session, emitted when the watermark has passed it; a rescan stands for its paths."""
    return found.withWatermark("ts", late).groupBy(key, F.session_window("ts", quiet).alias("w")).agg(F.min("ts").alias("first_ts"), F.array_sort(F.collect_set("path")).alias("paths"), F.bool_or("rescan").alias("full_rescan"))


def stream_debounce(found: DataFrame, key: str, late: str = "30 seconds", quiet: float = QUIET, cap: float = CAP) -> DataFrame:
    """Streaming form of `debounce`: a key's batch is kept as state and emitted when a later change shows that it
    was over, or when the watermark has passed its quiet period or its cap."""
    kind = dict(found.dtypes)[key]
    out = f"`{key}` {kind}, first_ts timestamp, paths array<string>, full_rescan boolean"

    def row(name, first, paths, rescan):
        return pd.DataFrame({key: [name], "first_ts": [pd.Timestamp(first, unit="s")], "paths": [sorted(paths)], "full_rescan": [rescan]})

    def step(names, parts, state):
        if state.hasTimedOut:
            first, _, paths, rescan = state.get
            state.remove()
            yield row(names[0], first, paths, rescan)
            return
        first, last, paths, rescan = state.get if state.exists else (None, None, [], False)
        paths = set(paths)
        rows = pd.concat(list(parts)).sort_values("ts")
        for at, path, again in zip(rows["ts"].astype("int64") / 1e9, rows["path"], rows["rescan"], strict=True):
            if first is not None and (at - last >= quiet or at - first >= cap):
                yield row(names[0], first, paths, rescan)
                first, paths, rescan = None, set(), False
            first, last = at if first is None else first, at if last is None or first is None else max(at, last)
            if path is not None:
                paths.add(path)
            rescan = bool(rescan or again)
        state.update((float(first), float(last), sorted(paths), rescan))
        state.setTimeoutTimestamp(max(int(min(last + quiet, first + cap) * 1000), state.getCurrentWatermarkMs() + 1))

    narrow = found.select(key, F.col("ts").cast("timestamp").alias("ts"), "path", "rescan").withWatermark("ts", late)
    return narrow.groupBy(key).applyInPandasWithState(step, out, "first double, last double, paths array<string>, rescan boolean", "append", "EventTimeTimeout")


# Seconds between full scans, between health checks, and the least gap that casts doubt on what was seen.
RECONCILE, HEALTH, RESUME = 3600.0, 60.0, 120.0


def reconcile_every(spark: SparkSession, rescan: Callable[[], None], checkpoint: str, seconds: float = RECONCILE):
    """A query of its own that scans all roots now and then every so many seconds, whatever events came."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, __: rescan()).trigger(processingTime=f"{max(1, round(seconds * 1000))} milliseconds").option("checkpointLocation", checkpoint).start()


class Watcher:
    """Keeps a change query alive. check() is to be called every HEALTH seconds: a query that has ended is started
    anew, and after that, or after a gap between checks that tells of a suspended machine, everything is scanned
    once, since changes may have been missed."""

    def __init__(self, start: Callable[[], object], rescan: Callable[[], None], every: float = HEALTH, gap: float | None = None, clock: Callable[[], float] = time.monotonic):
        self.start, self.rescan, self.every, self.clock = start, rescan, every, clock
        self.gap = max(every, max(RESUME, 3 * every) if gap is None else gap)
        self.query, self.last = start(), None

    def alive(self) -> bool:
        try:
            return bool(self.query.isActive)
        except Exception:  # noqa: BLE001  a query that cannot be asked is not alive
            return False

    def check(self) -> str:
        """What was done: restarted, resumed or nothing."""
        now, before = self.clock(), self.last
        self.last = now
        if not self.alive():
            self.query = self.start()
            self.rescan()
            return "restarted"
        if before is not None and now - before >= self.gap:
            self.rescan()
            return "resumed"
        return "nothing"

    def run(self, stopped: threading.Event) -> None:
        """Check until stopped."""
        while not stopped.wait(self.every):
            self.check()


def run(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands every micro-batch to `apply`, e.g. an update of the given paths."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("append").start()
