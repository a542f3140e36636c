"""Row numbers in groups that are dealt over many tasks."""

import random

from pyspark.sql import functions as F

from textmill.operators import metrics
from textmill.operators.order import numbered


def test_numbers_equal_a_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the small table really has several ranges
    try:
        got = {(r.g, r.i): (r.n, r.all) for r in numbered(df, "g", [F.col("v").desc(), F.col("i")], "n", "all").collect()}
        none = numbered(df.where("false"), "g", [F.col("i")], "n").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    want = {}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        want |= {(g, r[1]): (k, len(mine)) for k, r in enumerate(mine, 1)}
    assert got == want and none == 0


def test_latency(spark):
    rows = [("a", float(i)) for i in range(1, 101)] + [("b", 7.0)] + [("c", 1.0), ("c", 3.0)]
    got = {r.g: (r.p50, r.p95) for r in metrics.latency(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert got == {"a": (50.5, 95.0), "b": (7.0, 7.0), "c": (2.0, 1.0)}
