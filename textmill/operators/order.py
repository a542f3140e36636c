"""Row numbers inside groups, also where a few groups hold all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.sources.store import temporary


def numbered(df: DataFrame, group: str, order: list[Column], name: str, total: str | None = None) -> DataFrame:
    """df with each row's number, from 1, in its group by an order (ties in any order), and with the group's rows as `total`.

    Rows are dealt into ranges of (group, order), and written so that the ranges stay what they are; a range
    numbers its own rows, and what the ranges before it hold of the group, one short row for each range and
    group, is added. So a group takes as many tasks as its size asks for, where a window over it would take one."""
    placed = df.repartitionByRange(F.col(group), *order).withColumn("_range", F.spark_partition_id())
    local = temporary(placed.withColumn("_n", F.row_number().over(Window.partitionBy("_range", group).orderBy(*order))), "ranges")
    counts = local.groupBy("_range", group).agg(F.max("_n").alias("_rows"))
    before = Window.partitionBy(group).orderBy("_range")
    starts = counts.select("_range", F.col(group).alias("_group"), (F.sum("_rows").over(before) - F.col("_rows")).alias("_before"), F.sum("_rows").over(Window.partitionBy(group)).alias("_all"))
    out = local.join(F.broadcast(starts), (local["_range"] == starts["_range"]) & F.col(group).eqNullSafe(F.col("_group")))
    columns = [local[c] for c in df.columns] + [(F.col("_before") + F.col("_n")).alias(name)]
    return out.select(*columns, *([F.col("_all").alias(total)] if total else []))
