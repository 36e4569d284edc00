"""Joins that Spark lacks, over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, by: list[tuple[str, str]] | None = None, how: str = "left", op: str = ">=") -> DataFrame:
    """For each left row the right row of greatest `right_time` with left_time op right_time and equal keys.

    One shuffle: both sides go in one stream by key, ordered by time, and the last right row so far is carried along.
    No inequality join, so a key with many rows on both sides stays linear.  op: >=, >, <= or <.  Right columns that
    also exist on the left get the suffix `_right`.
    """
    by = by or []
    names = [c if c not in left.columns else f"{c}_right" for c in right.columns]
    keys = [f"_k{i}" for i in range(len(by))]
    a = left.select(F.lit(0).alias("_s"), *(F.col(x).alias(k) for (x, _), k in zip(by, keys, strict=True)), F.col(left_time).alias("_t"), F.struct(*left.columns).alias("_l"))
    present = F.col(right_time).isNotNull()
    for _, y in by:
        present = present & F.col(y).isNotNull()
    b = right.filter(present).select(F.lit(1).alias("_s"), *(F.col(y).alias(k) for (_, y), k in zip(by, keys, strict=True)), F.col(right_time).alias("_t"), F.struct(*(F.col(c).alias(m) for c, m in zip(right.columns, names, strict=True))).alias("_r"))
    both = a.unionByName(b, allowMissingColumns=True)
    forward = op in (">=", ">")
    time = F.col("_t").asc_nulls_first() if forward else F.col("_t").desc_nulls_first()
    side = F.col("_s").asc() if op in (">", "<") else F.col("_s").desc()
    w = Window.partitionBy(*keys).orderBy(time, side).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_s = 0")
    if how == "inner":
        out = out.filter("_r IS NOT NULL")
    return out.select("_l.*", "_r.*")


def with_positions(df: DataFrame, name: str = "_pos") -> DataFrame:
    """Row numbers from 0 in the frame's own order, without gathering rows in one task: partition counts give the bases."""
    numbered = df.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_in"))
    counts = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    base = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    return numbered.join(base, "_part").select(*df.columns, (F.col("_base") + F.col("_in")).alias(name))


def positional_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows side by side; the shorter side is filled with nulls."""
    return with_positions(left).join(with_positions(right), "_pos", "full").drop("_pos")


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """left.point between right.low and right.high, as an equality join over buckets of a width.

    A right row is sent to every bucket that it covers: choose a width near the usual interval.
    """
    a = left.withColumn("_b", F.floor(F.col(point) / width))
    b = right.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    cond: Column = (a["_b"] == b["_b"]) & (a[point] >= b[low]) & (a[point] <= b[high])
    return a.join(b, cond, how).drop("_b")
