"""Relational operators with no SQL of their own in Spark, over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def top_with_ties(df: DataFrame, n: int, keys: list[str], descending: bool = False) -> DataFrame:
    """The first n rows by the keys and those equal to the last of them.

    The bound comes from a top-n of the keys alone (TakeOrderedAndProject), then a filter keeps what reaches it.
    """
    key = F.struct(*keys)
    first = df.select(key.alias("_k")).orderBy(F.desc("_k") if descending else F.asc("_k")).limit(n)
    bound = first.agg((F.min if descending else F.max)("_k").alias("_bound"))
    reached = (key >= F.col("_bound")) if descending else (key <= F.col("_bound"))
    return df.join(F.broadcast(bound), reached).drop("_bound")  # one row


def limit_by(df: DataFrame, n: int, keys: list[str], order: list[Column]) -> DataFrame:
    """At most n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def with_fill(df: DataFrame, column: str, low, high, step: int = 1) -> DataFrame:
    """Rows for the values of a sequence that are missing, other columns null."""
    spark = df.sparkSession
    grid = spark.range(low, high, step).withColumnRenamed("id", column)
    return grid.join(df, column, "left")


def reservoir(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A uniform sample of n rows: the n least of a hash over the rows' values and a seed."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns).limit(n)
