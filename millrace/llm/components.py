"""Connected components of a link table, exact, in at most log2(nodes) rounds of contraction.

In a round every node hooks to the least node of its neighbourhood.  A node that is itself the least is an end; an end
that nobody hooks to takes its least neighbour instead (which hooks elsewhere, so no cycle arises).  Every tree of
hooks thus holds two nodes at least, is followed to its end by pointer doubling (the logarithm of its depth) and
becomes one node; links between different trees go on to the next round.  No number of rounds is set as a limit.

Each round's tables are written to the shared folder: lineage doesn't grow and a lost executor repeats its part only.
The neighbourhood minimum is an aggregate with a map-side part, so a node of very many links isn't one task's load;
joins on the far end of links meet a hub's rows in one key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from .common import drop_path, placed_at, scratch


def _written(df: DataFrame, name: str, count: Column | None = None) -> tuple[DataFrame, str, int]:
    """`df` written and reread, its path, and how many of its rows meet `count` (seen while writing)."""
    path, seen = scratch(df.sparkSession, name), Observation()
    df.observe(seen, F.count(F.when(F.lit(True) if count is None else count, 1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path, seen.get["n"]


def _hooks(links: DataFrame) -> tuple[DataFrame, str]:
    """links: a, b.  Result: node, to; a root points at itself."""
    spark = links.sparkSession
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near, near_path, _ = _written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")), "near")
    taken = near.filter("m < node").select(F.col("m").alias("node")).distinct().withColumn("taken", F.lit(True))
    to = F.when((F.col("m") < F.col("node")) | F.col("taken").isNull(), F.col("m")).otherwise(F.col("node"))
    hooks, path, _ = _written(near.join(taken, "node", "left").select("node", to.alias("to")), "hooks")
    drop_path(spark, near_path)
    while True:
        over = hooks.select(F.col("node").alias("to"), F.col("to").alias("next"))
        jumped = hooks.join(over, "to").select("node", F.col("to").alias("was"), F.col("next").alias("to"))
        jumped, new, moved = _written(jumped, "hooks", F.col("was") != F.col("to"))
        drop_path(spark, path)
        hooks, path = jumped.select("node", "to"), new
        if not moved:
            return hooks, path


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long).  Result: node, component (the least node that can be reached), for nodes that have edges.

    Links of a node to itself, nulls and repeated links count nothing; an empty table gives no rows.
    """
    spark = edges.sparkSession
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    links, links_path, n = _written(edges.filter("a <> b").select(*ends).distinct(), "links")
    roots, roots_path = None, None
    while n:
        hooks, hooks_path = _hooks(links)
        followed = hooks
        if roots is not None:
            moved = roots.join(hooks.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left")
            followed = moved.select("node", F.coalesce("next", "to").alias("to"))
        followed, new, _ = _written(followed, "roots")
        a, b = hooks.select(F.col("node").alias("a"), F.col("to").alias("x")), hooks.select(F.col("node").alias("b"), F.col("to").alias("y"))
        left = links.join(a, "a").join(b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        left, left_path, n = _written(left, "links")
        for path in (links_path, hooks_path, roots_path):
            if path:
                drop_path(spark, path)
        links, links_path, roots, roots_path = left, left_path, followed, new
    if roots is None:
        return placed_at(links.select(F.col("a").alias("node"), F.col("b").alias("component")), links_path)
    least = roots.groupBy("to").agg(F.min("node").alias("component"))
    out, path, _ = _written(roots.join(least, "to").select("node", "component"), "components")
    drop_path(spark, links_path)
    drop_path(spark, roots_path)
    return placed_at(out, path)
