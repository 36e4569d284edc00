"""Exact top-k by inner product with no-random-access aggregation over sorted lists.

Every block of candidates keeps one sorted list per dimension.  For a query the lists are read in step, from the
end that raises the score; each candidate has a lower bound (its seen terms, and the least possible of the rest) and
an upper bound (its seen terms, and the lists' frontiers).  A candidate goes once its upper bound is below the k-th
best lower bound of the block, or below the k-th best score of earlier blocks.  A query stops reading once at most
`resolve` of a block's candidates are left (k at least) or 14 sixteenths of the lists are read; only those left are
resolved to their scores.  What a list has shown down to a depth depends on the query only through the sign of its
component, so the bounds of a block of queries are two matrix products.  All numbers are integers in double precision,
exact below 2**53; blocks whose sums might be larger are computed in whole numbers of any size without bounds.

Work is dealt in blocks: queries and candidates are packed into blocks, query blocks meet candidate blocks on a
group number, and a task goes through its pairs ordered by query block, carrying the k best so far as thresholds.
Nothing is broadcast; memory is one pair of blocks.

Defined cases: vectors that are null or hold null or non-finite components take no part, neither do vectors whose
length is not that of their block's queries; ties go to the smaller id; with fewer than k candidates all are
returned; scores beyond 64 bits rank by their true value and are given as the least or greatest long; repeated ids are
separate candidates, none of which matches a query of the same id, and queries that share an id rank together.
"""

from __future__ import annotations

import heapq
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK, QUERY_BLOCK = 4096, 512
EXACT = 2.0**53


def _pack_blocks(size: int):
    """Rows (vec_id, dim, bytes of doubles) to blocks of one dim: dim, ids, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def block(dim: int, rows: list) -> pa.RecordBatch:
            ids, data = np.array([r[0] for r in rows], "i8"), np.stack([r[1] for r in rows])
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()]), pa.array([data.tobytes()])], names=["dim", "ids", "data"])

        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if vec_id is None or vector is None or None in vector:
                    continue
                x = np.asarray(vector, "f8")
                if not np.isfinite(x).all():
                    continue
                rows = held.setdefault(len(x), [])
                rows.append((vec_id, np.floor(256 * x)))
                if len(rows) == size:
                    yield block(len(x), held.pop(len(x)))
        for dim, rows in held.items():
            yield block(dim, rows)

    return run


class SortedLists:
    """One candidate block with its per-dimension sorted lists."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.read = self.resolved = 0  # list entries read, and candidates resolved, over all queries
        self.order = np.argsort(x, axis=0, kind="stable")  # ascending; read backwards for positive weights
        self.sorted = np.take_along_axis(x, self.order, axis=0)

    def seen(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Which terms the lists show down to a depth, read from the top and from the bottom."""
        n, dim = self.x.shape
        top, bottom = np.zeros((n, dim), bool), np.zeros((n, dim), bool)
        columns = np.arange(dim)
        top[self.order[n - depth :], columns] = True
        bottom[self.order[:depth], columns] = True
        return top, bottom

    def best(self, query_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray, resolve: float = 0.02) -> list[tuple[np.ndarray, list]]:
        """For each query ids and scores of the block's k best (those that reach the query's floor)."""
        n, _ = self.x.shape
        if np.abs(q).max(initial=0) * np.abs(self.x).max(initial=0) * q.shape[1] >= EXACT:
            return self.best_of_wide_numbers(query_ids, q, k)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        signed = np.hstack([up, down])
        low, high = self.sorted[0], self.sorted[-1]
        alive = self.ids[None, :] != query_ids[:, None]
        alive &= (up @ high + down @ low >= floor)[:, None]
        few = max(k, int(resolve * n))
        before = 0
        for depth in sorted({n * part // 16 for part in (1, 2, 4, 6, 8, 10, 12, 14)} - {0}):
            asking, left = np.flatnonzero(alive.sum(axis=1) > few), np.flatnonzero(alive.any(axis=0))
            if not len(asking):
                break
            top, bottom = self.seen(depth)
            self.read, before = self.read + len(asking) * (depth - before) * q.shape[1], depth
            front_top, front_bottom = self.sorted[n - depth], self.sorted[depth - 1]
            x, top, bottom, some = self.x[left], top[left], bottom[left], signed[asking]
            upper = some @ np.hstack([(x - front_top) * top, (x - front_bottom) * bottom]).T + (up[asking] @ front_top + down[asking] @ front_bottom)[:, None]
            lower = some @ np.hstack([(x - low) * top, (x - high) * bottom]).T + (up[asking] @ low + down[asking] @ high)[:, None]
            mine = alive[np.ix_(asking, left)]
            lower[~mine] = -np.inf
            bar = floor[asking] if len(left) <= k else np.maximum(floor[asking], np.partition(lower, len(left) - k, axis=1)[:, len(left) - k])
            alive[np.ix_(asking, left)] = mine & (upper >= bar[:, None])
        out = []
        for row, weights, own in zip(alive, q, floor, strict=True):
            at = np.flatnonzero(row)
            scores = self.x[at] @ weights
            bar = max(own, np.partition(scores, len(at) - k)[len(at) - k] if len(at) > k else -np.inf)
            at, scores = at[scores >= bar], scores[scores >= bar]
            self.resolved += len(row.nonzero()[0])
            out.append((self.ids[at], [int(s) for s in scores]))
        return out

    def best_of_wide_numbers(self, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[tuple[np.ndarray, list]]:
        """The same in whole numbers of any size, for blocks whose sums doubles can't hold exactly."""
        rows, out = [[int(v) for v in row] for row in self.x], []
        for query_id, weights in zip(query_ids, q, strict=True):
            w = [int(v) for v in weights]
            scores = [(-sum(map(operator.mul, row, w)), int(i)) for row, i in zip(rows, self.ids, strict=True) if i != query_id]
            scores = heapq.nsmallest(k, scores)
            out.append((np.array([i for _, i in scores], "i8"), [-s for s, _ in scores]))
        return out


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, best = None, {}
        lists: tuple[int, SortedLists] | None = None

        def flush() -> pa.RecordBatch:
            rows = [(q, v, min(max(s, -(1 << 63)), (1 << 63) - 1)) for q, own in best.items() for s, v in own]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for block, dim, q_ids, q_data, c_block, c_ids, c_data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != name:
                    if best:
                        yield flush()
                    name, best = block, {}
                if lists is None or lists[0] != c_block:
                    lists = (c_block, SortedLists(np.frombuffer(c_ids, "i8"), np.frombuffer(c_data, "f8").reshape(-1, dim)))
                names = np.frombuffer(q_ids, "i8")
                floor = np.array([own[-1][0] if len(own := best.get(i, ())) == k else -np.inf for i in names.tolist()])
                for query_id, (ids, scores) in zip(names.tolist(), lists[1].best(names, np.frombuffer(q_data, "f8").reshape(-1, dim), k, floor), strict=True):
                    if len(ids):
                        best[query_id] = sorted([*best.get(query_id, ()), *zip(scores, ids.tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
        if best:
            yield flush()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", groups: int | None = None) -> DataFrame:
    """The k best candidates of every query: query_id, rank, vec_id, score.

    vectors: id and vector; is_query marks the rows that are queries as well.  groups: into how many groups candidate
    blocks are dealt (by default as many as shuffle partitions, 64 at least); every query block visits each.
    """
    groups = groups or max(64, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions", "64")))
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), is_query.alias("q"))
    shape = "dim int, ids binary, data binary"
    block_id = F.xxhash64("ids")
    cands = base.select("vec_id", "v").mapInArrow(_pack_blocks(BLOCK), shape)
    cands = cands.select("dim", block_id.alias("c_block"), F.col("ids").alias("c_ids"), F.col("data").alias("c_data"))
    cands = cands.withColumn("grp", F.pmod("c_block", F.lit(groups)))
    asked = base.filter("q").select("vec_id", "v").mapInArrow(_pack_blocks(QUERY_BLOCK), shape)
    asked = asked.select("dim", block_id.alias("q_block"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("grp"))
    pairs = asked.join(cands.hint("shuffle_merge"), ["grp", "dim"]).select("q_block", "dim", "q_ids", "q_data", "c_block", "c_ids", "c_data")
    found = pairs.sortWithinPartitions("q_block", "c_block").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
