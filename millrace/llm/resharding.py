"""Resharding by minimum-cost flow.

Documents lie in old shards; the new shards have capacities of rows that differ by one at most (law `rows`).  Each
old shard is cut into blocks of rows ordered by size.  A flow network carries blocks to new shards: staying costs
nothing, moving a row costs its block's mean bytes, so the solution fills the capacities with the fewest bytes moved,
and it is the small rows that move.  The flow becomes cut points in each shard's order; a row finds its new shard by
comparing its own sort key with its shard's cut points, so moving needs no join.  Affected shards are then rewritten
with one shuffle; a row's slot is its file's base plus its row number in the file.

What reaches the driver: one row for each sort partition, block and cut, never a document.  A shard's order comes from
a range-partitioned sort of narrow rows (id, size, checksum), which splits a hot key over partitions.

Defined cases: a null text counts as empty (size 8); a null id sorts first; repeated rows each keep a place of their
own (told apart by their position in the input); fewer rows than shards leave shards empty; an empty table gives no
rows; other columns are carried along unchanged.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import scratch, stored

KEY = ("_size", "_id", "_crc", "_at")


class MinCostFlow:
    """Successive shortest augmenting paths; integer capacities and costs."""

    def __init__(self, n: int) -> None:
        self.n, self.to, self.cap, self.cost = n, [], [], []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def arc(self, a: int, b: int, cap: int, cost: float) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def solve(self, source: int, sink: int) -> tuple[int, float]:
        """Flow and cost of a cheapest maximum flow."""
        flow, total = 0, 0.0
        while True:
            dist, via = [float("inf")] * self.n, [-1] * self.n
            dist[source], queue, queued = 0.0, deque([source]), [False] * self.n
            while queue:
                a = queue.popleft()
                queued[a] = False
                for e in self.out[a]:
                    b = self.to[e]
                    if self.cap[e] > 0 and dist[a] + self.cost[e] < dist[b] - 1e-9:
                        dist[b], via[b] = dist[a] + self.cost[e], e
                        if not queued[b]:
                            queued[b] = True
                            queue.append(b)
            if via[sink] < 0:
                return flow, total
            path, b = [], sink
            while b != source:
                path.append(via[b])
                b = self.to[via[b] ^ 1]
            push = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= push
                self.cap[e ^ 1] += push
            flow, total = flow + push, total + push * dist[sink]


def plan_transfers(blocks: list[tuple[int, int, int, int]], new_shards: int) -> list[tuple[int, int, int, int]]:
    """blocks: (old shard, first rank, rows, bytes), by shard and rank.  Result: (old shard, first rank, rows, new shard).

    New shard j continues old shard j.  The odd rows of the total go to the shards that hold most now.
    """
    total = sum(b[2] for b in blocks)
    held = [sum(b[2] for b in blocks if b[0] == j) for j in range(new_shards)]
    capacity = [total // new_shards] * new_shards
    for j in sorted(range(new_shards), key=lambda j: (-held[j], j))[: total % new_shards]:
        capacity[j] += 1
    net = MinCostFlow(len(blocks) + new_shards + 2)
    source, sink = len(blocks) + new_shards, len(blocks) + new_shards + 1
    arcs = []
    for i, (old, _, rows, size) in enumerate(blocks):
        net.arc(source, i, rows, 0)
        arcs.append([net.arc(i, len(blocks) + j, rows, 0 if j == old else size / max(rows, 1)) for j in range(new_shards)])
    for j in range(new_shards):
        net.arc(len(blocks) + j, sink, capacity[j], 0)
    net.solve(source, sink)
    out = []
    for (old, first, _, _), own in zip(blocks, arcs, strict=True):
        for j in sorted(range(new_shards), key=lambda j: (j == old, j)):  # the smaller rows of a block move
            if moved := net.cap[own[j] ^ 1]:
                out.append((old, first, moved, j))
                first += moved
    return out


def keyed(docs: DataFrame, old_shard: Column, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        "*", old_shard.cast("int").alias("_old"), (F.octet_length(text) + 8).cast("long").alias("_size"), F.col(id_col).cast("long").alias("_id"),
        F.crc32(F.encode(text, "UTF-8")).alias("_crc"), F.monotonically_increasing_id().alias("_at"),
    )


def new_shard_column(spark: SparkSession, rows: DataFrame, new_shards: int, blocks: int) -> tuple[Column | None, list]:
    """The new shard as an expression over the columns of `keyed`, and the transfers."""
    narrow = rows.select("_old", *KEY)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = narrow.repartitionByRange(parts, "_old", *KEY).sortWithinPartitions("_old", *KEY)
    order = order.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_pos"))
    order = stored(order, "reshard-order")
    runs = sorted(order.groupBy("_old", "_part").agg(F.count("*").alias("n"), F.min("_pos").alias("first")).collect())
    if not runs:
        return None, []
    held, bases = {}, []
    for old, part, n, first in runs:  # partitions are ranges: the lower number holds the lower ranks
        bases.append((old, part, held.get(old, 0) - first))
        held[old] = held.get(old, 0) + n
    base = spark.createDataFrame(bases, "_old int, _part int, _base long")  # a row a partition or shard: small by construction
    sizes = spark.createDataFrame(sorted(held.items()), "_old int, _rows long")
    ranked = order.join(F.broadcast(base), ["_old", "_part"]).withColumn("_rank", F.col("_pos") + F.col("_base"))
    block = F.floor(F.col("_rank") * blocks / F.col("_rows")).cast("int")
    stats = ranked.join(F.broadcast(sizes), "_old").groupBy("_old", block.alias("_block")).agg(F.min("_rank").alias("first"), F.count("*").alias("n"), F.sum("_size").alias("bytes"))
    transfers = plan_transfers([(r["_old"], r["first"], r["n"], r["bytes"]) for r in sorted(stats.collect())], new_shards)
    cuts = spark.createDataFrame([(old, first) for old, first, _, _ in transfers if first], "_old int, _rank long")
    keys = {(r["_old"], r["_rank"]): r for r in ranked.join(F.broadcast(cuts), ["_old", "_rank"]).collect()}
    shard = F.lit(None).cast("int")
    for old in sorted(held, reverse=True):
        own = sorted(t for t in transfers if t[0] == old)
        chain = F.lit(own[0][3])
        for _, first, _, j in own[1:]:
            chain = F.when(at_least(keys[old, first]), F.lit(j)).otherwise(chain)
        shard = F.when(F.col("_old") == old, chain).otherwise(shard)
    return shard, transfers


def at_least(row) -> Column:
    """Whether a row's sort key reaches that of `row` (nulls first)."""

    def beyond(name: str, last: bool) -> Column:
        value, own = row[name], F.col(name)
        if value is None:
            return F.lit(True) if last else own.isNotNull()
        return F.coalesce(own >= value if last else own > value, F.lit(False))

    out = beyond(KEY[-1], True)
    for name in reversed(KEY[:-1]):
        out = beyond(name, False) | (F.col(name).eqNullSafe(F.lit(row[name])) & out)
    return out


def reshard(
    docs: DataFrame, old_shard: Column, new_shards: int, uri: str | None = None, id_col: str = "doc_id", text_col: str = "text", blocks: int = 8, all_files: bool = True
) -> tuple[str, list[tuple[int, int, int, int]]]:
    """Move documents from old to new shards; returns the folder written and the transfers.

    The folder has one sub-folder a shard (`shard=j`).  Without all_files only affected shards are written: those
    that gain or lose rows; the others' old files stay as they are.
    """
    spark = docs.sparkSession
    uri = uri or scratch(spark, "shards")
    rows = keyed(docs, old_shard, id_col, text_col)
    shard, transfers = new_shard_column(spark, rows, new_shards, blocks)
    placed = rows.withColumn("shard", F.lit(0) if shard is None else shard)
    if not all_files:
        moved = {x for old, _, _, j in transfers if j != old for x in (old, j)}
        placed = placed.filter(F.col("shard").isin(sorted(moved)))
    drop = [c for c in ("_old", *KEY) if c not in docs.columns]
    placed.drop(*drop).hint("rebalance", F.col("shard")).write.partitionBy("shard").parquet(uri)
    return uri, transfers


def read_shards(spark: SparkSession, uri: str, schema: StructType, columns: list[Column]) -> DataFrame:
    """Columns of the written shards' rows with `shard` and `slot` (gapless from 0 in each shard).

    The columns are computed where the files are read, so that only they meet the files' bases, and texts aren't moved.
    """
    rows = spark.read.schema(StructType([*schema.fields, StructField("shard", IntegerType())])).parquet(uri)
    rows = rows.select(*columns, "shard", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = spark.read.schema("shard int").parquet(uri).select("shard", F.col("_metadata.file_path").alias("_file"))
    counts = files.groupBy("shard", "_file").agg(F.count("*").alias("_n"))
    base = counts.select("_file", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_file")) - F.col("_n")).alias("_first"))
    return rows.join(base, "_file").withColumn("slot", F.col("_first") + F.col("_row")).drop("_file", "_row", "_first")
