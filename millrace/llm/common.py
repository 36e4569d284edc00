"""Shared helpers: scratch tables in the cluster's shared folder, table loading, stable hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: list[str] = []
#: Where scratch tables lie.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: What lets go of the caches that an operator holds in this process, by operator.
_FORGET: dict[str, Callable[[], None]] = {}
#: Fixed value: glibc's number of the size from which memory is mapped, and so goes back to the system when it is freed.
M_MMAP_THRESHOLD = -3


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session sets none and runs on one machine, as in tests, a temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="millrace-"))
    return _FALLBACK[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/millrace/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return placed_at(spark.read.schema(df.schema).parquet(path), path)


def placed_at(df: DataFrame, path: str) -> DataFrame:
    """`df`, read from the scratch table at `path`; `let_go` then knows it."""
    _PATHS[df] = path
    return df


def let_go(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove scratch tables that nothing reads any more, and the shuffle files of jobs that are done.

    Spark removes shuffle files once the driver's collector has found that nobody refers to them, and the driver, which
    does little, would seldom collect.
    """
    for df in tables:
        if path := _PATHS.pop(df, None):
            drop_path(spark, path)
    spark.sparkContext._jvm.System.gc()


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def in_parts(batch, rows: int = 256) -> Iterator[tuple]:
    """The rows of a batch, of which a part at a time becomes Python objects."""
    for lo in range(0, batch.num_rows, rows):
        yield from zip(*(c.slice(lo, rows).to_pylist() for c in batch.columns), strict=True)


def give_back() -> None:
    """Returns freed memory to the system, where the C library can; its threshold for mappings no longer grows."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(M_MMAP_THRESHOLD, 1 << 20)
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        pass


def alone(run: Callable[[Iterator], Iterator], operator: str, forget: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """`run` for Python workers, which live on from stage to stage: it begins without the caches of other operators, and
    freed memory is returned before and after.  forget: lets go of this operator's caches; a module's function."""

    def tidied(batches: Iterator) -> Iterator:
        _enter(operator, forget)
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def _enter(operator: str, forget: Callable[[], None]) -> None:
    for other in [x for x in _FORGET if x != operator]:
        _FORGET.pop(other)()
    _FORGET[operator] = forget
    give_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until `df` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name
