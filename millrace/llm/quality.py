"""Quality selection by importance resampling.

Two hashed n-gram models, of target text (documents labelled good) and of raw text (all documents), say in what share
of documents each n-gram occurs.  N-grams are words or runs of marks (n = 1) and, for n from 2 to 9, "a word n times in
a row", whichever word it is; general pairs are left out because their collisions with pairs of bad documents cost more
clean documents than they help to find bad ones (figures in the README).  A document's
log weight is the sum, over the n-grams in it, of log((c + a) / (e + a)),
where c target documents hold the n-gram and e would if target text were like raw text; a ratio counts only where c
and e differ by `MIN_Z` standard deviations and the ratio by `MIN_RATIO`, so that chance doesn't add up in long texts.
Documents are then drawn without replacement by Gumbel top-k: the k greatest of log weight + Gumbel noise, where the
noise comes from a hash of the id and so is the same on every attempt.  k is how many documents reach the log weight
that separates the labelled documents best; with no labels of either kind everything is kept.

Counts cover every document, in a table of fixed size (2**20 buckets).  Labels enter as a bounded, documented sample
(`max_labels`, those with the least hash of their id), which is what is broadcast, with the fixed-size ratio table.
The k-th greatest key is found by histograms over a stored table of ids and keys, never by a global sort.

Defined cases: a null or empty text has weight 0; documents that share id and text share weight and noise; ties at
the k-th key are all kept; empty tables give empty results; labels that are null or belong to no document are
ignored, of several labels for one id the least is used; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import alone, drop_path, in_parts, scratch

BUCKETS = 1 << 20
RUNS = 9  # buckets 0 to 8: the longest run of one word, from 1 to 9 or more
CHUNK = 1 << 14
MAX_LABELS = 50_000
PRIOR, MIN_Z, MIN_RATIO = 0.5, 3.0, 0.5
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_WORDS: dict[str, int] = {}
#: Words whose hashes a worker holds.
MOST_CACHED = 250_000


def forget() -> None:
    _WORDS.clear()


def token_buckets(text: str) -> np.ndarray:
    """The distinct buckets of a text's n-grams."""
    import xxhash

    words = _TOKEN.findall(text.lower())
    if len(_WORDS) > MOST_CACHED:
        _WORDS.clear()
    try:
        ids = [_WORDS[w] for w in words]
    except KeyError:
        for w in words:
            if w not in _WORDS:
                _WORDS[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        ids = [_WORDS[w] for w in words]
    h = np.array(ids, "u8")
    ends = np.flatnonzero(np.append(h[1:] != h[:-1], True)) if len(h) else np.zeros(0, "i8")
    longest = int(np.diff(ends, prepend=-1).max(initial=1))  # of a word in a row
    return np.append(np.unique(h % np.uint64(BUCKETS - RUNS)).astype("i8") + RUNS, min(longest, RUNS) - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, good) to chunks of the two tables of document counts; chunk -1 has the numbers of documents."""
    totals = np.zeros((2, BUCKETS), "i8")
    held: list[list[np.ndarray]] = [[], []]

    def settle() -> None:
        for row, parts in zip(totals, held, strict=True):
            if parts:
                row += np.bincount(np.concatenate(parts), minlength=BUCKETS)
                parts.clear()

    n, docs = 0, [0, 0]
    for batch in batches:
        for text, good in in_parts(batch):
            if not text:
                continue
            own = token_buckets(text)
            held[1].append(own)
            docs[1] += 1
            if good:
                held[0].append(own)
                docs[0] += 1
            n += len(own)
            if n > 2_000_000:
                settle()
                n = 0
    settle()
    rows = [(c, *(totals[i, c * CHUNK : (c + 1) * CHUNK].tobytes() for i in range(2))) for c in range(BUCKETS // CHUNK) if totals[1, c * CHUNK : (c + 1) * CHUNK].any()]
    rows.append((-1, *(np.array([d], "i8").tobytes() for d in docs)))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["chunk", "good", "raw"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, good, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            both = np.stack([np.frombuffer(good, "i8"), np.frombuffer(raw, "i8")])
            sums[chunk] = sums[chunk] + both if chunk in sums else both
    rows = [(c, x[0].tobytes(), x[1].tobytes()) for c, x in sums.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["chunk", "good", "raw"])


@dataclass
class Model:
    """log_ratio: of each bucket."""

    log_ratio: np.ndarray
    seed: int = 1

    def weight(self, text: str | None) -> float:
        return float(self.log_ratio[token_buckets(text)].sum()) if text else 0.0

    def noise(self, ids: np.ndarray) -> np.ndarray:
        """Gumbel noise from ids."""
        with np.errstate(over="ignore"):
            z = ids.astype("u8") + np.uint64(self.seed) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(31))
        u = ((z >> np.uint64(11)).astype("f8") + 0.5) / 2.0**53
        return -np.log(-np.log(u))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", max_labels: int = MAX_LABELS) -> DataFrame:
    """`docs` with `_good` (null without a label).  labels: doc_id, good (boolean); at most max_labels of them are used."""
    one = labels.filter("doc_id IS NOT NULL AND good IS NOT NULL").groupBy("doc_id").agg(F.min("good").alias("_good"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).withColumnRenamed("doc_id", "_label_id")
    return docs.join(F.broadcast(sample), docs[id_col] == F.col("_label_id"), "left").drop("_label_id")


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """The ratio table from all documents; docs has `_good`."""
    shape = "chunk int, good binary, raw binary"
    counted = docs.select(text_col, F.coalesce("_good", F.lit(False)).alias("good")).mapInArrow(alone(_count, "quality", forget), shape)
    good, raw, docs_good, docs_raw = np.zeros(BUCKETS, "i8"), np.zeros(BUCKETS, "i8"), 0, 0
    for r in counted.repartition("chunk").mapInArrow(alone(_merge, "quality", forget), shape).collect():  # a table of fixed size
        if r.chunk < 0:
            docs_good, docs_raw = int(np.frombuffer(r.good, "i8")[0]), int(np.frombuffer(r.raw, "i8")[0])
        else:
            good[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.good, "i8")
            raw[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.raw, "i8")
    return Model(log_ratios(good, raw, docs_good, docs_raw))


def log_ratios(good: np.ndarray, raw: np.ndarray, docs_good: int, docs_raw: int) -> np.ndarray:
    if not docs_good:
        return np.zeros(len(raw), "f4")
    share = docs_good / docs_raw
    expected = raw * share
    z = (good - expected) / np.sqrt(np.maximum(expected * (1 - share), 1e-9))
    ratio = np.log((good + PRIOR) / (expected + PRIOR))
    return np.where((np.abs(z) >= MIN_Z) & (np.abs(ratio) >= MIN_RATIO), ratio, 0).astype("f4")


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", weight: str = "log_weight", key: str = "sample_key") -> DataFrame:
    """`docs` with the log weight and the Gumbel key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(id_col).fill_null(-1).to_numpy(zero_copy_only=False)
            w = np.array([model.weight(t) for (t,) in in_parts(batch.select([text_col]))], "f8")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w), pa.array(w + model.noise(ids))], names=[*batch.schema.names, weight, key])

    kept = docs.drop(weight, key)
    return kept.mapInArrow(alone(run, "quality", forget), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{weight}` double", f"`{key}` double"]))


def separating(sample: list[tuple[float, bool]]) -> float | None:
    """The weight from which on documents count as good: greatest share of good ones kept less share of others kept.

    It is 0 at most, so that a document with nothing against it is kept.
    """
    good, n = sum(g for _, g in sample), len(sample)
    if good in (0, n):
        return None
    best, at, kept_good, kept_bad = -1.0, None, 0, 0
    ordered = sorted(sample, reverse=True)
    for i, (w, g) in enumerate(ordered):
        kept_good, kept_bad = kept_good + g, kept_bad + (not g)
        if w <= 0 and (i + 1 == n or ordered[i + 1][0] < w) and (gain := kept_good / good - kept_bad / (n - good)) > best:
            best, at = gain, (w + ordered[i + 1][0]) / 2 if i + 1 < n else w
    return 0.0 if at is None else at


def kth_greatest(keys: DataFrame, column: str, k: int, most: int = 5000, bins: int = 4096) -> float:
    """The k-th greatest value of a column (k from 1 to the row count), by histograms of ever narrower ranges."""
    lo, hi = keys.agg(F.min(column), F.max(column)).first()
    above = 0  # values over hi
    while True:
        width = (hi - lo) / bins
        inside = keys.filter((F.col(column) >= lo) & (F.col(column) <= hi))
        counts = inside.groupBy(F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).alias("b")).count().collect() if width > 0 else []
        for b, n in sorted(counts, reverse=True):
            if above + n >= k:
                break
            above += n
        else:
            return lo
        rows = inside.filter(F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)) == b)
        low, high = rows.agg(F.min(column), F.max(column)).first()
        if n <= most:
            return sorted((r[0] for r in rows.select(column).collect()), reverse=True)[k - above - 1]
        if low == high:
            return low
        lo, hi = low, high


@dataclass
class Selection:
    model: Model
    least_key: float | None  # None: everything is kept
    k: int
    scores: str  # folder of ids, weights and keys


def select(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labels: int = MAX_LABELS) -> Selection:
    """Fit the models, score every document and find the least key that is drawn."""
    spark = docs.sparkSession
    source = labelled(docs.select(F.col(id_col), F.col(text_col)), labels, id_col, max_labels)
    model = fit(source, text_col)
    path = scratch(spark, "quality-scores")
    scored(source, model, id_col, text_col).drop(text_col).write.parquet(path)
    table = spark.read.parquet(path)
    at = separating([(w, g) for w, g in table.filter("_good IS NOT NULL").select("log_weight", "_good").collect()])
    n = table.count()
    k = n if at is None else table.filter(F.col("log_weight") >= at).count()
    return Selection(model, None if k >= n else kth_greatest(table, "sample_key", k) if k else float("inf"), k, path)


def selected_ids(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents drawn: id, log_weight, sample_key."""
    s = select(docs, labels, id_col, text_col)
    table = docs.sparkSession.read.parquet(s.scores).select(id_col, "log_weight", "sample_key")
    return table if s.least_key is None else table.filter(F.col("sample_key") >= s.least_key)


def selected_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents drawn, with the columns of `docs`.  Weights are computed anew where the texts are: no join."""
    s = select(docs, labels, id_col, text_col)
    drop_path(docs.sparkSession, s.scores)
    if s.least_key is None:
        return docs
    weight, key = "_millrace_log_weight", "_millrace_sample_key"
    return scored(docs, s.model, id_col, text_col, weight, key).filter(F.col(key) >= s.least_key).drop(weight, key)
