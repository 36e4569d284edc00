"""Exact Jaccard self-join of n-gram sets by vertical partitioning.

The global order of n-grams is that of their 64-bit hashes; it is cut into fragments twice.

A fine cut finds candidates.  Two sets of sizes s <= t with Jaccard at least P/Q differ in at most
D = (s + t) (Q - P) / (Q + P) n-grams, so of k > D fragments at least one is equal in both.  Sizes are put into
intervals such that partners lie in the same or in neighbouring intervals; an interval's cut has D + 1 fragments and
some spare ones.  A set sends a key (interval, fragment, hash of the fragment's content) for every fragment that
holds n-grams.  Where a set has so many empty fragments that the equal one might be empty, it sends the keys of a
second, independent order as well, and so on: of two sets that both lack, both go on, and of two sets one of which
doesn't, the equal fragment isn't empty.  Equal fragments are rare among texts that only share passages, because a
passage's n-grams are spread over fragments that hold others too; so no n-gram is too frequent for the join.

A coarse cut verifies.  Candidate pairs meet fragment by fragment, each fragment's overlap is counted separately,
and the counts are summed for each pair and compared with the exact threshold.  Before that a sketch sifts: of the
counts of a set's hashes in buckets the parities are kept; two sets that differ in d n-grams differ in d parities at
most, so a pair with more than D differing parities is no link.  Unlike sets differ in about half of all parities, so a
sketch has a bucket for every n-gram at least (a power of two from SKETCH_BITS on): with fewer, D passes that half and
a long set's sketch refuses nothing.  Sketches of two widths are compared in the narrower one, to which the wider folds.

Links, not pairs: equal sets are one node, and of rows of one text only that of the least id sends keys.  The nodes of a key are first compared with the key's least node, its hub,
only; what verifies becomes components.  The nodes of a hub's keys form its neighbourhood; in a neighbourhood that
still has several components the sketches of all nodes of different components are compared, block by block and in
memory, and the pairs that pass are verified.  So no link between different sets is lost, while neither copies nor
unlike nodes of a key are expanded into pairs of rows.

Skew: each batch reduces a key to one node before the shuffle; keys travel in blobs dealt by key range, in sub-ranges
that bound what a task holds.  Where they meet the key's least node is known, so what is written is the distinct pairs of
it and another node; keys themselves are only written for nodes that have others under the key in their own batch.  The
only thing broadcast is a bitmap of fixed size over node ids.

Defined cases: a null or empty text has no n-grams and links with nothing; fewer words than n make one n-gram; rows
that share an id share a component; rows with a null id get a null component; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import alone, in_parts, let_go, stored
from .components import connected_components

_WORDS: dict[bytes, int] = {}
U = np.uint64
#: Odd multipliers of the hashes.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
SEEDS = 8
COARSE = 4
SKETCH_BITS = 1024
#: Nodes and bytes of sketches that a block holds at most (one node at least).
BLOCK, BLOCK_BYTES = 2048, 1 << 20
BITMAP_BITS = 1 << 25
#: Words whose hashes a worker holds; workers live on and hold what other stages cached too.
MOST_CACHED = 200_000


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h + U(seed * MULTIPLIERS[0] & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> U(33))) * U(MULTIPLIERS[4])
        h = (h ^ (h >> U(33))) * U(MULTIPLIERS[5])
        return h ^ (h >> U(33))


def shingles(text: str | None, n: int = 4) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams of words (A-Z lower-cased, words end at ASCII white space)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "u8")
    if len(_WORDS) > MOST_CACHED:
        _WORDS.clear()
    try:
        ids = [_WORDS[w] for w in words]
    except KeyError:
        for w in words:
            if w not in _WORDS:
                _WORDS[w] = xxhash.xxh3_64_intdigest(w)
        ids = [_WORDS[w] for w in words]
    h, size = np.array(ids, "u8"), min(n, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(h) - size + 1, size, "u8")
        for i in range(size):
            total = (total + h[i : len(h) - size + 1 + i]) * U(MULTIPLIERS[i % 4])
    return np.unique(mix(total))


def forget() -> None:
    _WORDS.clear()


def fingerprint(s: np.ndarray, mixed: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set."""
    with np.errstate(over="ignore"):
        return int(mixed.sum(dtype="u8").astype("i8")), int((mixed * s | U(1)).sum(dtype="u8").astype("i8"))


def sketch(s: np.ndarray) -> bytes:
    """The parities of the counts of hashes by their last bits, in as many buckets as hashes at least."""
    bits = max(SKETCH_BITS, 1 << max(len(s) - 1, 0).bit_length())
    counts = np.bincount((s & U(bits - 1)).astype("i8"), minlength=bits)
    return np.packbits((counts & 1).astype("u1")).tobytes()


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches, rows of 64-bit words, in fewer buckets: a bucket's parity is that of its halves together."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


@lru_cache(100_000)
def interval(size: int, p: int, q: int) -> tuple[int, int, int]:
    """Number, least and greatest size of the interval that holds `size`."""
    number, low = 0, 1
    while True:
        high = max(low, low * q // p)
        if size <= high:
            return number, low, high
        number, low = number + 1, high + 1


@lru_cache(100_000)
def cut_of(high: int, p: int, q: int) -> tuple[int, int]:
    """Most differences D of partners up to size `high`, and the number of fragments."""
    most = 2 * high * (q - p) // (q + p)
    spare = int(0.02 * most + 3 * (0.02 * most) ** 0.5) + (1 if most < 4 else 2)
    return most, most + 1 + spare


def keys_of(s: np.ndarray, mixed: np.ndarray, p: int, q: int) -> np.ndarray:
    """The keys under which a set meets its candidates; mixed: mix(s, 7)."""
    number, _, high = interval(len(s), p, q)
    out = []
    for own, top in ((number, high), (number + 1, (high + 1) * q // p)):
        most, k = cut_of(max(top, high + 1) if own > number else top, p, q)
        if not most:
            continue  # partners here are equal sets
        for seed in range(SEEDS):
            h = s if not seed else np.sort(mix(s, 100 + seed))
            piece = ((h >> U(32)) * U(k)) >> U(32)
            starts = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            with np.errstate(over="ignore"):
                content = np.add.reduceat(mix(h, 7) if seed else mixed, starts)
                tag = U((own * SEEDS + seed) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                out.append(mix(content + piece[starts] * U(MULTIPLIERS[1]) + tag))
            if len(starts) > most:
                break
        else:  # never seen: lacking in every order
            empty = np.setdiff1d(np.arange(k, dtype="u8"), piece)
            with np.errstate(over="ignore"):
                out.append(mix(empty * U(MULTIPLIERS[2]) + U(own)))
    return np.concatenate(out) if out else np.zeros(0, "u8")


def planes(x: np.ndarray) -> bytes:
    """Bytes of 64-bit numbers, plane by plane, which the shuffle's compression shrinks."""
    return np.ascontiguousarray(x).view("u1").reshape(-1, 8).T.tobytes()


def unplanes(b: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, "u1").reshape(8, -1).T).view(kind).ravel()


DEALT = "bucket int, kind int, keys binary, nodes binary, hubs binary"
#: Kinds of dealt blobs and of rows: keys that still have to meet (rows: nodes under a key's least one), members already
#: under a key's node of their batch, documents, and such nodes of a batch under a key's least one.
OPEN, MEMBER, DOCUMENT, LED = 0, 1, 2, 4
MET = "kind int, key long, hub long, node long, n long"


def _least_first(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys and nodes, for each the least node of its key, and the order."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    first = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    starts, later, least = np.flatnonzero(first), np.flatnonzero(~first), nodes.copy()
    least[later] = nodes[starts[np.searchsorted(starts, later, "right") - 1]]
    return keys, nodes, least, order


def _deal(n: int, p: int, q: int, buckets: int, senders: np.ndarray):
    """senders: a bitmap of the ids whose keys are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        for batch in batches:
            keys, nodes = [np.zeros(0, "u8")], [0]
            docs: list[tuple[int, int, int, int]] = []
            missing: list[int] = []
            sends = in_bitmap(senders, batch.column(2).to_numpy())
            for own, (doc, text, _) in zip(sends, in_parts(batch), strict=True):
                s = shingles(text, n)
                mixed = mix(s, 7)
                f = fingerprint(s, mixed) if len(s) else (0, 0)
                if doc is None:
                    missing.append(len(s))
                    continue
                docs.append((doc, len(s), *f))
                if not own or not len(s) or f in seen:
                    continue
                if len(seen) > 2_000_000:  # only a saving: equal sets are one node anyway
                    seen.clear()
                seen.add(f)
                keys.append(keys_of(s, mixed, p, q))
                nodes.append(doc)
            rows = []
            if docs:
                table = np.array(docs, "i8")
                rows.append((abs(docs[0][0]) % buckets, DOCUMENT, planes(table[:, 0]), planes(table[:, 1]), planes(table[:, 2:])))
            if missing:
                rows.append((0, DOCUMENT + 1, planes(np.array(missing, "i8")), b"", b""))
            nodes = np.repeat(np.array(nodes, "i8"), [len(x) for x in keys])
            keys = np.concatenate(keys)
            k, v, hubs = _least_first(keys, nodes)[:3]
            del keys, nodes
            lead = v == hubs
            leads = ~np.append(lead, True)[1:][lead]  # whether others of the batch are under the key
            if not lead.all():
                rows.append((int(k[~lead][0] % U(buckets)), MEMBER, planes(k[~lead]), planes(v[~lead]), planes(hubs[~lead])))
            k, v, hubs = k[lead], v[lead], None
            at = ((k >> U(40)).astype("i8") * buckets) >> 24
            cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, "i8")
            ends = np.append(cuts[1:], len(at))
            for lo in range(0, max(len(cuts), 1), 1024):
                rows += [(int(at[a]), OPEN, planes(k[a:b]), planes(v[a:b]), np.packbits(leads[a:b]).tobytes()) for a, b in zip(cuts[lo : lo + 1024], ends[lo : lo + 1024], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["bucket", "kind", "keys", "nodes", "hubs"])
                rows.clear()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs by bucket to rows: (hub, node) of keys with several nodes, (key, hub, node) of those that members in a batch
    are under and of these members, and (f1, f2, doc, n) of documents."""
    names = ["kind", "key", "hub", "node", "n"]

    def rows(kind: int, k: np.ndarray | None, h: np.ndarray, v: np.ndarray, size: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(h), 100_000):
            part = [None if x is None else pa.array(x[lo : lo + 100_000]) for x in (k if k is None else k.view("i8"), h, v, size)]
            none = pa.nulls(len(part[1]), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(none), kind, "i4")), *(none if x is None else x for x in part)], names=names)

    def settle(held: list) -> Iterator[pa.RecordBatch]:
        if held:
            k, v, h, order = _least_first(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            led = np.concatenate([x[2] for x in held])[order] & (v != h)
            yield from rows(LED, k[led], h[led], v[led])
            at = np.lexsort((v, h))
            h, v = h[at], v[at]
            new = (h != v) & np.append(True, (h[1:] != h[:-1]) | (v[1:] != v[:-1]))
            yield from rows(OPEN, None, h[new], v[new])
            held.clear()

    now, held = None, []
    for batch in batches:
        for bucket, kind, keys, nodes, hubs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now:
                yield from settle(held)
                now = bucket
            if kind == MEMBER:
                yield from rows(MEMBER, unplanes(keys, "u8"), unplanes(hubs, "i8"), unplanes(nodes, "i8"))
            elif kind == DOCUMENT:
                f = unplanes(hubs, "i8").reshape(-1, 2)
                yield from rows(DOCUMENT, np.ascontiguousarray(f[:, 0]), np.ascontiguousarray(f[:, 1]), unplanes(keys, "i8"), unplanes(nodes, "i8"))
            elif kind == DOCUMENT + 1:  # documents without an id
                size = unplanes(keys, "i8")
                gone = pa.nulls(len(size), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(size), DOCUMENT, "i4")), gone, gone, gone, pa.array(size)], names=names)
            else:
                k = unplanes(keys, "u8")
                held.append((k, unplanes(nodes, "i8"), np.unpackbits(np.frombuffer(hubs, "u1"), count=len(k)).astype(bool)))
    yield from settle(held)


def id_bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size (BITMAP_BITS) in which the ids' hashes are set."""
    h = F.pmod(F.xxhash64(column), F.lit(BITMAP_BITS)) + 1
    parts = ids.select(h.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    out = np.zeros(BITMAP_BITS // 8, "u1")
    for b, bits in parts:
        out[(b - 1) * 4096 : b * 4096] = np.frombuffer(bits, "u1")
    return out


def in_bitmap(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether hash numbers (from 1) are set: Spark's bitmap buckets count from 1 and hold 32768 numbers each."""
    at = h - 1
    return (bitmap[at // 8] >> (at % 8).astype("u1")) & 1 > 0


def _fragments(n: int, bitmap: np.ndarray, sketches: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = in_bitmap(bitmap, batch.column(2).to_numpy())
            part = batch.filter(pa.array(wanted))
            for lo in range(0, part.num_rows, 256):
                out = []
                for doc, text in zip(part.column(0).slice(lo, 256).to_pylist(), part.column(1).slice(lo, 256).to_pylist(), strict=True):
                    s = shingles(text, n)
                    if sketches:
                        out.append((doc, -1, len(s), sketch(s)))
                        continue
                    cuts = np.searchsorted(s, np.arange(1, COARSE, dtype="u8") << U(64 - COARSE.bit_length() + 1))
                    out += [(doc, i, len(s), x.tobytes()) for i, x in enumerate(np.split(s, cuts)) if len(x)]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["node", "frag", "n", "grams"])

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = []
        last, left = None, None
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = x.as_buffer(), y.as_buffer()
            a, b = np.frombuffer(x, "u8"), np.frombuffer(y, "u8")
            at = np.minimum(np.searchsorted(a, b), len(a) - 1)
            counts.append(int((a[at] == b).sum()))
        cols = [batch.column(c) for c in ("a", "b", "na", "nb")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64())], names=["a", "b", "na", "nb", "partial"])


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers of differing bits between the rows of two arrays of 64-bit words, all pairs, in the narrower one's buckets."""
    words = min(x.shape[1], y.shape[1])
    x, y = folded(x, words), folded(y, words)
    out = np.zeros((len(x), len(y)), "i4")
    for w in range(x.shape[1]):
        out += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
    return out


def _sift(p: int, q: int):
    """Pairs of sketches whose parities allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            most = (na + nb) * (q - p) // (q + p)
            fits = (na * q >= nb * p) & (nb * q >= na * p)
            widths: dict[tuple[int, int], list[int]] = {}
            for i in np.flatnonzero(fits):
                widths.setdefault((len(x[i]) // 8, len(y[i]) // 8), []).append(i)
            for (wide_x, wide_y), at in widths.items():
                words = min(wide_x, wide_y)
                both = [folded(np.frombuffer(b"".join(side[i] for i in at), "u8").reshape(len(at), -1), words) for side in (x, y)]
                fits[at] = np.bitwise_count(both[0] ^ both[1]).sum(axis=1, dtype="i8") <= most[at]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(fits))

    return run


def sifted(pairs: DataFrame, sketches: DataFrame, p: int, q: int) -> DataFrame:
    left = sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("grams").alias("x"))
    right = sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", "x", "y").mapInArrow(alone(_sift(p, q), "ngrams", forget), "a long, b long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes ordered by neighbourhood and size to blocks of bounded size whose sketches have one width."""
    held: list[tuple] = []

    def block() -> pa.RecordBatch:
        table = np.array([(h[1], h[2], h[3]) for h in held], "i8")
        cols = [[held[0][0]], [held[0][3]], [held[-1][3]], [table.tobytes()], [b"".join(h[4] for h in held)]]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["area", "low", "high", "nodes", "sketches"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("area", "node", "c", "n", "grams")), strict=True):
            if held and (held[0][0] != row[0] or len(held[0][4]) != len(row[4]) or len(held) >= min(BLOCK, max(BLOCK_BYTES // len(row[4]), 1))):
                yield block()
                held.clear()
            held.append(row)
    if held:
        yield block()


def _across(p: int, q: int):
    """Pairs of blocks to the pairs of nodes of different components that sizes and sketches allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, nodes_x, sketch_x, nodes_y, sketch_y in zip(*(batch.column(c).to_pylist() for c in ("same", "nodes_x", "sketches_x", "nodes_y", "sketches_y")), strict=True):
                x, y = np.frombuffer(nodes_x, "i8").reshape(-1, 3), np.frombuffer(nodes_y, "i8").reshape(-1, 3)
                sx, sy = np.frombuffer(sketch_x, "u8").reshape(len(x), -1), np.frombuffer(sketch_y, "u8").reshape(len(y), -1)
                for lo in range(0, len(x), 256):  # bounded memory
                    part = x[lo : lo + 256]
                    a_n, b_n = part[:, None, 2], y[None, :, 2]
                    fits = (part[:, None, 1] != y[None, :, 1]) & (a_n * q >= b_n * p) & (b_n * q >= a_n * p)
                    if same:
                        fits &= np.arange(lo, lo + len(part))[:, None] < np.arange(len(y))[None, :]
                    if not fits.any():
                        continue
                    fits &= _differ(sx[lo : lo + 256], sy) <= (a_n + b_n) * (q - p) // (q + p)
                    i, j = np.nonzero(fits)
                    if len(i):
                        a, b = part[i, 0], y[j, 0]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def pairs_across(nodes: DataFrame, p: int, q: int) -> DataFrame:
    """nodes: area, node, c (component), n, grams (sketch).  Pairs (a, b) in one area, across components, that may link.

    Blocks meet blocks, so a large area is spread over tasks, and only blocks whose sizes can match meet.
    """
    parts = nodes.select("area", "node", "c", "n", "grams").repartitionByRange("area", "n").sortWithinPartitions("area", "n", "node")
    made = parts.mapInArrow(alone(_blocks, "ngrams", forget), "area long, low long, high long, nodes binary, sketches binary")
    blocks = stored(made.withColumn("block", F.xxhash64("nodes")), "ngram-blocks")
    x = blocks.select("area", *(F.col(c).alias(f"{c}_x") for c in ("block", "low", "high", "nodes", "sketches")))
    y = blocks.select("area", *(F.col(c).alias(f"{c}_y") for c in ("block", "low", "high", "nodes", "sketches")))
    met = x.join(y, "area").filter((F.col("block_x") <= F.col("block_y")) & (F.col("low_x") * p <= F.col("high_y") * q) & (F.col("low_y") * p <= F.col("high_x") * q))
    return met.select((F.col("block_x") == F.col("block_y")).alias("same"), "nodes_x", "sketches_x", "nodes_y", "sketches_y").mapInArrow(alone(_across(p, q), "ngrams", forget), "a long, b long")


def verify(pairs: DataFrame, fragments: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b) whose sets reach Jaccard p/q, by partial overlaps of the coarse fragments."""
    left = fragments.select(F.col("node").alias("a"), "frag", F.col("n").alias("na"), F.col("grams").alias("x"))
    right = fragments.select(F.col("node").alias("b"), "frag", F.col("n").alias("nb"), F.col("grams").alias("y"))
    # the side that varies is fetched first; the key's least node, which many pairs share, comes last
    met = pairs.join(right, "b").join(left, ["a", "frag"]).filter((F.col("na") * q >= F.col("nb") * p) & (F.col("nb") * q >= F.col("na") * p))
    partial = met.select("a", "b", "na", "nb", "x", "y").mapInArrow(alone(_overlaps, "ngrams", forget), "a long, b long, na long, nb long, partial long")
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("partial").alias("both"))
    return summed.filter(F.col("both") * q >= (F.col("na") + F.col("nb") - F.col("both")) * p).select("a", "b")


def jaccard_components(
    docs: DataFrame, n: int = 4, threshold: tuple[int, int] = (85, 100), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a document: id, n_shingles, component_id (the least id that links reach, itself included)."""
    spark: SparkSession = docs.sparkSession
    p, q = threshold
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = source.select("doc_id", "text", (F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_BITS)) + 1).alias("h"))
    texts = source.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"))
    senders = id_bitmap(texts.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")), "doc_id")  # it may hold others: they send keys too
    dealt = hashed.mapInArrow(alone(_deal(n, p, q, buckets, senders), "ngrams", forget), DEALT).repartition("bucket").sortWithinPartitions("bucket")
    both = stored(dealt.mapInArrow(alone(_meet, "ngrams", forget), MET), "ngram-met")
    let_go(spark)  # the dealt keys
    sets = both.filter(F.col("kind") == DOCUMENT).select(F.col("node").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("key").alias("f1"), F.col("hub").alias("f2"))
    reps = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    named = sets.join(reps, ["n_shingles", "f1", "f2"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    rep_of = named.filter("n_shingles > 0 AND rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("rep"))

    tops = both.filter(F.col("kind") == LED).select("key", F.col("node").alias("hub"), F.col("hub").alias("top"))
    members = both.filter(F.col("kind") == MEMBER).join(tops, ["key", "hub"], "left")  # batches give their own hubs first
    met = both.filter(F.col("kind") == OPEN).select("hub", "node").union(members.select(F.coalesce("top", "hub"), "node")).distinct()
    met = met.join(rep_of.select(F.col("doc_id").alias("node"), F.col("rep").alias("rn")), "node").join(rep_of.select(F.col("doc_id").alias("hub"), F.col("rep").alias("rh")), "hub")
    leaves = stored(met.filter("rn <> rh").select(F.col("rh").alias("area"), F.col("rn").alias("node")).distinct(), "ngram-stars")
    stars = leaves.select(F.least("area", "node").alias("a"), F.greatest("area", "node").alias("b")).distinct()
    known = hashed.filter("doc_id IS NOT NULL")

    def pieces(pairs: DataFrame, sketches: bool) -> DataFrame:
        """Sketches or fragments of the pairs' nodes, made where the texts are read; a bitmap picks them."""
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        made = known.mapInArrow(alone(_fragments(n, id_bitmap(nodes, "node"), sketches), "ngrams", forget), "node long, frag int, n long, grams binary")
        return made.dropDuplicates(["node", "frag"])  # rows may repeat an id

    sketches = stored(pieces(stars, True), "ngram-sketches")
    near = stored(sifted(stars, sketches, p, q), "ngram-near")
    links = stored(verify(near, pieces(near, False), p, q), "ngram-links")
    parts = connected_components(links)

    # neighbourhoods that are still in several components: all pairs across components, by sketches, then exactly; the
    # hub has been compared with all others
    placed = leaves.join(parts, "node", "left").select("area", "node", F.coalesce("component", "node").alias("c"))
    apart = placed.groupBy("area").agg((F.min("c") < F.max("c")).alias("apart")).filter("apart").select("area")
    open_nodes = placed.join(apart, "area", "left_semi").join(sketches.select("node", "n", "grams"), "node")
    across = stored(pairs_across(open_nodes, p, q).distinct().join(stars, ["a", "b"], "left_anti"), "ngram-near")
    let_go(spark, sketches)
    more = stored(verify(across, pieces(across, False), p, q), "ngram-links")
    if more.limit(1).count():
        parts = connected_components(links.union(more))
    own = named.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    own = own.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    return own.withColumnRenamed("doc_id", id_col)
