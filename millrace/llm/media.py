"""Media columns: payloads addressed by content, in tar shards; rows carry digest, shard, offset and length.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are the samples of an 8-bit greyscale PNG
64 pixels wide.  Storing: each map task encodes the
payloads that are new to it and appends them to tar shards of its own in the shared folder, reached through its URI;
payloads are never shuffled, only their places are.  A payload is addressed by its digest: of the places that tasks
report for a digest the manifest names one, so that a text that fills a third of the table is stored once a task at
most and read once.  A shard's name holds the attempt, and only names in the committed manifest count, so a lost
executor or a speculative copy leaves at most an unreferenced file.  Reading: header-only range reads fill
the metadata columns (width, height, bits); full reads give digests and features.  Documents meet their payload by
digest; rows that repeat a text, even a third of the table, share one payload, and that join is Spark's, which
splits hot keys.

Defined cases: a null text is empty (64 zero bytes); equal texts have equal values; an empty table gives no rows;
other columns are ignored; texts of any length work, as an image's height is unbounded here.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import scratch, stored

WIDTH = 64
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33  # magic and IHDR chunk
SHARD_BYTES = 256 << 20


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """An 8-bit greyscale PNG whose samples are `payload` (a positive multiple of WIDTH bytes)."""
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), "u1")  # each row begins with filter type 0
    rows[:, 1:] = np.frombuffer(payload, "u1").reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return PNG_MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample from a file's first HEADER_BYTES."""
    if head[:8] != PNG_MAGIC or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", head[16:25])


def decode_png(media: bytes) -> bytes:
    width, height, _ = read_header(media)
    at, data = 8, []
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            data.append(media[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), "u1").reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("unexpected row filter")
    return rows[:, 1:].tobytes()


def payload_of(text: Column) -> Column:
    """UTF-8 bytes with zero bytes up to a positive multiple of WIDTH."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    pad = F.when(n == 0, F.lit(WIDTH)).otherwise((WIDTH - n % WIDTH) % WIDTH)
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), pad)))


def open_store(uri: str):
    """File system and path of a URI in the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _write(uri: str):
    """Payloads to tar shards of this task; rows say where each lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(uri)
        store.create_dir(base, recursive=True)
        tag, shard, sink, at = uuid.uuid4().hex[:12], 0, None, 0
        sent: set[bytes] = set()
        for batch in batches:
            rows = []
            for payload in batch.column(0):
                payload = payload.as_py()
                digest = hashlib.sha256(payload)
                if digest.digest()[:16] in sent:
                    continue
                if len(sent) > 1_000_000:  # it only saves space: the manifest names one place anyway
                    sent.clear()
                sent.add(digest.digest()[:16])
                if sink is None:
                    name, at = f"shard-{tag}-{shard:05d}.tar", 0
                    sink = store.open_output_stream(f"{base}/{name}")
                media = encode_png(payload)
                info = tarfile.TarInfo(f"{digest.hexdigest()}.png")
                info.size = len(media)
                head = info.tobuf(tarfile.USTAR_FORMAT)
                sink.write(head + media + b"\0" * (-len(media) % 512))
                rows.append((digest.hexdigest(), name, at + len(head), len(media)))
                at += len(head) + len(media) + -len(media) % 512
                if at >= SHARD_BYTES:
                    sink.write(b"\0" * 1024)
                    sink.close()
                    sink, shard = None, shard + 1
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["digest", "shard", "offset", "length"])
        if sink is not None:
            sink.write(b"\0" * 1024)
            sink.close()

    return run


MANIFEST = "digest string, shard string, offset long, length long"


def store_payloads(payloads: DataFrame, uri: str) -> DataFrame:
    """Write payloads into tar shards under `uri`; returns the manifest: one place (digest, shard, offset, length) a digest.

    payloads: one binary column.  The manifest is a committed table in the shared folder.
    """
    places = stored(payloads.mapInArrow(_write(uri), MANIFEST), "media-places")
    one = places.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.*")
    return one.repartition("shard").sortWithinPartitions("shard", "offset")


def read_metadata(manifest: DataFrame, uri: str) -> DataFrame:
    """Adds width, height and bits to the manifest by reading each file's header only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(uri)
        files: dict = {}
        for batch in batches:
            heads = []
            for shard, offset in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True):
                if shard not in files:
                    for f in files.values():
                        f.close()
                    files = {shard: store.open_input_file(f"{base}/{shard}")}
                heads.append(read_header(files[shard].read_at(HEADER_BYTES, offset)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array([h[i] for h in heads], pa.int32()) for i in range(3))], names=[*batch.schema.names, "width", "height", "bits"]
            )

    return manifest.mapInArrow(run, MANIFEST + ", width int, height int, bits int")


def features(payload: bytes) -> str:
    """Mean and deviation of the samples and a 16-bin histogram in shares of a thousand."""
    x = np.frombuffer(payload, "u1")
    hist = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    return f"{x.mean():.4f},{x.std():.4f}," + ".".join(map(str, hist.tolist()))


FEATURES = "digest string, width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_features(manifest: DataFrame, uri: str) -> DataFrame:
    """Reads every stored payload back, once: digests, sizes and features by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(uri)
        name, file = None, None
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            rows = []
            for digest, shard, offset, length, width, height in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length", "width", "height")), strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, store.open_input_file(f"{base}/{shard}")
                media = file.read_at(length, offset)
                payload = decode_png(media)
                rows.append((digest, width, height, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in FEATURES.split(", ")])

    return read_metadata(manifest, uri).mapInArrow(run, FEATURES)


def media_columns(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", uri: str | None = None) -> DataFrame:
    """Store every document's payload and return id, n_bytes, digest and what reading the stored bytes gave."""
    uri = uri or scratch(spark, "media")
    text = F.coalesce(F.col(text_col), F.lit(""))
    manifest = store_payloads(docs.select(payload_of(F.col(text_col)).alias("payload")), uri)
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(payload_of(F.col(text_col)), 256).alias("digest"))
    return rows.join(read_features(manifest, uri), "digest")
