"""Best-fit packing of tokenised documents into fixed-length sequences.

Two steps.  Tokenising is a map over the documents: each Arrow batch becomes piece rows (lengths and checksums, no
ids unless asked for).  A document's ids are followed by one end id; only documents longer than a sequence are cut,
into full pieces, the first of which takes the odd remainder.  Packing then reads those narrow rows only: Spark
rebalances them into partitions of a target size, and each task runs a bounded-space online best fit over its
stream.  A fixed number of bins is open; a bitset (one Python integer) has bit f set when some open bin has f free
places, so the tightest bin that takes a piece is found by shifting and isolating the lowest set bit.  When a new
bin is needed and all are open, the fullest closes first.  A task looks at one batch at a time, longest piece first.

Memory: one batch of texts, the word cache (bounded) and the open bins.  Skew: pieces are dealt by a hash of
document and piece number, so neither a hot source nor a group of copies gathers in one task.

Defined cases: a null text counts as empty; an empty document is one piece holding just the end id; repeated rows
are packed one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import alone

#: Characters that some regex engine may call white space though Python doesn't.
_ODD_SPACE = "\u180e\u200b\ufeff"
CACHE_WORDS = 250_000
#: Fixed value: the pre-tokenizer's pattern.
PIECE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def doubled_space(text: str) -> bool:
    """Whether white space may stand beside white space."""
    core = text.strip()
    return (
        len(" ".join(core.split())) != len(core)
        or text[:2].isspace() and len(text) > 1
        or text[-2:].isspace() and len(text) > 1
        or not text.isascii() and any(c in text for c in _ODD_SPACE)
    )


class ChunkIds(dict):
    """Ids of a space and a chunk, by chunk; new chunks are encoded when they are asked for."""

    def __init__(self, encode: Callable[[str], list[int]], old: dict[str, bytes]) -> None:
        self.encode, self.old = encode, old

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = array("I", self.encode(" " + chunk)).tobytes()
        self[chunk] = ids
        return ids


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters stand for
    themselves, the other bytes in order for the characters from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordCachedTokenizer:
    """The ids that `tokenizers` gives for a byte-level BPE file, with a bounded cache over space-delimited chunks.

    The pre-tokenizer never lets a piece run across a space that follows a non-space, so a text without doubled
    white space can be cut before every space and each chunk encoded once.  Chunks are merged by `tiktoken` from the
    file's own vocabulary, whose ids are in merge order, at a fifth of the cost; texts that can't be cut go through
    `tokenizers` whole, as do texts that hold an added token such as ``<|endoftext|>``.  Tests hold the two equal.  The cache keeps two generations.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        byte = byte_of_char()
        ranks = {bytes(map(byte.__getitem__, piece)): i for piece, i in self.tok.get_vocab(with_added_tokens=False).items() if set(piece) <= byte.keys() and not piece.startswith("<|")}
        self.merge = tiktoken.Encoding("own", pat_str=PIECE, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.chunks = ChunkIds(self.merge, {})

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        if len(self.chunks) > CACHE_WORDS:
            self.chunks.old = {}
            self.chunks = ChunkIds(self.merge, self.chunks)
        ids, out = self.chunks.__getitem__, []
        for text in texts:
            if doubled_space(text) or any(t in text for t in self.added):
                out.append(array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes())
            else:
                head, *rest = text.split(" ")
                out.append(array("I", self.merge(head)).tobytes() + b"".join(map(ids, rest)))
        return out


_TOKENIZERS: dict[str, WordCachedTokenizer] = {}


def tokenizer(path: str) -> WordCachedTokenizer:
    """One tokenizer, with its caches, for each worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordCachedTokenizer(path)
    return _TOKENIZERS[path]


def forget() -> None:
    _TOKENIZERS.clear()


def cut(n: int, seq_len: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document with n ids."""
    if n <= seq_len:
        return [(0, n)]
    first = n % seq_len
    return ([(0, first)] if first else []) + [(s, seq_len) for s in range(first, n, seq_len)]


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def tokenize_pieces(make: Callable[[], WordCachedTokenizer], seq_len: int, end_id: int, keep_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = make()
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out: list[list] = [[] for _ in range(5 + keep_ids)]
                texts = [x or "" for x in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), tok.encode(texts), strict=True):
                    data = ids + end
                    for k, (start, length) in enumerate(cut(len(data) // 4, seq_len)):
                        own = data[4 * start : 4 * (start + length)]
                        for column, value in zip(out, (doc, k, start, length, zlib.crc32(own), own), strict=False):
                            column.append(value)
                schema = PIECES.append(pa.field("ids", pa.binary())) if keep_ids else PIECES
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


class BestFit:
    """Bounded-space best fit: at most `most` open bins, found through a bitset keyed by free space."""

    def __init__(self, size: int, most: int, first_id: int = 0) -> None:
        self.size, self.most, self.next_id = size, most, first_id
        self.bits, self.open = 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece of `length`, 1 <= length <= size."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            own = self.by_free[free]
            name = own.pop()
            if not own:
                self.bits ^= 1 << free
            self.open -= 1
        else:
            free, name = self.size, self.next_id
            self.next_id += 1
        left = free - length
        if left:
            if self.open >= self.most:  # the fullest closes: the lowest set bit
                least = (self.bits & -self.bits).bit_length() - 1
                if least >= left:
                    return name, self.size - free  # the bin at hand is the fullest itself
                self.by_free[least].pop()
                if not self.by_free[least]:
                    self.bits ^= 1 << least
                self.open -= 1
            self.by_free[left].append(name)
            self.bits |= 1 << left
            self.open += 1
        return name, self.size - free


def pack_stream(seq_len: int, open_bins: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fit = BestFit(seq_len, open_bins, part << 40)
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            bins, offsets = np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8")
            for i in np.argsort(-lengths, kind="stable").tolist():
                bins[i], offsets[i] = fit.place(int(lengths[i]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins), pa.array(offsets)], names=[*batch.schema.names, "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame, vocab: str, seq_len: int = 2048, end_id: int = 0, open_bins: int = 1024, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Pack documents: one row a piece with doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, little-endian
    unsigned 32-bit, with keep_ids)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    run = alone(tokenize_pieces(lambda: tokenizer(vocab), seq_len, end_id, keep_ids), "packing", forget)
    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    dealt = pieces.hint("rebalance", F.col("doc_id"), F.col("piece"))
    return dealt.mapInArrow(alone(pack_stream(seq_len, open_bins), "packing", forget), schema + ", sequence_id long, offset long")
