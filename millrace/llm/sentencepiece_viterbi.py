"""SentencePiece encoding by streaming Viterbi, and decoding.

The model file's pieces and scores define a unigram lattice: the encoding is the segmentation of greatest total score
(ties: the piece that begins earliest), unknown characters fall back to byte pieces at `least score - 10`.  The file
used here was made for merges; its scores are taken as they stand, so ids equal those of the library when it is told
that the model is a unigram model (tests do that), not those of its merge mode.

Streaming: the decoder keeps scores for the last `longest piece` boundaries only.  When the back pointers of every
boundary that can still be extended meet in one boundary, the ids up to it are final and are committed.  Two
characters that stand side by side in no piece are such a boundary whatever follows, so text is cut there first and
short stretches are remembered in a bounded cache.

Defined cases: a null or empty text has no ids and decodes to the empty text; texts of any length are handled with
the same window; repeated rows are encoded one by one; U+2581 in a text decodes to a space, as in the library; an empty
table gives no rows; other columns pass through.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SPACE = "▁"
UNK_PENALTY = 10.0
CACHE_STRETCHES = 300_000
CACHE_CHARS = 64
_STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_MODELS: dict[str, UnigramModel] = {}


class UnigramModel:
    """Pieces, scores and byte pieces of a SentencePiece model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes: dict[int, int] = {}
        self.surface: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                self.surface.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.surface.append(b"")
            else:
                self.pieces[piece] = (i, sp.get_score(i))
                self.surface.append(piece.replace(SPACE, " ").encode())
        self.unk_score = min(s for _, s in self.pieces.values()) - UNK_PENALTY
        self.longest = max(map(len, self.pieces))
        self.trie: dict = {}
        for piece, leaf in self.pieces.items():
            node = self.trie
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = leaf
        self.joined = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.crossing = any(pair[1] == SPACE != pair[0] for pair in self.joined)
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def unknown(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        cache = self.cache
        stretches = _STRETCH.findall(SPACE + text.replace(" ", SPACE))
        if self.crossing and any(x[-1] + SPACE in self.joined for x in stretches[:-1]):  # a piece can cross a word's start
            stretches = [SPACE + text.replace(" ", SPACE)]
        out = []
        for x in stretches:
            ids = cache.get(x)
            if ids is None:
                ids = self.old.get(x) or self.stretch(x)
                if len(x) <= CACHE_CHARS:
                    cache[x] = ids
            out.append(ids)
        if len(cache) >= CACHE_STRETCHES:  # two generations: what was used since the last turn stays
            self.old, self.cache = cache, {}
        return b"".join(out)

    def stretch(self, text: str) -> bytes:
        cache, out = self.cache, []
        for part in self.parts(text):
            ids = cache.get(part) or self.old.get(part)
            if ids is None:
                ids = array("I", self.viterbi(part)).tobytes()
                if len(part) <= CACHE_CHARS:
                    cache[part] = ids
            out.append(ids)
        return b"".join(out)

    def parts(self, stretch: str) -> Iterator[str]:
        """Cut where no piece joins the two characters."""
        start = 0
        for i in range(1, len(stretch)):
            if stretch[i - 1 : i + 1] not in self.joined:
                yield stretch[start:i]
                start = i
        yield stretch[start:]

    def viterbi(self, text: str) -> Iterator[int]:
        """The streaming decoder: yields ids as soon as they are final.

        `score` holds the boundaries that can still be extended, `back` those since the last commit.
        """
        trie, longest, n = self.trie, self.longest, len(text)
        score, back = {0: 0.0}, {}
        done = 0
        for at in range(n):
            base, node, end, alone = score.pop(at), trie, at, False
            for char in text[at : at + longest]:
                node = node.get(char)
                if node is None:
                    break
                end += 1
                leaf = node.get("")
                if leaf is not None:
                    alone = alone or end == at + 1
                    total = base + leaf[1]
                    if total > score.get(end, -inf):
                        score[end], back[end] = total, (at, leaf[0])
            if not alone and base + self.unk_score > score.get(at + 1, -inf):
                score[at + 1], back[at + 1] = base + self.unk_score, (at, -1)
            if len(score) == 1 and at + 1 < n:
                meet = at + 1  # one boundary survives: everything converges on it
            elif at + 1 == n or len(back) >= 2 * longest:
                ends = set(score) if at + 1 < n else {n}
                while len(ends) > 1:  # walk the latest end back until all meet
                    last = max(ends)
                    ends.discard(last)
                    ends.add(back[last][0] if last > done else done)
                meet = ends.pop()
            else:
                continue
            path, b = [], meet
            while b > done:
                begin, i = back.pop(b)
                path.append(self.unknown(text[begin:b]) if i < 0 else (i,))
                b = begin
            for ids in reversed(path):
                yield from ids
            if meet > done:
                back = {e: v for e, v in back.items() if e > meet}
                done = meet

    def decode(self, ids: bytes) -> str:
        surface = self.surface
        text = b"".join([surface[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "surrogatepass")
        return text[1:] if text.startswith(" ") else text


def model(path: str) -> UnigramModel:
    """One model, with its cache, for each worker process."""
    if path not in _MODELS:
        _MODELS[path] = UnigramModel(path)
    return _MODELS[path]


def _mapped(df: DataFrame, column: str, new: str, kind: str, make) -> DataFrame:
    """`df` with a column computed batch by batch from another, in small slices so that batches stay bounded."""
    arrow = {"binary": pa.binary(), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(make(part.column(column).to_pylist()), arrow)], names=[*part.schema.names, new])

    kept = df.drop(new)
    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{new}` {kind}"]))


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """`docs` with a column `ids` (little-endian unsigned 32-bit)."""
    return _mapped(docs, text_col, "ids", "binary", lambda texts: [model(path).encode(t or "") for t in texts])


def decode(docs: DataFrame, path: str, new: str = "decoded") -> DataFrame:
    """`docs` with the text that the column `ids` stands for."""
    return _mapped(docs, "ids", new, "string", lambda many: [model(path).decode(x or b"") for x in many])


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode: n_ids, ids_crc32, decoded_sha256 and whether the text came back."""
    both = decode(encode(docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")), path), path)
    return both.select(
        id_col, F.length("text").cast("long").alias("n_chars"), (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"),
    )
