"""Row pattern matching: a regular expression over classified rows of each partition.

Rows are classified by SQL conditions on the JVM (window functions give PREV and NEXT) and arrive sorted, many partitions
in a batch; each row becomes one letter, each partition one line, and a compiled pattern runs over all lines of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType


def match_recognize(df: DataFrame, partition: list[str], order: list[str], define: dict[str, str], pattern: str, skip_past: bool = True, columns: set[str] | None = None) -> DataFrame:
    """All rows of all matches, with `match_number` (from 1 in a partition), `match_row` (from 1 in a match) and `classifier`.

    define: variable -> SQL condition over the row; `prev_<c>` and `next_<c>` may be used for any column c.  A row takes
    the first variable in the pattern whose condition holds at its place; variables without a definition match any row.
    columns: those to return, in lower case, besides the partition's; all if None.
    """
    by = f"PARTITION BY {', '.join(f'`{c}`' for c in partition)} " if partition else ""
    over = f"OVER ({by}ORDER BY {', '.join(f'`{c}` ASC NULLS LAST' for c in order)})"
    names = list(dict.fromkeys(re.findall(r"[A-Za-z_]\w*", pattern)))
    letters = {v: chr(ord("A") + i) for i, v in enumerate(names)}
    text = " ".join(define.values())
    shifted = df.select("*", *(F.expr(f"{f}(`{c}`) {over}").alias(f"{p}_{c}") for c in df.columns for p, f in (("prev", "lag"), ("next", "lead")) if f"{p}_{c}" in text), F.expr(f"row_number() {over} = 1").alias("_first"))
    mask = " + ".join(f"CASE WHEN {define[v]} THEN {1 << i}L ELSE 0L END" if v in define else f"{1 << i}L" for i, v in enumerate(names))
    returned = [f for f in df.schema.fields if columns is None or f.name.lower() in columns | {c.lower() for c in partition}]
    width = len(returned)
    # the window has dealt rows by partition and sorted them: the tasks below read them as they come
    marked = shifted.select(*(f"`{f.name}`" for f in returned), "_first", F.expr(mask).alias("_mask"))
    # each variable is a class of the letters of the sets of variables that a row can be
    regex = re.sub(r"[A-Za-z_]\w*", lambda m: f"(?:@{letters[m[0]]})", pattern)
    regex = re.sub(r"\s+", "", regex)
    for i, v in enumerate(names):
        cls = "[" + "".join(chr(0x10000 + m) for m in range(1 << len(names)) if m >> i & 1) + "]"
        regex = regex.replace(f"(?:@{letters[v]})", f"(?:{cls})")

    def spans(symbols: str) -> list[tuple[int, int]]:
        """Start and end of every match that has rows; a match never leaves its line."""
        rx = re.compile(regex, re.MULTILINE)
        if skip_past and rx.match("") is None:  # no match is empty
            return [m.span() for m in rx.finditer(symbols)]
        out, at = [], 0
        while at < len(symbols) and (m := rx.search(symbols, at)):
            if m.end() > m.start():
                out.append(m.span())
            at = m.end() if skip_past and m.end() > m.start() else m.start() + 1
        return out

    def matched(rows: pa.Table) -> pa.RecordBatch | None:
        """The matches in rows of whole partitions."""
        first, masks = rows.column(width).to_numpy(), rows.column(width + 1).to_numpy()
        group = np.cumsum(first) - 1
        # a line end before each partition but the first shifts its rows' places
        place = np.arange(len(masks)) + group
        codes = np.full(place[-1] + 1, ord("\n"), dtype="<u4")
        codes[place] = masks + 0x10000
        found = np.array(spans(codes.tobytes().decode("utf-32-le")), dtype="int64").reshape(-1, 2)
        if not len(found):
            return None
        start = np.searchsorted(place, found[:, 0])
        size = found[:, 1] - found[:, 0]
        own = group[start]
        number = np.arange(len(own)) - np.searchsorted(own, own) + 1
        row = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        taken = np.repeat(start, size) + row
        label = np.array([next((v for i, v in enumerate(names) if m >> i & 1), None) for m in range(1 << len(names))], dtype=object)
        columns = [*rows.select(range(width)).take(pa.array(taken)).columns, pa.array(np.repeat(number, size)), pa.array(row + 1), pa.array(label[masks[taken]], pa.string())]
        return pa.Table.from_arrays(columns, names=[*rows.column_names[:width], "match_number", "match_row", "classifier"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last partition, which may go on
        for batch in batches:
            starts = np.flatnonzero(batch.column(width).to_numpy(zero_copy_only=False))
            if len(starts) and (held or starts[-1]):
                out = matched(pa.Table.from_batches([*held, batch.slice(0, starts[-1])]))
                held = []
                if out is not None:
                    yield from out.to_batches()
            if batch.num_rows:
                held.append(batch.slice(starts[-1]) if len(starts) else batch)
        if held and (out := matched(pa.Table.from_batches(held))) is not None:
            yield from out.to_batches()

    schema = StructType([*returned, StructField("match_number", LongType()), StructField("match_row", LongType()), StructField("classifier", StringType())])
    # a partition is in memory as a whole: patterns may reach over all of its rows
    return marked.mapInArrow(run, schema)
