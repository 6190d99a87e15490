"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")

_UPPER = bytes(range(65, 91))
_LOWER_TABLE = bytes.maketrans(_UPPER, _UPPER.lower())

#: Texts that a Python stage holds at once, in characters; a longer text is alone in its slice.
SLICE_CHARS = 4_000_000


def ascii_lower(data: bytes) -> bytes:
    """Lower-case A-Z only; other bytes of UTF-8 stay as they are."""
    return data.translate(_LOWER_TABLE)


#: A key with more than this part of all rows is heavy; so there are fewer heavy keys than this.
HEAVY = 10_000
LIGHT = 1_000  #: rows that are no hot task, whatever part of all they are


def join_heavy(rows: DataFrame, keyed: DataFrame, key: str, total: int, heavy: int = HEAVY) -> DataFrame:
    """rows joined with keyed, a written table of a row a key, whose column ``_n`` is how many rows have the key, of total.

    The heavy keys are fewer than heavy, so they are broadcast; of the others none is a hot task in the shuffle. Where no
    key has a thousand rows none is split off.
    """
    hot = (F.col("_n") * heavy > F.lit(total)) & (F.col("_n") >= LIGHT)
    if keyed.filter(hot).isEmpty():
        return rows.join(keyed, key).drop("_n")
    told = rows.join(F.broadcast(keyed.filter(hot)), key, "left")
    rest = told.filter(F.col("_n").isNull()).select(rows.columns).join(keyed.filter(~hot), key)
    return told.filter(F.col("_n").isNotNull()).unionByName(rest).drop("_n")


def id_text(column: str | Column) -> Column:
    """An id as text; null is the empty string."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def fold(column: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.pmod(F.crc32(id_text(column).cast("binary")), F.lit(parts).cast("long"))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of bounded text, so that long rows don't pile up in Python."""
    for batch in batches:
        lengths = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(lengths):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if len(lengths) > start:
            yield batch.slice(start)
        pa.default_memory_pool().release_unused()  # a worker that waits for its next task holds nothing of this one


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of complete groups from batches that are sorted by keys (which hold no nulls); the last group waits."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        same = np.ones(held.num_rows, bool)
        for key in keys:
            values = held.column(key).to_numpy()
            same &= values == values[-1]
        cut = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None:
        yield held.combine_chunks()
    held = None
    pa.default_memory_pool().release_unused()  # as slices() does


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """First row of each run of equal keys."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for values in keys:
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)
