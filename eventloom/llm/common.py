"""Helpers the operators share: word counts, packed rows, group-wise Arrow passes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import q

#: Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: The packed input row, see :func:`packed`.
ROW = "_row_"


#: Longer pieces are not remembered: they seldom come again.
LONGEST = 64
#: Bytes of keys and values that a memo holds, besides what an entry costs itself.
ROOM = 64 << 20


class Memo(dict):
    """Remembers ``make(key)`` for the first ``most`` keys of ``LONGEST`` characters or
    fewer, up to ``ROOM`` bytes of them; other ones are made anew.

    Frequent words come early, so a full memo still answers most lookups.
    """

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self._make, self._most, self._room = make, most, ROOM

    def claim(self) -> None:
        """Make this the worker's only filled memo: workers outlive stages, and
        those of earlier stages would add up."""
        global _filled
        if _filled is not self:
            release()
            _filled = self

    def clear(self) -> None:
        super().clear()
        self._room = ROOM

    def __missing__(self, key: str) -> bytes:
        value = self._make(key)
        if len(self) < self._most and len(key) <= LONGEST and self._room > 0:
            self[key] = value
            # Up to four bytes a character.
            self._room -= 4 * len(key) + len(value)
        return value


_filled: Memo | None = None


def release() -> None:
    """Empty the worker's filled memo and give unused Arrow memory back."""
    global _filled
    if _filled is not None:
        _filled.clear()
        _filled = None
    pa.default_memory_pool().release_unused()


def word_count(text: Column) -> Column:
    """Number of words; a missing text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def packed(df: DataFrame, *more: Column) -> DataFrame:
    """The whole input row as one struct beside the operator's own columns, so
    that no name an input carries can clash with a name used inside."""
    return df.select(F.struct(*[q(c) for c in df.columns]).alias(ROW), *more)


def unpacked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Back from :func:`packed` to the input's columns."""
    return df.select(*[F.col(ROW)[c].alias(c) for c in columns])


def column(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    """A column without nulls as numpy."""
    found = batch.column(name)
    if isinstance(found, pa.ChunkedArray):
        found = found.combine_chunks()
    return found.to_numpy(zero_copy_only=False)


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """First positions of the runs of equal keys."""
    if not len(keys[0]):
        return np.zeros(0, dtype="i8")
    new = np.zeros(len(keys[0]), dtype=bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def by_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    work: Callable[[pa.Table], Iterable[pa.RecordBatch]],
    schema: str | T.StructType,
) -> DataFrame:
    """Run ``work`` on tables of whole groups, many small groups at a time.

    Keys are non-null numbers. A group is held in memory by itself, so callers
    pass groups whose size is bounded. Rows come ordered by keys, then ``order``.
    """
    placed = df.repartition(*[q(k) for k in keys]).sortWithinPartitions(
        *[q(k) for k in (*keys, *order)]
    )
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = group_starts(*[column(batch, k) for k in names])
            same = bool(held) and all(
                held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in names
            )
            if same and len(starts) == 1:
                held.append(batch)
                continue
            last = int(starts[-1])
            whole = held + ([batch.slice(0, last)] if last else [])
            if whole:
                yield from work(pa.Table.from_batches(whole).combine_chunks())
            held = [batch.slice(last)]
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    return placed.mapInArrow(run, schema)
