"""Words and their hashes for whole Arrow batches, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts are handled in slices of about so many bytes; a longer text is one slice.
SLICE_BYTES = 1 << 20
#: Rows that Spark hands over at once.
BATCH_ROWS = 1000
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

#: The word of the contracts, after A-Z are lower-cased: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """The text with A-Z, and nothing else, in lower case."""
    return F.translate(text, UPPER, LOWER)


def text_key(text: Column) -> Column:
    """128 bits that stand for the text in joins; of a null, null."""
    return F.md5(text)


def map_texts(df: DataFrame, task: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` over rows with whole texts, in batches of few rows, as texts may be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(task, schema)


class Words(NamedTuple):
    """Words of a slice: row in the slice, byte range in ``data``, 64-bit hash."""
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    word = np.zeros(256, dtype=bool)
    word[0x30:0x3A] = word[0x41:0x5B] = word[0x61:0x7B] = word[0x80:] = True
    solid = np.ones(256, dtype=bool)
    solid[0x09:0x0E] = solid[0x20] = False
    return fold, word, solid


FOLD, IS_WORD, IS_SOLID = _tables()


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (the splitmix64 finisher)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes byte ranges by prefix sums of a polynomial modulo 2^64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        size = max(n, SLICE_BYTES * 5 // 4)
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)

    def ranges(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(values)
        if n + 1 > len(self.up):
            self._grow(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        raw = (sums[end] - sums[start]) * self.down[np.minimum(start, n)]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(ends) or ends[-1] == ends[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[ends[0]:ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text, all rows in order."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def split_words(column: pa.Array, hasher: Hasher, inside: np.ndarray = IS_WORD,
                fold: bool = True) -> Words:
    data, offsets = buffers(column)
    n = len(data)
    within = inside[data]
    before = np.zeros(n, dtype=bool)
    before[1:] = within[:-1]
    after = np.zeros(n, dtype=bool)
    after[:-1] = within[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    start = np.flatnonzero(within & ~before)
    end = np.flatnonzero(within & ~after) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    code = hasher.ranges(FOLD[data] if fold else data, start, end)
    return Words(row, start, end, code, data, offsets)


def runs(row: np.ndarray, rows: int) -> np.ndarray:
    """Where each row's words begin and end: ``rows + 1`` offsets."""
    return np.searchsorted(row, np.arange(rows + 1))


def windows(code: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every run of ``size`` words inside one row."""
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at = np.flatnonzero(row[:n] == row[size - 1:])
    total = np.zeros(len(at), dtype=np.uint64)
    for j in range(size):
        total = total * np.uint64(_BASE) + code[at + j]
    return at, mix(total)
