"""Resampling towards a target distribution, over hashed word n-grams of deduplicated lines.

A text's features are its runs of one to three words, hashed into ``BUCKETS`` buckets.  Words
never hold a line feed, so line feeds cut a text into lines and its features into those inside
a line and those that reach across lines.  A line that many documents share is one row: its
features are hashed once, and counted as often as the line occurs.  Only the n-grams across
lines are made per document.  The counts of the raw table and of the target give each bucket a
gain, a line's weight is the sum over its features, made once as well, and a document's weight
is the sum over its lines and its cross-line features.  Gumbel noise that follows from doc_id
makes the highest scores a weighted draw without replacement.

The CRC-32 of an n-gram is put together from those of its words: appending L bytes to a text
multiplies its CRC by a fixed matrix over GF(2), which is applied to whole arrays.

Scale: distinct lines are grouped before the shuffle.  Counts leave a task as one row per
bucket; the gains are BUCKETS numbers, whatever the input.  Lines that hold a large share of
all occurrences are joined without a shuffle (``skew``).  Ranks come from sorted ranges.

Defined results: a null or wordless text has no features and weight 0; doc_id null counts as
the word ``null`` in its noise and as the largest in ties; repeated rows are drawn each for
itself, in table order; an empty target gives all buckets t = 0; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.graph import stored
from eventloom.llm.skew import join_spread, ranked
from eventloom.llm.text import FOLD, Hasher, map_texts, slices, split_words

LONGEST, BUCKETS = 3, 10_000
SEED, LEAST_WORDS, DRAWN_PERCENT = 42, 20, 5
#: A text in which this is found has a word.
HAS_WORD = r"[0-9A-Za-z]|[^\x00-\x7F]"
_POLYNOMIAL = 0xEDB88320


def _byte_step() -> np.ndarray:
    """What one zero byte makes of each low byte of a CRC."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = (value >> 1) ^ np.where(value & 1, np.uint32(_POLYNOMIAL), np.uint32(0))
    return value.astype(np.uint32)


class Crc:
    """CRC-32 of concatenations, for whole arrays."""

    def __init__(self) -> None:
        low = _byte_step()
        places = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], dtype=np.uint32)
        #: For 2^k zero bytes, what each byte of a CRC becomes.
        self.steps = [low[places & 255] ^ (places >> 8)]

    def _apply(self, k: int, value: np.ndarray) -> np.ndarray:
        while k >= len(self.steps):
            last = len(self.steps) - 1
            self.steps.append(self._apply(last, self.steps[last]))
        t = self.steps[k]
        return t[0][value & 255] ^ t[1][value >> 8 & 255] ^ t[2][value >> 16 & 255] ^ t[3][value >> 24]

    def shifted(self, value: np.ndarray, by: np.ndarray) -> np.ndarray:
        """The CRCs as they count in front of ``by`` more bytes."""
        value = value.copy()
        for k in range(int(by.max(initial=0)).bit_length()):
            at = np.flatnonzero(by >> k & 1)
            value[at] = self._apply(k, value[at])
        return value

    def joined(self, left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.shifted(left, size) ^ right


class Grams(NamedTuple):
    """Buckets of n-grams; ``first`` is the index of an n-gram's first word."""
    first: np.ndarray
    bucket: np.ndarray


def grams(text: bytes, start: np.ndarray, end: np.ndarray, unit: np.ndarray, crc: Crc,
          line: np.ndarray | None = None) -> list[Grams]:
    """The n-grams of words (byte ranges of folded ``text``) inside one unit, by length.

    With ``line``, only those whose first and last word lie on different lines.
    """
    n = len(start)
    chosen = []
    for size in range(1, LONGEST + 1):
        near, far = np.arange(max(n - size + 1, 0)), np.arange(size - 1, n)
        inside = unit[near] == unit[far]
        if line is not None:
            inside &= line[near] != line[far]
        chosen.append(np.flatnonzero(inside))
    used = np.zeros(n, dtype=bool)
    for size, at in enumerate(chosen):
        for j in range(size + 1):
            used[at + j] = True
    word = np.zeros(n, dtype=np.uint32)
    spans = zip(start[used].tolist(), end[used].tolist(), strict=True)
    word[used] = np.array([zlib.crc32(text[a:b]) for a, b in spans], dtype=np.uint32)
    length = end - start
    blank = np.full(n, zlib.crc32(b" "), dtype=np.uint32)
    spaced = np.zeros(n, dtype=np.uint32)
    spaced[used] = crc.joined(blank[used], word[used], length[used])
    found = []
    for size, at in enumerate(chosen):
        code = word[at]
        for j in range(1, size + 1):
            code = crc.joined(code, spaced[at + j], length[at + j] + 1)
        found.append(Grams(at, (code % BUCKETS).astype(np.uint16)))
    return found


def _by_row(found: list[Grams], row: np.ndarray, rows: int) -> pa.Array:
    """The buckets of each row, 16 bits each, as a binary column."""
    size = sum(np.bincount(row[g.first], minlength=rows) for g in found)
    offsets = np.zeros(rows + 1, dtype=np.int64)
    np.cumsum(size, out=offsets[1:])
    flat = np.zeros(int(offsets[-1]), dtype="<u2")
    free = offsets[:-1].copy()
    for g in found:
        of = row[g.first]
        count = np.bincount(of, minlength=rows)
        begin = np.cumsum(count) - count
        flat[free[of] + np.arange(len(of)) - begin[of]] = g.bucket
        free += count
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), rows, [None, pa.py_buffer(offsets * 2), pa.py_buffer(flat)]).cast(pa.binary())


def _buckets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a binary column, and where each row's begin and end."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, dtype=np.uint16), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(bytes(data[int(ends[0]):int(ends[-1])]), dtype="<u2"), (ends - ends[0]) // 2


def _key(line: bytes) -> bytes:
    return hashlib.md5(line, usedforsecurity=False).digest()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: words, buckets of cross-line features, and its lines with their counts."""
    hasher, crc = Hasher(), Crc()
    for piece in (p for b in batches for p in slices(b, "text")):
        rows = piece.num_rows
        words = split_words(piece.column("text"), hasher)
        raw = words.data.tobytes()
        feeds = np.flatnonzero(words.data == 0x0A)
        cuts = np.unique(np.concatenate([feeds + 1, words.offsets[:-1]]))
        line = np.searchsorted(cuts, words.start, side="right") - 1
        cross = grams(FOLD[words.data].tobytes(), words.start, words.end, words.row, crc, line)
        # Lines with words: from the cut to the next line feed or the end of the row.
        used = np.unique(line)
        begin = cuts[used]
        of = np.searchsorted(words.offsets, begin, side="right") - 1
        stop = np.append(feeds, len(words.data))[np.searchsorted(feeds, begin)]
        stop = np.minimum(stop, words.offsets[of + 1])
        keys = [_key(raw[a:b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
        bounds = np.searchsorted(of, np.arange(rows + 1)).tolist()
        lines = [[{"key": k, "n": n} for k, n in Counter(keys[a:b]).items()]
                 for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([
            piece.column("row"), piece.column("doc_id"),
            pa.array(np.bincount(words.row, minlength=rows), pa.int64()), _by_row(cross, words.row, rows),
            pa.array(lines, pa.list_(pa.struct([("key", pa.binary()), ("n", pa.int64())]))),
        ], ["row", "doc_id", "n_words", "buckets", "lines"])


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per distinct line: its key, how often it occurs, and the buckets of its features."""
    hasher, crc = Hasher(), Crc()
    for piece in (p for b in batches for p in slices(b, "text")):
        words = split_words(piece.column("text"), hasher)
        raw = words.data.tobytes()
        keys = [_key(raw[a:b]) for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True)]
        found = grams(FOLD[words.data].tobytes(), words.start, words.end, words.row, crc)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), piece.column("n"), _by_row(found, words.row, piece.num_rows)],
            ["key", "n", "buckets"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's count of every bucket; a row of buckets counts ``n`` times."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        bucket, ends = _buckets_of(batch.column("buckets"))
        times = np.repeat(batch.column("n").to_numpy(zero_copy_only=False), np.diff(ends))
        once = times == 1
        total += np.bincount(bucket[once], minlength=BUCKETS)
        np.add.at(total, bucket[~once], times[~once])
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bucket", "n"])


class Segments(NamedTuple):
    """A table of texts as stored documents and distinct lines."""
    documents: DataFrame
    lines: DataFrame


def segments(documents: DataFrame, doc_id: str = "doc_id") -> Segments:
    rows = documents.select(F.monotonically_increasing_id().alias("row"),
                            F.col(doc_id).cast("long").alias("doc_id"), "text")
    cut = map_texts(rows, _cut, "row long, doc_id long, n_words long, buckets binary, "
                                "lines array<struct<key:binary,n:long>>")
    lines = documents.select(F.explode(F.split("text", "\n")).alias("text")).where(
        F.col("text").rlike(HAS_WORD)).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    hashed = map_texts(lines, _hash_lines, "key binary, n long, buckets binary")
    return Segments(stored(cut, "documents"), stored(hashed, "lines"))


def bucket_counts(cut: Segments) -> DataFrame:
    """(bucket, n): lines by their occurrences, and what reaches across lines."""
    apart = cut.documents.select(F.lit(1).cast("long").alias("n"), "buckets")
    both = cut.lines.select("n", "buckets").unionByName(apart)
    return both.mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of every bucket from the counts of both tables: BUCKETS numbers."""
    both = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    # At most BUCKETS rows come to the driver.
    found = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in found:
        s[r.bucket], t[r.bucket] = r.s, r.t
    odds = (t + 1.0) * (s.sum() + BUCKETS) / ((s + 1.0) * (t.sum() + BUCKETS))
    return np.floor(1000.0 * np.log(odds)).astype(np.int64)


def _weigh(table: DataFrame, gain: np.ndarray, kept: tuple[str, ...]) -> DataFrame:
    """The ``kept`` columns and the ``weight`` of each row's buckets."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, ends = _buckets_of(batch.column("buckets"))
            sums = np.zeros(len(bucket) + 1, dtype=np.int64)
            np.cumsum(gain[bucket], out=sums[1:])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(sums[ends[1:]] - sums[ends[:-1]])],
                [*kept, "weight"])

    kinds = "".join(f"{c} {table.schema[c].dataType.simpleString()}, " for c in kept)
    return table.select(*kept, "buckets").mapInArrow(task, kinds + "weight long")


def weights(cut: Segments, gain: np.ndarray) -> DataFrame:
    """(row, weight) of all documents with features."""
    across = _weigh(cut.documents, gain, ("row",))
    # A line in n documents occurs at least n times, so its count bounds the rows that meet it.
    line = stored(_weigh(cut.lines, gain, ("key", "n")).withColumnRenamed("n", "copies"), "weights")
    places = cut.documents.select("row", F.inline("lines"))
    inside = join_spread(places, line, "key", "copies").select(
        "row", (F.col("weight") * F.col("n")).alias("weight"))
    return inside.unionByName(across).groupBy("row").agg(F.sum("weight").alias("weight"))


def noise(doc_id: Column) -> Column:
    """Gumbel noise in thousandths that follows from the id."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))) * F.lit(-1000.0))


def report(documents: DataFrame, target: DataFrame) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and, where drawn, rank."""
    cut = segments(documents)
    gain = gains(bucket_counts(cut), bucket_counts(segments(target, "item_id")))
    words = F.col("n_words")
    features = sum((F.greatest(words - k, F.lit(0)) for k in range(1, LONGEST)), words)
    scored = stored(cut.documents.select("row", "doc_id", "n_words").join(weights(cut, gain), "row").select(
        "row", "doc_id", features.alias("n_features"), "weight",
        (F.col("weight") + noise(F.col("doc_id"))).alias("score"),
        (words >= LEAST_WORDS).alias("eligible")), "scores")
    drawn = scored.where("eligible").count() * DRAWN_PERCENT // 100
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    return ranked(scored, order, "ranked").select(
        "doc_id", "n_features", "weight", "score",
        F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
