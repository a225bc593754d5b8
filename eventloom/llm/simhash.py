"""Near duplicates by SimHash, with candidates from the pigeonring principle.

A text's fingerprint has a bit for every bit that over half of its shingles' hashes have.  Two
fingerprints are linked if at most ``BITS`` bits differ.  Cut into ``SEGMENTS`` segments on a
ring, the segments' differences of such a pair add up to at most BITS all round, so there is a
segment from which *every* chain of consecutive segments stays within its share of that budget:
over l segments at most l * BITS / SEGMENTS differing bits.  (The plain pigeonhole principle
asks this of chains of length 1 only.)

With 8 segments of 8 bits and 3 differing bits the budgets are 0, 0, 1, 1, 1, 2, 2, 3: the
first two segments of the chain are equal, and of the next three two are.  These four segments
are the key under which fingerprints meet: 32 equal bits, 24 keys a fingerprint.  Of the pairs
that meet the longer chains are asked next, and what is left gets the full Hamming check.

Scale: fingerprints are made where texts are read, and only they move.  Equal fingerprints are
one row, counted before the shuffle.  A key's fingerprints are compared with a few hubs a round
(``graph``), never all with all, and no link is lost: two that are in one group already need no
comparison.

Defined results: a null or wordless text has fingerprint zero, linked like any other; a text of
fewer words than a shingle is one shingle; a group's id is its least doc_id, null if it has none;
repeated rows stay, each with its group; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.graph import link_groups, stored
from eventloom.llm.skew import join_spread
from eventloom.llm.text import FOLD, IS_SOLID, Hasher, Words, map_texts, runs, slices, split_words

SHINGLE, SEED = 3, 42
BITS, SEGMENTS = 3, 8
WIDTH = 64 // SEGMENTS
#: Hashes whose bits are counted at once.
HASHES_AT_ONCE = 1 << 17


def _spaced(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words in lower case with one space between, and where each begins and ends."""
    solid = np.flatnonzero(IS_SOLID[words.data])
    size = words.end - words.start
    start = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(size), 0x20, dtype=np.uint8)
    out[np.arange(len(solid)) + np.repeat(np.arange(len(size)), size)] = FOLD[words.data[solid]]
    return out.tobytes(), start, start + size


def fingerprints(column: pa.Array, hasher: Hasher) -> np.ndarray:
    """The fingerprint of every text of the column."""
    import xxhash

    rows = len(column)
    words = split_words(column, hasher, inside=IS_SOLID)
    text, start, end = _spaced(words)
    ends = runs(words.row, rows)
    count = np.diff(ends)
    # A shingle runs from its first word to the third, or to the last of a short text.
    begins = np.flatnonzero(np.arange(len(start)) < np.maximum(ends[1:] - SHINGLE + 1, ends[:-1] + 1)[words.row])
    upto = np.minimum(begins + SHINGLE, ends[1:][words.row[begins]]) - 1
    row = words.row[begins]
    shingles = np.maximum(count - SHINGLE + 1, np.minimum(count, 1))
    ones = np.zeros((rows, 64), dtype=np.int64)
    for k in range(0, len(begins), HASHES_AT_ONCE):
        part = slice(k, k + HASHES_AT_ONCE)
        spans = zip(start[begins[part]].tolist(), end[upto[part]].tolist(), strict=True)
        codes = np.array([xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        of = row[part]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        ones[of[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    majority = (2 * ones > shingles[:, None]).astype(np.uint8)
    return np.packbits(majority, axis=1, bitorder="little").reshape(-1).view("<u8")


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for piece in (p for b in batches for p in slices(b, "text")):
        code = fingerprints(piece.column("text"), hasher).view(np.int64)
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(code)], ["doc_id", "code"])


def _segment(code: Column, i: int) -> Column:
    return F.shiftrightunsigned(code, WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1))


def ring_keys(code: Column) -> Column:
    """The keys of a fingerprint: for every segment of the ring, it and the next one, and two
    of the three after these; 4 * WIDTH bits below the key's number."""
    keys = []
    for i in range(SEGMENTS):
        for left_out in (2, 3, 4):
            kept = [j for j in range(5) if j != left_out]
            bits = reduce(lambda whole, j, i=i: F.shiftleft(whole, WIDTH).bitwiseOR(_segment(code, i + j)),
                          kept, F.lit(len(keys)).cast("long"))
            keys.append(bits)
    return F.array(*keys)


def on_budget(apart: Column) -> Column:
    """Is there a segment from which every chain, but for the whole ring, stays in its budget?

    ``apart`` holds the differing bits.
    """
    apart_by = [F.bit_count(_segment(apart, i)) for i in range(SEGMENTS)]
    chains = []
    for i in range(SEGMENTS):
        total, fits = F.lit(0), F.lit(True)
        for length in range(1, SEGMENTS):
            total = total + apart_by[(i + length - 1) % SEGMENTS]
            fits = fits & (total <= length * BITS // SEGMENTS)
        chains.append(fits)
    return reduce(Column.__or__, chains)


def may_link(x: Column, y: Column) -> Column:
    """Do two fingerprints differ in few enough bits, no chain of segments in too many?"""
    apart = x.bitwiseXOR(y)
    return (F.bit_count(apart) <= BITS) & on_budget(apart)


def verify(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of fingerprints that are linked: chains first, then the full check."""
    apart = pairs.withColumn("apart", F.col("a").bitwiseXOR(F.col("b")))
    return apart.where(on_budget(F.col("apart"))).where(F.bit_count("apart") <= BITS).select("a", "b")


def groups(prints: DataFrame) -> DataFrame:
    """(code, copies, component_id) of the distinct fingerprints of ``prints`` (doc_id, code)."""
    nodes = stored(prints.groupBy("code").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least")), "codes")
    members = nodes.select(F.explode(ring_keys(F.col("code"))).alias("bucket"), F.col("code").alias("node"))
    _, found = link_groups(members, verify, may_link=may_link)
    # A group's root stands in no row of its own there.
    rooted = stored(nodes.join(found, nodes["code"] == found["node"], "left").select(
        "code", "copies", "least", F.coalesce("root", "code").alias("root")), "rooted")
    heads = stored(rooted.groupBy("root").agg(
        F.count(F.lit(1)).alias("members"), F.min("least").alias("component_id")), "heads")
    return join_spread(rooted, heads, "root", "members").select("code", "copies", "component_id")


def report(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    texts = documents.select("doc_id", "text")
    prints = stored(map_texts(texts, _sign, "doc_id long, code long"), "prints")
    found = join_spread(prints, stored(groups(prints), "components"), "code", "copies")
    return found.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
