"""Near duplicates by ProbMinHash over weighted shingles, banding and exact verification.

A text's shingles are its runs of five words (a shorter text is one shingle), weighted by how
often they occur.  Each shingle starts a Poisson process with its weight as rate, driven by its
hash; every arrival falls into one of ``SLOTS`` slots, and a slot keeps the shingle that arrived
first.  A text is done as soon as no process can still be the first anywhere.  Two texts agree
in a slot with the probability Jaccard similarity of their shingles.  Texts that agree in all
slots of a band become candidates; candidates that agree in too few slots to be similar are
dropped, as are, in large buckets, pairs that have too little weight on common shingles, and the
rest are verified on their shingles: linked if the exact probability Jaccard similarity is at
least ``SIMILARITY``.

Of two texts at similarity 0.8 the 16 bands of four slots miss one pair in 4,000, and the
slot test one in 10^5; at 0.85 it is one in 10^5 and less.

Scale: signatures are made where texts are read.  Texts of one word sequence are one class
(128-bit hash), so exact copies, however many, cost one row a task.  A bucket's
members are compared with its hub (``graph``); those in different groups after that meet in
chunks, as arrays inside a task, never as rows for pairs.  Only texts of candidates move.

Defined results: a null or wordless text is alone in its group; repeated rows are copies, and
the first (by doc_id, nulls last, then table order) stays; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from eventloom.llm.graph import chunked, link_groups, numbered, stored
from eventloom.llm.text import Hasher, Words, map_texts, mix, runs, slices, split_words, windows

SHINGLE, SIMILARITY = 5, 0.8
SLOTS, BAND = 64, 4
#: Fewer agreeing slots than this are not verified: 4.4 standard deviations below 0.8.
LEAST_SLOTS = 37
#: Shingles that are multiplied at once for the bound on similarities.
COLUMNS = 4096
#: All links among so few members are given, not only those that connect them.
FEW = 4
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: Words, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and count of the distinct shingles, by row and code."""
    _, code = windows(words.code, words.row, SHINGLE)
    at, _ = windows(words.code, words.row, SHINGLE)
    row = words.row[at]
    ends = runs(words.row, rows)
    counts = np.diff(ends)
    few = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(few):
        whole = np.array([_fold(words.code[ends[r]:ends[r + 1]]) for r in few], dtype=np.uint64)
        row, code = np.concatenate([row, few]), np.concatenate([code, whole])
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    first = np.flatnonzero(new)
    return row[first], code[first], np.diff(np.append(first, len(row)))


def _fold(codes: np.ndarray) -> int:
    total = np.zeros(1, dtype=np.uint64)
    for c in codes:
        total = mix(total * GOLDEN + c)
    return int(total[0])


def signatures(row: np.ndarray, code: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """For each row and slot, the shingle that arrives first; 0 where a row has none."""
    first = np.full(rows * SLOTS, np.inf)
    winner = np.zeros(rows * SLOTS, dtype=np.uint64)
    rate = 1.0 / weight
    time = np.zeros(len(code))
    step = 0
    while len(code):
        step += 1
        draw = mix(code + np.uint64(step * int(GOLDEN) & (1 << 64) - 1))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) * rate
        slot = row * SLOTS + (mix(draw) % np.uint64(SLOTS)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        winner[slot[won]] = code[won]
        # A process later than its row's last slot can no longer win: early termination.
        last = first.reshape(rows, SLOTS).max(axis=1)
        on = time < last[row]
        row, code, rate, time = row[on], code[on], rate[on], time[on]
    return winner.reshape(rows, SLOTS)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for piece in (p for b in batches for p in slices(b, "text")):
        rows = piece.num_rows
        words = split_words(piece.column("text"), hasher)
        ends = runs(words.row, rows)
        row, code, count = shingles(words, rows)
        signature = signatures(row, code, count.astype(np.float64), rows)
        bands = np.zeros((rows, SLOTS // BAND), dtype=np.uint64)
        for j in range(BAND):
            bands = mix(bands * GOLDEN + signature[:, j::BAND])
        bands = mix(bands + np.arange(SLOTS // BAND, dtype=np.uint64) * GOLDEN)
        # The word sequence as two hashes: sums over words that depend on their place.
        place = (np.arange(len(words.code)) - ends[words.row]).astype(np.uint64)
        keys = []
        for salt in (1, 2):
            term = mix(words.code ^ mix((place + np.uint64(1)) * GOLDEN * np.uint64(2 * salt + 1)))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term)])
            keys.append((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
        some = np.diff(ends) > 0
        short = (signature >> np.uint64(32)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([
            piece.column("row"), pa.array(keys[0], mask=~some), pa.array(keys[1], mask=~some),
            pa.array([s.tobytes() for s in short], pa.binary()),
            pa.FixedSizeListArray.from_arrays(pa.array(bands.view(np.int64).ravel()), SLOTS // BAND)
            .cast(pa.list_(pa.int64()))], names=["row", "h1", "h2", "signature", "bands"])


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two weighted sets (sorted codes, weights).

    The sum over common elements i of 1 / (sum over j of max(x_j / x_i, y_j / y_i)).
    """
    codes = np.union1d(x[0], y[0])
    a, b = np.zeros(len(codes)), np.zeros(len(codes))
    a[np.searchsorted(codes, x[0])], b[np.searchsorted(codes, y[0])] = x[1], y[1]
    with np.errstate(divide="ignore"):
        ratio = a / b
    order = np.argsort(-ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    both = (a > 0) & (b > 0)
    # x's share is the larger one for all j of at least i's ratio, y's for the rest.
    upto = np.searchsorted(-ratio, -ratio[both], side="right")
    sum_a, sum_b = np.concatenate([[0], np.cumsum(a)]), np.concatenate([[0], np.cumsum(b)])
    total = sum_a[upto] / a[both] + (sum_b[-1] - sum_b[upto]) / b[both]
    return float((1 / total).sum())


@F.pandas_udf(IntegerType())
def _agreeing(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([int((np.frombuffer(a, np.uint32) == np.frombuffer(b, np.uint32)).sum())
                      for a, b in zip(x, y, strict=True)], dtype="int32")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()

    def sets(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        row, code, count = shingles(split_words(column, hasher), len(column))
        ends = runs(row, len(column))
        return [(code[a:b], count[a:b].astype(np.float64)) for a, b in zip(ends, ends[1:], strict=False)]

    for piece in (p for b in batches for p in slices(b, "x")):
        near = [similarity(x, y) >= SIMILARITY - 1e-9
                for x, y in zip(sets(piece.column("x")), sets(piece.column("y")), strict=True)]
        kept = pa.array(near, pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [piece.column("a").filter(kept), piece.column("b").filter(kept)], names=["a", "b"])


def _verifier(docs: DataFrame, signed: DataFrame):
    def verify(pairs: DataFrame) -> DataFrame:
        """The pairs whose texts have the similarity asked for."""
        short = signed.select("row", "signature")
        both = pairs.join(short.select(F.col("row").alias("a"), F.col("signature").alias("x")), "a") \
            .join(short.select(F.col("row").alias("b"), F.col("signature").alias("y")), "b")
        likely = stored(both.where(_agreeing("x", "y") >= LEAST_SLOTS).select("a", "b"), "likely")
        text = docs.select("row", F.col("doc.text").alias("text"))
        ends = likely.select(F.explode(F.array("a", "b")).alias("row")).distinct()
        text = stored(text.join(ends, "row", "left_semi"), "texts")
        both = likely.join(text.select(F.col("row").alias("a"), F.col("text").alias("x")), "a") \
            .join(text.select(F.col("row").alias("b"), F.col("text").alias("y")), "b")
        return map_texts(both, _compare, "a long, b long")

    return verify


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for piece in (p for b in batches for p in slices(b, "text")):
        row, code, count = shingles(split_words(piece.column("text"), hasher), piece.num_rows)
        ends = runs(row, piece.num_rows)
        spans = list(zip(ends, ends[1:], strict=False))
        yield pa.RecordBatch.from_arrays(
            [piece.column("row"), pa.array([code[a:b].tobytes() for a, b in spans], pa.binary()),
             pa.array([count[a:b].astype(np.uint32).tobytes() for a, b in spans], pa.binary())],
            names=["node", "codes", "counts"])


def most_similar(x: list[tuple[np.ndarray, np.ndarray]], y: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """An upper bound of the probability Jaccard similarity of every one of x and every one of y.

    Let p be the share of x's weight that lies on common shingles, q that of y's.  With them given
    the similarity is largest if both spread it alike, and then it is 1 / (1 / p + 1 / q - 1).
    """
    both = [*x, *y]
    codes, at, holders = np.unique(np.concatenate([c for c, _ in both]), return_inverse=True, return_counts=True)
    shared = np.cumsum(holders > 1) - 1
    row = np.repeat(np.arange(len(both)), [len(c) for c, _ in both])
    mass = np.concatenate([w / w.sum() for _, w in both]).astype(np.float32)
    kept = holders[at] > 1
    row, column, mass = row[kept], shared[at[kept]], mass[kept]
    order = np.argsort(column, kind="stable")
    row, column, mass = row[order], column[order], mass[order]
    p, q = np.zeros((len(x), len(y)), np.float32), np.zeros((len(x), len(y)), np.float32)
    for low in range(0, int(holders[holders > 1].size), COLUMNS):
        part = slice(*np.searchsorted(column, [low, low + COLUMNS]))
        dense = np.zeros((len(both), COLUMNS), np.float32)
        dense[row[part], column[part] - low] = mass[part]
        has = (dense > 0).astype(np.float32)
        p += dense[:len(x)] @ has[len(x):].T
        q += has[:len(x)] @ dense[len(x):].T
    with np.errstate(divide="ignore"):
        return 1 / (1 / p + 1 / q - 1)


def _compare_chunks(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links enough to connect what is alike in two chunks of a bucket, or in one."""
    bucket, first, second = (k.as_py() for k in key)
    own = table.column("own").to_numpy()
    sides = [np.flatnonzero(own == first), np.flatnonzero(own == second)]
    node, root = table.column("node").to_numpy(), table.column("root").to_numpy()
    signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, SLOTS)
    bands = np.array(table.column("bands").to_pylist(), dtype=np.int64).reshape(-1, SLOTS // BAND)
    x, y = [], []
    for i in sides[0]:
        # Two that meet in an earlier band as well are compared there.
        same = bands[sides[1]] == bands[i]
        near = (root[sides[1]] != root[i]) & (same.argmax(axis=1) == (bands[i] == bucket).argmax())
        if first == second:
            near &= sides[1] > i
        met = sides[1][near]
        met = met[(signature[met] == signature[i]).sum(axis=1) >= LEAST_SLOTS]
        x.append(np.full(len(met), i))
        y.append(met)
    x, y = (np.concatenate(part) if part else np.zeros(0, np.int64) for part in (x, y))
    links = []
    if len(x):
        used = np.unique(np.concatenate([x, y]))
        codes, counts = table.column("codes"), table.column("counts")
        sets = {i: (np.frombuffer(codes[i].as_py(), np.uint64), np.frombuffer(counts[i].as_py(), np.uint32)
                    .astype(np.float64)) for i in used.tolist()}
        left, right = np.unique(x), np.unique(y)
        most = most_similar([sets[i] for i in left.tolist()], [sets[i] for i in right.tolist()])
        most = most[np.searchsorted(left, x), np.searchsorted(right, y)]
        likely = np.flatnonzero(most >= SIMILARITY - 1e-3)
        group: dict[int, int] = {}

        def top(r: int) -> int:
            while group.get(r, r) != r:
                group[r] = r = group.get(group[r], group[r])
            return r

        # The likeliest first: what a group joins already need not be compared.
        for k in likely[np.argsort(-most[likely], kind="stable")].tolist():
            a, b = top(int(root[x[k]])), top(int(root[y[k]]))
            if (a != b or len(own) <= FEW) and similarity(sets[x[k]], sets[y[k]]) >= SIMILARITY - 1e-9:
                group[max(a, b)] = min(a, b)
                links.append(sorted((int(node[x[k]]), int(node[y[k]]))))
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def _finisher(docs: DataFrame, signed: DataFrame):
    def finish(members: DataFrame) -> DataFrame:
        """Links enough to connect all alike members (bucket, size, node, root) of a bucket.

        Chunks of a bucket meet in tasks: slots first, then the bound on their shingles, then
        the exact similarity of what is not yet joined.  Only links leave a task.
        """
        members = stored(members, "open")
        text = docs.select("row", F.col("doc.text").alias("text"))
        text = text.join(members.select(F.col("node").alias("row")).distinct(), "row", "left_semi")
        sets = map_texts(text, _sets, "node long, codes binary, counts binary")
        told = stored(sets.join(signed.select(F.col("row").alias("node"), "signature", "bands"), "node"), "sets")
        return chunked(members.join(told, "node")).groupBy("bucket", "first", "second") \
            .applyInArrow(_compare_chunks, "a long, b long")

    return finish


def groups(docs: DataFrame) -> DataFrame:
    """row, root, kept, group_id, group_size, n_links for each row of numbered ``docs`` (text, doc_id).

    ``root`` names the group; ``group_id`` is the doc_id of the document that stays, which has
    ``kept``; ``n_links`` counts the verified links of the row's class.
    """
    texts = docs.select("row", F.col("doc.text").alias("text"))
    signed = map_texts(
        texts, _sign, "row long, h1 long, h2 long, signature binary, bands array<long>")
    signed = stored(signed, "signatures")
    worded = signed.where("h1 is not null")
    classes = stored(worded.groupBy("h1", "h2").agg(F.min("row").alias("node")), "classes")
    members = signed.join(classes.select(F.col("node").alias("row")), "row", "left_semi") \
        .select(F.explode("bands").alias("bucket"), F.col("row").alias("node"))
    links, found = link_groups(members, _verifier(docs, signed), finish=_finisher(docs, signed))
    ends = links.select(F.explode(F.array("a", "b")).alias("node"))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    named = stored(classes.join(found, "node", "left").join(degree, "node", "left").select(
        "h1", "h2", F.coalesce("root", "node").alias("root"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "named")
    own = signed.select("row", "h1", "h2").join(named, ["h1", "h2"], "left").select(
        "row", F.coalesce("root", "row").alias("root"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    own = stored(own.join(docs.select("row", F.col("doc.doc_id").alias("doc_id")), "row"), "rows")
    # The least (doc_id, row) of a group; numbers, so that hash aggregation can hold them.
    first_id = own.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("group_size"))
    first_id = stored(first_id, "first")
    same = own.join(first_id, "root").where(F.col("doc_id").eqNullSafe(F.col("group_id")))
    first = stored(same.groupBy("root").agg(
        F.min("row").alias("first"), F.first("group_id").alias("group_id"),
        F.first("group_size").alias("group_size")), "first")
    return own.join(first, "root").select(
        "row", "doc_id", "root", (F.col("row") == F.col("first")).alias("kept"), "group_id",
        "group_size", "n_links")


def dedup(docs: DataFrame) -> DataFrame:
    """The documents, all columns, of which each group of near duplicates keeps one."""
    rows = numbered(docs, "documents")
    gone = stored(groups(rows).where("not kept").select("row"), "copies")
    return rows.join(gone, "row", "left_anti").select("doc.*")


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, its group and the group's size, links of its class, and whether it stays."""
    rows = numbered(docs.select("doc_id", "text"), "documents")
    return groups(rows).select("doc_id", "group_id", "group_size", "n_links", "kept")
