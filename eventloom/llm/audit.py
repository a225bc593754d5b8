"""How filters interact: for every order of applying them, what each step removes.

A document's verdicts are a mask, one bit per filter that it fails.  Every mask stands for one
big integer (``packed``) with a field of ``FIELD_BITS`` bits for each step of each order; a
field holds 1 where that step removes such a document.  A part's documents are the sum of their
masks' integers, so one sum per part carries the counts of all orders and steps, and the fields
are read back without a carry between them, as no count reaches 2^63.  All else follows
from the removals: what is kept is what no step so far removed; a filter's failures are its
removals where it comes first, those of it alone its removals where it comes last.

Scale: texts are read once, and no text moves; a document is its mask, its part and the 128-bit
hash of its text.  Equal texts have equal masks, so a group of copies is one row a task, part
and kind of label before the shuffle, with its least doc_id.  A part meets as at most 2^filters
counts, which multiply the integers; nothing reaches the driver.

Defined results: a null text is empty; a null source is the part of the empty string; a null
doc_id has no labels, is smaller than none and larger than none; repeated rows of one doc_id
are no copies of each other, and count each; of several labels of a document one that says 1
is enough; an empty table has no parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELD_BITS = 64
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 50, 65, 5
#: Rows without doc_id have no place of their own in the join with labels; they are dealt to so many.
SALTS = 1024
#: Parts whose rows are handed back at once.
PARTS_AT_ONCE = 64

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def orders(letters: str) -> list[str]:
    return ["".join(p) for p in permutations(letters)]


def packed(letters: str) -> list[int]:
    """The integer of every mask; bit i of a mask is the i-th letter's failure."""
    steps = len(letters)
    integers = []
    for mask in range(1 << steps):
        failed = {f for i, f in enumerate(letters) if mask >> i & 1}
        total = 0
        for o, order in enumerate(orders(letters)):
            first = next((s for s, f in enumerate(order) if f in failed), None)
            if first is not None:
                total += 1 << FIELD_BITS * (o * steps + first)
        integers.append(total)
    return integers


def unpacked(total: int, letters: str) -> np.ndarray:
    """The fields of a sum, as one row per order and one column per step."""
    steps, width = len(letters), FIELD_BITS // 8
    rows = len(orders(letters))
    return np.frombuffer(total.to_bytes(rows * steps * width, "little"), dtype="<i8").reshape(rows, steps)


def audit(counts: DataFrame, letters: str) -> DataFrame:
    """One row per part, order and step from ``counts`` (part, mask, n, good, toxic), a row per
    part and mask."""
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    integers, sequence = packed(letters), orders(letters)
    steps = len(letters)
    at = np.array([[letters.index(f) for f in o] for o in sequence])
    first = [next(i for i, o in enumerate(sequence) if o[0] == f) for f in letters]
    last = [next(i for i, o in enumerate(sequence) if o[-1] == f) for f in letters]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (b.slice(k, PARTS_AT_ONCE) for b in batches for k in range(0, b.num_rows, PARTS_AT_ONCE)):
            found = []
            for rows in piece.column("cells").to_pylist():
                sums = [sum(r[c] * integers[r["mask"]] for r in rows) for c in ("n", "good", "toxic")]
                removed, good, toxic = (unpacked(s, letters) for s in sums)
                fails = removed[first, 0]
                lone = removed[last, steps - 1]
                shapley = np.array([removed[at == f].sum() for f in range(steps)])
                kept = sum(r["n"] for r in rows) - np.cumsum(removed, axis=1)
                found.append(np.stack([kept, removed, fails[at] - removed, lone[at], good, toxic, shapley[at]],
                                      axis=-1).reshape(-1, len(COUNTS)))
            table = np.concatenate(found)
            per = len(sequence) * steps
            yield pa.RecordBatch.from_arrays([
                piece.column("part").take(pa.array(np.repeat(np.arange(piece.num_rows), per))),
                pa.array(np.tile(np.repeat(sequence, steps), piece.num_rows).tolist(), pa.string()),
                pa.array(np.tile(np.arange(1, steps + 1), len(sequence) * piece.num_rows), pa.int32()),
                *[pa.array(table[:, i], pa.int64()) for i in range(len(COUNTS))],
            ], ["part", "filter_order", "step", *COUNTS])

    return cells.mapInArrow(task, _SCHEMA)


def conditions() -> dict[str, Column]:
    """The failure conditions on columns ``text``, ``words`` of a document; E needs the table."""
    words, text = F.size("words"), F.col("text")
    upper = F.regexp_count(text, F.lit("[A-Z]"))
    return {
        "A": words < LEAST_WORDS,
        "B": F.size(F.array_distinct("words")) * 100 < words * LEAST_DISTINCT,
        "C": upper * 100 > F.length(text) * MOST_UPPER,
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_of(failures: dict[str, Column]) -> Column:
    return reduce(Column.__add__, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures.values())])


def masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail just these filters."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, r"[ \t-\r]+"), "")
    failures = conditions()
    read = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"),
                            words.alias("words"))
    narrow = read.select("doc_id", "part", F.unhex(F.md5("text")).alias("key"), mask_of(failures).alias("mask"))
    narrow = narrow.withColumn("salt", F.when(
        F.col("doc_id").isNull(), F.pmod(F.xxhash64("key"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    told = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    ).withColumn("salt", F.lit(0).cast("long"))
    kind = ("part", "mask", "good", "toxic")
    rows = narrow.join(told, ["doc_id", "salt"], "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    rows = rows.groupBy("doc_id", "salt", "key", *kind).agg(F.count(F.lit(1)).alias("n"))
    # Copies meet as one row a task, part and label: how many, and the least doc_id with its rows.
    known = F.col("doc_id").isNotNull()
    copies = rows.groupBy("key", *kind).agg(
        F.sum("n").alias("n"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("unknown"),
        F.min(F.when(known, F.struct("doc_id", "n"))).alias("least"))
    of_text = copies.groupBy("key").agg(F.min("least.doc_id").alias("first"))
    copies = copies.join(of_text, "key")
    spared = F.col("unknown") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    copy_bit = 1 << len(failures)
    split = copies.withColumn("spared", spared).select("part", "good", "toxic", F.inline(F.array(
        F.struct("mask", F.col("spared").alias("n")),
        F.struct((F.col("mask") + copy_bit).alias("mask"), (F.col("n") - F.col("spared")).alias("n")))))
    return split.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
        F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters A to E over whole ``documents``, in all 120 orders."""
    return audit(masks(documents, labels), "ABCDE")
