"""Benchmark decontamination by a positional inverted index.

The corpus is cut into segments of about ``SEGMENT_WORDS`` words (a segment never splits a
document) and each segment's postings are stored as a table, one row per segment and term:
the positions at which the term stands.  A benchmark window is looked up in a segment by
intersecting its terms' lists, moved by the term's place in the window, from the rarest term
on; almost all windows die at the first or second list.  With ``slop`` the same lists give
proximity matches: every word within ``slop`` places of where the window has it.

Scale: postings are built where the text is read (no shuffle of text); only lists of terms
that occur in the benchmark are kept, and they are grouped by segment, all of one size, so
no key is hot.  Items go to the tasks in blocks of at most ``ITEM_BLOCK_BYTES`` of text
(or one item), however many there are.

Defined results: a null or wordless text has no words and no hits; a null or wordless item
matches nothing; rows of one ``item_id`` are one item, a null id is named ``null``; repeated
documents each get their row; an empty table on either side gives no hits.  Terms are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.text import Hasher, map_texts, runs, slices, split_words, text_key
from eventloom.session import materialise

WINDOW = 10
#: How far the query and the pipeline let each word of a window stand from its place.
SLOP = 2
SEGMENT_WORDS = 1 << 20
#: Positions left free between documents, so that no match crosses them.
GAP = 64
ITEM_BLOCK_BYTES = 8 << 20
HEADER, ROW, POSTING = 0, 1, 2


def _tokens(texts: list[str]) -> list[np.ndarray]:
    words = split_words(pa.array(texts, pa.large_string()), Hasher())
    ends = runs(words.row, len(texts))
    return [words.code[a:b].view(np.int64) for a, b in pairwise(ends)]


def _segments(wanted: np.ndarray | None, key_type: pa.DataType):
    """Builds the index rows of one task's documents, segment by segment."""
    schema = pa.schema([("kind", pa.int32()), ("segment", pa.int64()), ("term", pa.int64()),
                        ("n", pa.int64()), ("positions", pa.binary()), ("key", key_type)])

    def batch(kind, segment, term, n, positions, key) -> pa.RecordBatch:
        size = len(term)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(size, kind, np.int32)), pa.array(np.full(size, segment, np.int64)),
            pa.array(term, pa.int64()), pa.array(n, pa.int64()),
            pa.array(positions, pa.binary()) if positions else pa.nulls(size, pa.binary()),
            key if key is not None else pa.nulls(size, key_type)], schema=schema)

    def close(segment, codes, counts, keys) -> Iterator[pa.RecordBatch]:
        count = np.concatenate(counts)
        base = np.concatenate([[0], np.cumsum(count + GAP)])[:-1]
        yield batch(HEADER, segment, [0], [len(count)], [base.astype(np.uint32).tobytes()], None)
        ordinal = np.arange(len(count))
        key = pa.chunked_array(keys, key_type).combine_chunks()
        yield batch(ROW, segment, ordinal, count, None, key)
        code = np.concatenate(codes)
        place = (np.arange(len(code)) + np.repeat(ordinal * GAP, count)).astype(np.uint32)
        if wanted is not None and len(code):
            at = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
            kept = wanted[at] == code
            code, place = code[kept], place[kept]
        if len(code):
            order = np.argsort(code, kind="stable")
            code, place = code[order], place[order]
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            last = np.append(first[1:], len(code))
            blobs = [place[a:b].tobytes() for a, b in zip(first, last, strict=True)]
            yield batch(POSTING, segment, code[first], last - first, blobs, None)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, number = Hasher(), 0
        task = TaskContext.get().partitionId() << 24
        codes, counts, keys, total = [], [], [], 0
        for piece in (p for b in batches for p in slices(b, "text")):
            words = split_words(piece.column("text"), hasher)
            codes.append(words.code.view(np.int64))
            counts.append(np.bincount(words.row, minlength=piece.num_rows).astype(np.int64))
            keys.append(piece.column("key"))
            total += len(words.code)
            if total >= SEGMENT_WORDS:
                yield from close(task + number, codes, counts, keys)
                codes, counts, keys, total, number = [], [], [], 0, number + 1
        if codes:
            yield from close(task + number, codes, counts, keys)

    return build


def build_index(docs: DataFrame, key: Column, wanted: np.ndarray | None = None) -> DataFrame:
    """The index of ``docs.text`` as a written table; ``key`` is what a match will carry.

    ``wanted``: sorted hashes of the only terms that will be asked for; None keeps all.
    """
    narrow = docs.select("text", key.alias("key"))
    kind = narrow.schema["key"].dataType
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    index = map_texts(narrow, _segments(wanted, arrow),
        f"kind int, segment long, term long, n long, positions binary, key {kind.simpleString()}")
    return materialise(index, "postings")


def _near(lists: list[np.ndarray], slop: int) -> np.ndarray:
    """First positions of a window's occurrences; each word within ``slop`` of its place."""
    order = sorted(range(len(lists)), key=lambda j: len(lists[j]))
    rare = order[0]
    # With slop, the rarest word may itself stand up to slop places off.
    begin = lists[rare].astype(np.int64) - rare
    if slop:
        begin = np.unique((begin[:, None] + np.arange(-slop, slop + 1)).ravel())
    # So a window may begin before its document, which must not hang on where that stands.
    begin = begin[begin >= -slop]
    for j in order[1:]:
        if not len(begin):
            break
        at = np.searchsorted(lists[j], begin + j - slop)
        near = np.minimum(at, len(lists[j]) - 1)
        begin = begin[(at < len(lists[j])) & (lists[j][near] <= begin + j + slop)]
    return begin


def _lookup(items: list[tuple[str, np.ndarray]], window: int, slop: int):
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        header = rows["kind"] == HEADER
        base = np.frombuffer(rows.loc[header, "positions"].iloc[0], np.uint32).astype(np.int64)
        segment = int(rows["segment"].iloc[0])
        found = rows[~header]
        lists = {t: np.frombuffer(p, np.uint32).astype(np.int64)
                 for t, p in zip(found["term"], found["positions"], strict=True)}
        hits: dict[tuple[int, str], list[np.ndarray]] = {}
        near: set[tuple[int, str]] = set()
        for name, words in items:
            have = np.fromiter((w in lists for w in words.tolist()), bool, len(words))
            size = min(window, len(words))
            for at in range(len(words) - size + 1):
                if not have[at:at + size].all():
                    continue
                own = [lists[w] for w in words[at:at + size].tolist()]
                begin = _near(own, 0)
                doc = np.searchsorted(base, begin, side="right") - 1
                for d in np.unique(doc):
                    first = begin[doc == d] - base[d]
                    hits.setdefault((int(d), name), []).append(
                        (first[:, None] + np.arange(size)).ravel())
                if slop:
                    close = np.searchsorted(base, _near(own, slop) + slop, side="right") - 1
                    near.update((int(d), name) for d in np.unique(close))
        keys = sorted(hits.keys() | near)
        return pd.DataFrame({
            "segment": np.full(len(keys), segment, np.int64),
            "ordinal": np.array([d for d, _ in keys], np.int64),
            "item": pd.Series([name for _, name in keys], dtype=object),
            "hit": pd.Series([np.unique(np.concatenate(hits[k])).tolist() if k in hits else []
                              for k in keys], dtype=object),
        })

    return search


class _ItemBlocks:
    """(id, text) of all items, in ``count`` blocks of ITEM_BLOCK_BYTES of text on average."""

    def __init__(self, items: DataFrame) -> None:
        self.items = items.select(
            F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"),
            F.coalesce("text", F.lit("")).alias("text"))
        size = self.items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.count = max(1, math.ceil(size / ITEM_BLOCK_BYTES))

    def read(self) -> Iterator[list[tuple[str, str]]]:
        for b in range(self.count):
            own = self.items.where(F.pmod(F.xxhash64("name", "text"), F.lit(self.count)) == b)
            yield [(r["name"], r["text"]) for r in own.collect()]


def occurrences(docs: DataFrame, items: DataFrame, key: Column, window: int = WINDOW,
                slop: int = 0) -> DataFrame:
    """One row per document: key, n_words, n_hit, items (names with an exact window), near_items.

    ``near_items`` has the names with a proximity match within ``slop`` (at most GAP / 4 - 1).
    """
    if not 0 <= slop < GAP // 4 or not 1 <= window <= GAP // 2:
        raise ValueError("window or slop too wide for the gap between documents")
    blocks, index, found = _ItemBlocks(items), None, None
    for number, block in enumerate(blocks.read()):
        words = [(name, w) for (name, _), w in zip(block, _tokens([t for _, t in block]), strict=True)
                 if len(w)]
        terms = np.unique(np.concatenate([w for _, w in words] or [np.zeros(1, np.int64)]))
        if number == 0:
            index = build_index(docs, key, terms if blocks.count == 1 else None)
        lists = index.where(F.col("kind") != ROW).select("kind", "segment", "term", "positions")
        if blocks.count > 1:
            asked = docs.sparkSession.createDataFrame(pd.DataFrame({"term": terms}))
            lists = lists.where(F.col("kind") == HEADER).unionByName(
                lists.where(F.col("kind") == POSTING).join(asked, "term", "left_semi"))
        hits = lists.groupBy("segment").applyInPandas(
            _lookup(words, window, slop), "segment long, ordinal long, item string, hit array<int>")
        found = hits if found is None else found.unionByName(hits)
    rows = index.where(F.col("kind") == ROW).select(
        "segment", F.col("term").alias("ordinal"), "key", F.col("n").alias("n_words"))
    exact = F.when(F.size("hit") > 0, F.col("item"))
    merged = found.groupBy("segment", "ordinal").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).cast("long").alias("n_hit"),
        F.sort_array(F.collect_set(exact)).alias("items"),
        F.sort_array(F.collect_set("item")).alias("near_items"))
    empty = F.array().cast("array<string>")
    return rows.join(merged, ["segment", "ordinal"], "left").select(
        "key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", empty).alias("items"), F.coalesce("near_items", empty).alias("near_items"))


def clean(docs: DataFrame, items: DataFrame, slop: int = 0) -> DataFrame:
    """The documents, all columns, in which no window of an item occurs, exactly or within ``slop``."""
    keyed = docs.select(F.struct("*").alias("doc"), text_key(F.col("text")).alias("key"))
    bad = occurrences(docs, items, text_key(F.col("text")), slop=slop).where("size(near_items) > 0")
    bad = materialise(bad.select("key").distinct(), "contaminated")
    return keyed.join(bad, "key", "left_anti").select("doc.*")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The per-document digest of exact hits, and of the items within ``SLOP`` (exact ones too)."""
    found = occurrences(docs, items, F.col("doc_id"), slop=SLOP)
    return found.select(
        F.col("key").alias("doc_id"), "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
        F.sha2(F.array_join("near_items", ","), 256).alias("near_items_sha256"))
