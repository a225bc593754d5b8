"""Secret scans by a trigram inverted index.

For every rule a Boolean query over trigrams is derived from its pattern: all trigrams that any
match must contain, with alternatives where the pattern has them.  The corpus is indexed in
blocks of ``BLOCK`` texts: one row per block and trigram with the texts that contain it.
A rule's query intersects and unites those postings block by block; only the texts that
remain are scanned with the rule.  A rule without mandatory trigrams scans every text.

Texts are known by a 64-bit hash: two texts of one hash would at worst be scanned in vain.
The index is over ASCII lower case, so it also serves patterns that ignore case.

Scale: indexing is one pass without a shuffle; postings of the queries' trigrams alone are
grouped by block, all of bounded size; candidates (hash, rules) are pre-aggregated and joined
to the texts, by a shuffle only if Spark finds them too large to broadcast, hot texts being
split.  The scan is one more pass over the texts.

Defined results: a null text counts as empty and has no spans; rows are independent, so
repeated rows and ids get a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import product
from re import _constants as op
from re import _parser
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.text import FOLD, buffers, map_texts, slices
from eventloom.session import materialise

BLOCK = 2048
#: A set of exact strings is followed while it has at most so many members.
MOST_EXACT = 64
DIRECTORY = -1


class Rule(NamedTuple):
    """A kind of secret; ``group`` must have ``least`` characters (0: the whole match)."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The three base rules of the contract.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Well-known public token formats.
FORMATS = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("url_login", r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]+@"),
)
RULES = BASE + FORMATS

# A query is True (any text), a trigram, or ("and" | "or", parts).
Query = bool | str | tuple


def _all(parts: list[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    """What a text must contain if it contains one of the strings."""
    return _any([_all([s[i:i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _lower(code: int) -> str | None:
    """The folded character; None if it is not ASCII and is not followed exactly."""
    return chr(code).lower() if code < 128 else None


def _members(items: list) -> set[str] | None:
    """Folded characters of a class, or None if they are many or unknown."""
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            codes = [value]
        elif kind is op.RANGE and value[1] - value[0] < 16:
            codes = list(range(value[0], value[1] + 1))
        else:
            return None
        found = {_lower(c) for c in codes}
        if None in found:
            return None
        out |= found
    return out if len(out) <= 16 else None


def _analyse(nodes) -> tuple[set[str] | None, Query]:
    """(the exact strings a match can be, or None; what any match must contain)."""
    known: set[str] = {""}
    exact, needs = True, []

    def cut() -> None:
        nonlocal known, exact
        needs.append(_of_strings(known))
        known, exact = {""}, False

    for kind, value in nodes:
        if kind is op.LITERAL and (c := _lower(value)) is not None:
            strings: set[str] | None = {c}
            need: Query = True
        elif kind is op.IN:
            strings, need = _members(value), True
        elif kind is op.SUBPATTERN:
            strings, need = _analyse(value[3])
        elif kind is op.BRANCH:
            sides = [_analyse(side) for side in value[1]]
            whole = all(s is not None for s, _ in sides)
            strings = set().union(*(s for s, _ in sides)) if whole else None
            need = _any([_of_strings(s) if s is not None else q for s, q in sides])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = value
            own, q = _analyse(inner)
            if own is not None and least == 0 and most == 1:
                strings, need = own | {""}, True
            elif own is not None and least == most and len(own) ** least <= MOST_EXACT:
                strings, need = {"".join(p) for p in product(sorted(own), repeat=least)}, True
            else:
                strings, need = None, q if least and own is None else True
                if own is not None and least:
                    need = _of_strings(own)
        elif kind is op.AT:
            continue
        else:
            strings, need = None, True
        needs.append(need)
        if strings is None:
            cut()
        elif len(known) * len(strings) <= MOST_EXACT:
            known = {a + b for a in known for b in strings}
        else:
            cut()
            known = set(strings) if len(strings) <= MOST_EXACT else {""}
    if exact:
        return known, _all([*needs, _of_strings(known)])
    return None, _all([*needs, _of_strings(known)])


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every text with a match of ``pattern`` satisfies."""
    return _analyse(_parser.parse(pattern))[1]


def _trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


def _number(trigram: str) -> int:
    a, b, c = trigram.encode("ascii")
    return a << 16 | b << 8 | c


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, trigram, which texts of the block contain it); one directory row a block."""
    task, number = TaskContext.get().partitionId() << 24, 0
    pairs, codes, texts = [], [], 0

    def close() -> Iterator[pa.RecordBatch]:
        pair = np.concatenate(pairs)
        pair.sort()
        trigram, text = pair >> 12, (pair & 0xFFF).astype(np.uint16)
        first = np.flatnonzero(np.diff(trigram, prepend=-1))
        last = np.append(first[1:], len(trigram))
        blobs = [text[a:b].tobytes() for a, b in zip(first, last, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(first) + 1, task + number, np.int64)),
             pa.array(np.concatenate([[DIRECTORY], trigram[first]]), pa.int32()),
             pa.array([np.concatenate(codes).tobytes(), *blobs], pa.binary())],
            names=["block", "trigram", "texts"])

    for piece in (p for b in batches for p in slices(b, "text")):
        data, offsets = buffers(piece.column("text"))
        code = piece.column("code").to_numpy()
        low = FOLD[data].astype(np.int64)
        grams = low[:-2] << 16 | low[1:-1] << 8 | low[2:] if len(low) > 2 else low[:0]
        for at in range(0, piece.num_rows, BLOCK):
            for i in range(at, min(at + BLOCK, piece.num_rows)):
                if texts == BLOCK:
                    yield from close()
                    pairs, codes, texts, number = [], [], 0, number + 1
                own = np.unique(grams[offsets[i]:max(offsets[i + 1] - 2, offsets[i])])
                pairs.append(own << 12 | texts)
                codes.append(code[i:i + 1])
                texts += 1
    if texts:
        yield from close()


def build_index(docs: DataFrame) -> DataFrame:
    """The trigram index of ``docs.text`` as a written table."""
    narrow = docs.select("text", F.xxhash64("text").alias("code"))
    index = map_texts(narrow, _index, "block long, trigram int, texts binary")
    return materialise(index, "trigrams")


def _evaluate(query: Query, postings: dict[int, np.ndarray]) -> np.ndarray:
    none = np.zeros(0, dtype=np.uint16)
    if isinstance(query, str):
        return postings.get(_number(query), none)
    parts = [_evaluate(q, postings) for q in query[1]]
    if query[0] == "or":
        return np.unique(np.concatenate(parts))
    parts.sort(key=len)
    out = parts[0]
    for p in parts[1:]:
        if not len(out):
            break
        out = np.intersect1d(out, p, assume_unique=True)
    return out


def candidates(index: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """code, rules: for each text that satisfies a query, the bits of the satisfied queries."""
    numbers = sorted({_number(t) for q in queries.values() for t in _trigrams(q)})

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        postings = {t: np.frombuffer(b, np.uint16)
                    for t, b in zip(rows["trigram"], rows["texts"], strict=True) if t != DIRECTORY}
        code = np.frombuffer(rows.loc[rows["trigram"] == DIRECTORY, "texts"].iloc[0], np.int64)
        bits = np.zeros(len(code), dtype=np.int64)
        for rule, query in queries.items():
            bits[_evaluate(query, postings)] |= 1 << rule
        found = np.flatnonzero(bits)
        return pd.DataFrame({"code": code[found], "rules": bits[found]})

    asked = index.where(F.col("trigram").isin([DIRECTORY, *numbers]))
    return asked.groupBy("block").applyInPandas(block, "code long, rules long") \
        .groupBy("code").agg(F.bit_or("rules").alias("rules"))


def _scan(rules: tuple[Rule, ...], always: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [re.compile(r.pattern, re.ASCII) for r in rules]
        for batch in batches:
            for piece in slices(batch, "text"):
                spans = []
                for text, bits in zip(piece.column("text").to_pylist(),
                                      piece.column("rules").to_pylist(), strict=True):
                    found = []
                    for k, (rule, pattern) in enumerate(zip(rules, patterns, strict=True)):
                        if text and (bits | always) >> k & 1:
                            found += [(m.start(), k, m.end()) for m in pattern.finditer(text)
                                      if len(m[rule.group]) >= rule.least]
                    found.sort()
                    spans.append([(rules[k].kind, a, b) for a, k, b in found])
                kinds = pa.array([[s[0] for s in x] for x in spans], pa.list_(pa.string()))
                starts = pa.array([[s[1] for s in x] for x in spans], pa.list_(pa.int64()))
                ends = pa.array([[s[2] for s in x] for x in spans], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([piece.column("doc"), kinds, starts, ends],
                                                 names=["doc", "kinds", "starts", "ends"])

    return task


def scan(docs: DataFrame, keep: Column, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc (as ``keep`` says) and its spans in order: kinds, starts, ends (code points)."""
    queries = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not True}
    always = sum(1 << k for k in range(len(rules)) if k not in queries)
    found = materialise(candidates(build_index(docs), queries), "candidates")
    texts = docs.select(keep.alias("doc"), "text", F.xxhash64("text").alias("code"))
    kind = texts.schema["doc"].dataType.simpleString()
    marked = texts.join(found, "code", "left").select(
        "doc", "text", F.coalesce("rules", F.lit(0).cast("long")).alias("rules"))
    return map_texts(
        marked, _scan(rules, always),
        f"doc {kind}, kinds array<string>, starts array<long>, ends array<long>")


def report(docs: DataFrame) -> DataFrame:
    """Per document: counts and digest of the base spans, and all spans."""
    told = scan(docs, F.col("doc_id")).withColumn("all", F.transform(
        F.arrays_zip("kinds", "starts", "ends"),
        lambda s: F.struct(s["kinds"].alias("kind"), F.concat_ws(
            ":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string")).alias("span"))))
    base = [r.kind for r in BASE]
    own = F.filter("all", lambda s: s["kind"].isin(base))
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long")
    return told.select(
        F.col("doc").alias("doc_id"), *(count(k).alias(f"n_{k}") for k in base),
        F.sha2(F.array_join(F.transform(own, lambda s: s["span"]), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("all", lambda s: s["span"]), ",").alias("spans"))
