"""Quality rules with an n-gram model: modified Kneser-Ney over bytes, one model a language.

Spark counts the n-grams of ``ORDER`` bytes of every document, language by language, and
derives from them all the model needs: continuation counts of the shorter n-grams, the counts
of counts behind the three discounts, and the weight that each context leaves to shorter ones.
A model is kept as sorted arrays of n-gram codes with their log-probabilities and is looked up
by binary search.  A document's perplexity is that of its bytes; documents outside the band of
their language are rejected.  The band is ``FENCE`` interquartile ranges of the log-perplexity
beyond the quartiles of the documents that pass the base rules, and wider for short texts by
``SAMPLING`` over the root of their bytes, the error of a mean.

Bytes rather than words: their n-grams are few and grow slowly with the corpus, so whole models
can be held by every task, in any language, while word n-grams of random prose would not fit
the disk allowed for this job.

Scale: each task sums its n-grams before the shuffle; the documents are read twice (counts,
scores) and never shuffled.  Models reach the tasks only if they have at most
``MOST_ENTRIES`` entries together (12 bytes each); beyond that the job stops and says so, and
a lower ``order`` is the remedy, since no n-gram may be dropped.

Defined results: a null text has no words and fails the base rules, as does any text of fewer
than ten words; a null ``lang`` is a language of its own; a language whose documents are all
alike has an empty spread, so only its own perplexity passes, with ``SLACK`` to spare; repeated
rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.text import (
    IS_SOLID,
    Hasher,
    buffers,
    map_texts,
    mix,
    runs,
    slices,
    split_words,
    windows,
)
from eventloom.session import materialise

ORDER = 4
FENCE, SLACK, SAMPLING = 3.0, 0.05, 2.0
MOST_ENTRIES = 5_000_000
SYMBOLS = b"#*$%&|<>"
REPEAT, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
NO_LANGUAGE = ""


def _symbol_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(SYMBOLS)] = True
    return table


IS_SYMBOL = _symbol_table()


def codes(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code of the n-gram that ends at each byte, and each byte's place in its text.

    The first bytes of a text look back on zero bytes.
    """
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    code = data.astype(np.uint32)
    for j in range(1, order):
        back = np.zeros(len(data), dtype=np.uint32)
        back[j:] = data[:-j]
        back[place < j] = 0
        code |= back << np.uint32(8 * j)
    return code, place


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code = np.concatenate([c for c, _ in parts])
    n = np.concatenate([n for _, n in parts])
    code, at = np.unique(code, return_inverse=True)
    return code, np.bincount(at, weights=n, minlength=len(code)).astype(np.int64)


def _count(order: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for piece in (p for b in batches for p in slices(b, "text", 4 << 20)):
            data, offsets = buffers(piece.column("text"))
            code, _ = codes(data, offsets, order)
            names = piece.column("lang").to_pylist()
            lengths = np.diff(offsets)
            for lang in sorted(set(names)):
                own = np.repeat(np.array([x == lang for x in names]), lengths)
                parts = total.setdefault(lang, [])
                parts.append(np.unique(code[own], return_counts=True))
                if len(parts) >= 8:
                    total[lang] = [_merged(parts)]
        for lang, parts in total.items():
            code, n = _merged(parts)
            for at in range(0, len(code), 100_000):
                part = code[at:at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array(part.astype(np.int64)),
                     pa.array(n[at:at + 100_000], pa.int64())], names=["lang", "code", "n"])

    return task


def _discounts(rows: DataFrame) -> DataFrame:
    """lang, d1, d2, d3 of modified Kneser-Ney from counts ``n``."""
    of = rows.groupBy("lang").agg(*(
        F.sum(F.when(F.col("n") == k, 1.0).otherwise(0.0)).alias(f"t{k}") for k in range(1, 5)))
    y = F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2"))

    def d(k: int) -> Column:
        value = k - (k + 1) * y * F.try_divide(F.col(f"t{k + 1}"), F.col(f"t{k}"))
        # Without counts of counts to go by, half of a count is set aside.
        usable = (F.col("t1") > 0) & (F.col(f"t{k}") > 0) & (value > 0) & (value < k)
        return F.when(usable, value).otherwise(F.lit(0.5))

    return of.select("lang", *(d(k).alias(f"d{k}") for k in range(1, 4)))


def train(docs: DataFrame, order: int = ORDER) -> dict[str, list[tuple]]:
    """Per language, for orders 1 up: (codes, log-probabilities, contexts, log-weights)."""
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text") \
        .where("octet_length(text) > 0")
    counted = map_texts(texts, _count(order), "lang string, code long, n long") \
        .groupBy("lang", "code").agg(F.sum("n").alias("n"))
    levels = [materialise(counted, "ngrams")]
    for k in range(order - 1, 0, -1):
        # How many different bytes come before the shorter n-gram.
        shorter = levels[0].groupBy("lang", F.col("code").bitwiseAND(F.lit((1 << 8 * k) - 1))
                                    .alias("code")).agg(F.count(F.lit(1)).alias("n"))
        levels.insert(0, materialise(shorter, "ngrams"))
    if (size := sum(level.count() for level in levels)) > MOST_ENTRIES:
        raise ValueError(f"{size} n-grams are too many for one task; train with a lower order")
    models: dict[str, list[tuple]] = {}
    for k, level in enumerate(levels, 1):
        context = F.shiftright("code", 8)
        rows = level.join(_discounts(level), "lang")
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")) \
            .otherwise(F.col("d3"))
        rows = rows.select("lang", "code", "n", off.alias("off"), context.alias("context"))
        sums = rows.groupBy("lang", "context").agg(
            F.sum("n").alias("total"), F.sum("off").alias("freed"))
        found = rows.join(sums, ["lang", "context"]).select(
            "lang", "code", "context", ((F.col("n") - F.col("off")) / F.col("total")).alias("own"),
            (F.col("freed") / F.col("total")).alias("left"))
        for lang, part in found.toPandas().groupby("lang", sort=True):
            part = part.sort_values("code")
            code = part["code"].to_numpy(dtype=np.uint32)
            own, left = part["own"].to_numpy(), part["left"].to_numpy()
            if k == 1:
                lower = np.full(len(code), 1 / 256)
            else:
                lower = np.exp(look_up(models[lang], code & np.uint32((1 << 8 * (k - 1)) - 1), k - 1))
            contexts, at = np.unique(part["context"].to_numpy(dtype=np.uint32), return_index=True)
            models.setdefault(lang, []).append(
                (code, np.log(own + left * lower).astype(np.float32),
                 contexts, np.log(left[at]).astype(np.float32)))
    return models


def look_up(model: list[tuple], code: np.ndarray, order: int) -> np.ndarray:
    """Log-probability of the last byte of each n-gram of ``order`` bytes."""
    if order == 0:
        return np.full(len(code), -np.log(256.0), dtype=np.float32)
    known, value, contexts, weight = model[order - 1]
    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
    out = value[at]
    missing = np.flatnonzero(known[at] != code)
    if len(missing):
        rest = code[missing]
        before = rest >> np.uint32(8)
        where = np.minimum(np.searchsorted(contexts, before), len(contexts) - 1)
        left = np.where(contexts[where] == before, weight[where], np.float32(0))
        shorter = rest & np.uint32((1 << 8 * (order - 1)) - 1)
        out[missing] = left + look_up(model, shorter, order - 1)
    return out


def _repeated(words, rows: int) -> np.ndarray:
    """Words of each row that lie in a window found twice or more in that row."""
    at, code = windows(words.code, words.row, REPEAT)
    if not len(at):
        return np.zeros(rows, dtype=np.int64)
    own = mix(code + words.row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    again = np.zeros(len(at), dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edge = np.zeros(len(words.code) + 1, dtype=np.int64)
    np.add.at(edge, at[again], 1)
    np.add.at(edge, at[again] + REPEAT, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(words.row[covered], minlength=rows)


def _repeated_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip("\x20\t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _score(models: dict[str, list[tuple]], order: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for piece in (p for b in batches for p in slices(b, "text")):
            column, rows = piece.column("text"), piece.num_rows
            words = split_words(column, hasher, IS_SOLID, fold=False)
            data, offsets = words.data, words.offsets
            lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            chars = np.bincount(words.row, weights=lead[words.end] - lead[words.start], minlength=rows)
            marks = np.concatenate([[0], np.cumsum(IS_SYMBOL[data])])
            code, _ = codes(data, offsets, order)
            names = piece.column("lang").to_pylist()
            log = np.zeros(len(data) + 1)
            own = np.array([x if x in models else None for x in names], dtype=object)
            bytes_of = np.repeat(np.arange(rows), np.diff(offsets))
            for lang in {x for x in own if x is not None}:
                here = np.flatnonzero((own == lang)[bytes_of])
                log[here + 1] = look_up(models[lang], code[here], order)
            total = np.cumsum(log)
            size = np.diff(offsets)
            loss = np.where(size > 0, -(total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1), 0)
            counts = np.diff(runs(words.row, rows))
            yield pa.RecordBatch.from_arrays([
                piece.column("doc"), piece.column("lang"), pa.array(counts, pa.int64()),
                pa.array(chars.astype(np.int64)),
                pa.array((marks[offsets[1:]] - marks[offsets[:-1]]).astype(np.int64)),
                pa.array([_repeated_lines(t) for t in column.to_pylist()], pa.int64()),
                pa.array(_repeated(words, rows), pa.int64()), pa.array(size, pa.int64()),
                pa.array(loss, pa.float64()),
            ], names=["doc", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                      "n_repeat_words", "n_bytes", "log_perplexity"])

    return task


def score(docs: DataFrame, keep: Column, order: int = ORDER) -> DataFrame:
    """doc (as ``keep`` says), the base counts, base_failed, log_perplexity, its band and kept."""
    models = train(docs, order)
    narrow = docs.select(keep.alias("doc"), F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text")
    kind = narrow.schema["doc"].dataType.simpleString()
    told = map_texts(narrow, _score(models, order),
        f"doc {kind}, lang string, n_words long, word_chars long, n_symbols long, "
        "n_dup_lines long, n_repeat_words long, n_bytes long, log_perplexity double")
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    told = materialise(told.withColumn("base_failed", failed), "scores")
    quartiles = F.percentile_approx("log_perplexity", [0.25, 0.75], 10_000)
    bands = told.where("not base_failed").groupBy("lang").agg(quartiles.alias("q"))
    width = F.lit(FENCE) * (F.col("q")[1] - F.col("q")[0]) + SLACK
    bands = bands.select("lang", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"),
                         width.alias("width"))
    error = F.lit(SAMPLING) / F.sqrt(F.greatest("n_bytes", F.lit(1)))
    told = told.join(bands, "lang", "left").withColumns({
        "band_low": F.col("q1") - F.col("width") - error,
        "band_high": F.col("q3") + F.col("width") + error})
    inside = F.col("log_perplexity").between(F.col("band_low"), F.col("band_high"))
    return told.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def report(docs: DataFrame) -> DataFrame:
    """Per document: the base counts, the perplexity with its band, and the verdict."""
    return score(docs, F.col("doc_id")).select(
        F.col("doc").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept", F.exp("log_perplexity").alias("perplexity"),
        F.exp("band_low").alias("perplexity_low"), F.exp("band_high").alias("perplexity_high"))
