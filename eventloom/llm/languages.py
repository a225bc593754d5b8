"""Language identification as a mixture of languages.

Each language is a distribution over ``2 ** BITS`` hashed byte n-grams of the letters of its
training texts.  A document's n-grams are explained by a mixture of languages, whose
proportions expectation-maximisation estimates.  The set of languages is chosen by penalised
likelihood: starting from all, the language with the least share is left out for as long as
the log-likelihood falls by less than ``PENALTY`` times the log of the n-gram count, half a
parameter's cost in the Bayesian information criterion being the default.

Scale: counts are summed per task before the shuffle, so what moves is at most tasks x
languages x 2 ** BITS numbers; the model (languages x 2 ** BITS floats, 256 kB a language) is
all that reaches the driver.  Prediction is one pass without a shuffle.  A text's working set
is its own bytes.

Defined results: a text that is null or has no letter is ``und`` with score 0; if nothing was
learned every text is ``und``; more than ``MOST_LANGUAGES`` languages are an error; equal shares go to the language first in the alphabet; repeated
rows count as often as they occur; a null ``lang`` or text teaches nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.text import FOLD, buffers, map_texts, slices

BITS, ORDER = 16, 3
PENALTY, STEPS, TOLERANCE = 0.5, 30, 1e-4
#: Two models of 64 languages fit into 32 MB; more languages than that are refused.
MOST_LANGUAGES = 1024
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Bytes as they are counted: letters lower-cased, all else one space."""
    table = FOLD.copy()
    for b in range(0x80):
        if not chr(b).isalpha():
            table[b] = 0x20
    return table


FACE = _letters()


def grams(data: np.ndarray) -> np.ndarray:
    """Slots of the n-grams of one text, runs of non-letters counted as one space."""
    face = FACE[data]
    keep = np.ones(len(face), dtype=bool)
    keep[1:] = (face[1:] != 0x20) | (face[:-1] != 0x20)
    face = np.concatenate([[0x20], face[keep], [0x20]]).astype(np.uint32)
    code = np.zeros(max(len(face) - ORDER + 1, 0), dtype=np.uint32)
    for j in range(ORDER):
        code = (code << np.uint32(8)) | face[j:len(face) - ORDER + 1 + j]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for piece in (p for b in batches for p in slices(b, "text")):
        data, offsets = buffers(piece.column("text"))
        for i, lang in enumerate(piece.column("lang").to_pylist()):
            own = total.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
            own += np.bincount(grams(data[offsets[i]:offsets[i + 1]]), minlength=1 << BITS)
    for lang, counts in total.items():
        slot = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(slot), pa.string()), pa.array(slot, pa.int64()),
             pa.array(counts[slot], pa.int64())], names=["lang", "slot", "n"])


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their distributions, from all rows of ``docs`` (text, lang)."""
    known = docs.select("text", "lang").where("text is not null and lang is not null")
    counts = map_texts(known, _count, "lang string, slot long, n long") \
        .groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    # One row a language: its slots and counts.
    rows = counts.groupBy("lang").agg(F.collect_list("slot").alias("slots"),
                                      F.collect_list("n").alias("counts"))
    found = rows.orderBy("lang").limit(MOST_LANGUAGES + 1).toPandas()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    model = np.full((1 << BITS, len(found)), 0.5)
    for k, (slots, n) in enumerate(zip(found["slots"], found["counts"], strict=True)):
        model[np.asarray(slots, dtype=np.int64), k] += np.asarray(n, dtype=np.float64)
    return found["lang"].tolist(), (model / model.sum(axis=0, keepdims=True)).astype(np.float32)


def _fit(p: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of the columns of ``p`` that best explain counts ``n``, and the log-likelihood."""
    total = n.sum()
    for _ in range(STEPS):
        mixed = p @ share
        new = share * ((n / mixed) @ p) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < TOLERANCE:
            break
    return share, float(n @ np.log(p @ share))


def mixture(slots: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, float]:
    """Share of each language in a text, zero for those outside the chosen set, and how well
    they explain it: log-likelihood per n-gram above that of slots drawn evenly."""
    counts = np.bincount(slots, minlength=len(model))
    slot = np.flatnonzero(counts)
    n = counts[slot].astype(np.float64)
    p = model[slot].astype(np.float64)
    chosen = np.arange(model.shape[1])
    share, fit = _fit(p, n, np.full(len(chosen), 1 / len(chosen)))
    cost = PENALTY * np.log(n.sum() + 1)
    while len(chosen) > 1:
        # The last of equal least shares goes first, so that ties keep the alphabet's order.
        least = len(chosen) - 1 - int(np.argmin(share[::-1]))
        rest = np.delete(np.arange(len(chosen)), least)
        start = share[rest] + 1e-9
        new, left = _fit(p[:, chosen[rest]], n, start / start.sum())
        if fit - left > cost:
            break
        chosen, share, fit = chosen[rest], new, left
    out = np.zeros(model.shape[1])
    out[chosen] = share
    return out, fit / n.sum() + BITS * float(np.log(2))


def _predict(languages: list[str], model: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for b in batches for p in slices(b, "text")):
            data, offsets = buffers(piece.column("text"))
            texts = piece.column("text").to_pylist()
            names, scores, shares, fits = [], [], [], []
            for i, text in enumerate(texts):
                if not languages or not text or not any(map(str.isalpha, text)):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    shares.append({})
                    fits.append(None)
                    continue
                share, fit = mixture(grams(data[offsets[i]:offsets[i + 1]]), model)
                best = int(np.argmax(share))
                names.append(languages[best])
                scores.append(min(1.0, float(share[best])))
                shares.append({languages[k]: float(share[k]) for k in np.flatnonzero(share)})
                fits.append(fit)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc"), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                 pa.array([list(s.items()) for s in shares], pa.map_(pa.string(), pa.float64())),
                 pa.array(fits, pa.float64())],
                names=["doc", "lang_pred", "score", "shares", "fit"])

    return task


def predict(docs: DataFrame, languages: list[str], model: np.ndarray, keep: Column) -> DataFrame:
    """doc (as ``keep`` says), lang_pred, score (its share), the shares of the chosen set, and fit."""
    narrow = docs.select(keep.alias("doc"), "text")
    kind = narrow.schema["doc"].dataType.simpleString()
    return map_texts(narrow, _predict(languages, model),
        f"doc {kind}, lang_pred string, score double, shares map<string,double>, fit double")


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, and the share of each language found."""
    languages, model = train(docs.where(~held_out(F.col("doc_id"))))
    told = predict(docs, languages, model, F.col("doc_id"))
    return told.select(F.col("doc").alias("doc_id"), held_out(F.col("doc")).alias("held_out"),
                       "lang_pred", "score", "shares")


def keep_known(docs: DataFrame, least_fit: float = 0.0) -> DataFrame:
    """The documents, all columns, that known languages explain, alone or mixed in any shares.

    Rejected: ``und``, and texts that the chosen languages explain no better than n-grams drawn
    evenly from all slots would be, by ``least_fit`` a gram.
    """
    languages, model = train(docs.where(~held_out(F.col("doc_id"))))
    told = predict(docs, languages, model, F.struct("*"))
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("fit") > least_fit)).select("doc.*")
