"""Exact merge-type (BPE) encoding of a SentencePiece vocabulary, by backtracking.

The merge rule joins, again and again, the adjacent pair whose union is the best-scored piece
(leftmost of equals).  A row of pieces is that rule's result exactly if every piece is the
result for its own characters and every two neighbours are the result for their union: what
happens inside a piece does not depend on what lies beyond its neighbours.  So the encoder
takes the longest piece that starts here (found by Aho-Corasick), asks whether it may follow
the piece before (by re-merging the two, remembered), goes on to the next shorter piece if
not, and steps back if none is left, marking the position in a bitfield as failed.

No piece goes on across a space that follows another character (checked when the vocabulary is
read), nor across two characters that no piece has side by side, so texts are encoded part by
part and the ids of frequent parts are remembered.
Characters without a piece become byte pieces.  Only vocabularies that leave the text as it is
(no normalisation but spaces, a space added in front, byte pieces) are accepted.

Scale: a pass over the texts without a shuffle; state per task is the vocabulary and a bounded
memory of parts (``REMEMBERED`` of at most ``LONGEST`` characters).

Defined results: a null text counts as empty; an empty text has the end id alone and decodes
to an empty text; rows are independent, so repeated rows and ids do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from eventloom.llm.text import map_texts

SPACE = "▁"
REMEMBERED, LONGEST, PAIRS = 500_000, 64, 1_000_000


class Vocabulary:
    """Pieces, scores and matching structures of a model file."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        byte = [model.is_byte(i) for i in range(size)]
        plain = [i for i in range(size)
                 if not (byte[i] or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: model.get_score(i) for i in plain}
        self.bytes = {int(self.pieces[i][3:-1], 16): i for i in range(size) if byte[i]}
        self.byte_ids = set(self.bytes.values())
        self.silent = {i for i in range(size) if model.is_control(i)}
        self.end = model.eos_id()
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece goes on across a space; words cannot be encoded alone")
        if len(self.bytes) != 256 or model.normalize(" a  b\tﬁ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}b\tﬁ":
            raise ValueError("the vocabulary changes the text or has no byte pieces")
        self.letters = {p for p in self.ids if len(p) == 1}
        self.pairs = {a + b for p in self.ids for a, b in pairwise(p)}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.traces: dict[str, tuple] = {}
        self.below: dict[str, str | None] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> tuple[list[str], tuple]:
        """The merge rule on a short text: its pieces, and the trace of its steps.

        The trace has, for each step, the score, and the first and last piece after it.
        """
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap: list[tuple[float, int, str, int]] = []
        scores, last = self.scores, len(parts) - 1
        levels, firsts, lasts = [], [parts[0]], [parts[-1]]

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (union := parts[a] + parts[b]) in scores:
                heapq.heappush(heap, (-scores[union], a, union, b))

        for i in range(last):
            offer(i, i + 1)
        while heap:
            score, a, union, b = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or right[a] != b or parts[a] + parts[b] != union:
                continue
            parts[a], parts[b], right[a] = union, None, right[b]
            if right[b] >= 0:
                left[right[b]] = a
            last = a if b == last else last
            levels.append(-score)
            firsts.append(parts[0])
            lasts.append(parts[last])
            offer(left[a], a)
            offer(a, right[a])
        return [p for p in parts if p is not None], (levels, firsts, lasts)

    def trace(self, piece: str) -> tuple | None:
        """The steps that make the piece; None if the rule never gives it."""
        if piece not in self.traces:
            parts, steps = self.merge(piece)
            self.traces[piece] = steps if parts == [piece] else None
        return self.traces[piece]

    def may_follow(self, a: str, b: str) -> bool:
        """Whether the merge rule keeps ``a`` and ``b`` apart: both are merged again, side by
        side, and no step across the border may come before the steps still open on its sides.
        """
        own, other = self.trace(a), self.trace(b)
        if own is None or other is None:
            return False
        (levels, _, lasts), (levels2, firsts, _) = own, other
        scores, i, j, n, m = self.scores, 0, 0, len(levels), len(levels2)
        while True:
            here = levels[i] if i < n else -math.inf
            there = levels2[j] if j < m else -math.inf
            across = scores.get(lasts[i] + firsts[j])
            # Of equal scores the leftmost goes first.
            if across is not None and across > here and across >= there:
                return False
            if i == n and j == m:
                return True
            if here >= there:
                i += 1
            else:
                j += 1

    def shorter(self, piece: str) -> str | None:
        """The longest piece that begins this one."""
        if piece not in self.below:
            self.below[piece] = next(
                (piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ids), None)
        return self.below[piece]

    def split(self, word: str) -> list[str]:
        """The pieces of a word all of whose characters have a piece."""
        size = len(word)
        longest: list[str | None] = [None] * (size + 1)
        for end, piece in self.automaton.iter(word):
            longest[end - len(piece) + 1] = piece  # of one start, later ends are longer
        failed = bytearray(size // 8 + 1)
        fits = self.fits
        found: list[str] = []
        at, piece, last = 0, longest[0], ""
        while at < size:
            while piece is not None:
                to = at + len(piece)
                if not failed[to >> 3] >> (to & 7) & 1:
                    pair = (last, piece)
                    ok = fits.get(pair)
                    if ok is None:
                        if len(fits) > PAIRS:
                            fits.clear()
                        ok = fits[pair] = (self.may_follow(last, piece) if last
                                           else self.trace(piece) is not None)
                    if ok:
                        break
                piece = self.shorter(piece)
            if piece is None:
                if not found:
                    raise AssertionError(f"no encoding of {word!r}")
                failed[at >> 3] |= 1 << (at & 7)
                piece = found.pop()
                at -= len(piece)
                last = found[-1] if found else ""
                piece = self.shorter(piece)
            else:
                found.append(piece)
                last = piece
                at += len(piece)
                piece = longest[at]
        return found

    def cut(self, word: str) -> list[str]:
        """The word in parts that no piece joins: cut between characters that stand side by side
        in no piece, but not between two without a piece, whose bytes are decoded together."""
        pairs, at, parts = self.pairs, 0, []
        for i, (a, b) in enumerate(pairwise(word), 1):
            if a + b not in pairs and (a in self.letters or b in self.letters):
                parts.append(word[at:i])
                at = i
        parts.append(word[at:])
        return parts

    def word_ids(self, word: str) -> list[int]:
        if self.letters.issuperset(word):
            return [self.ids[p] for p in self.split(word)]
        ids: list[int] = []
        start = 0
        for i, c in enumerate(word):
            if c not in self.ids:
                if start < i:
                    ids += [self.ids[p] for p in self.split(word[start:i])]
                ids += [self.bytes[b] for b in c.encode()]
                start = i + 1
        if start < len(word):
            ids += [self.ids[p] for p in self.split(word[start:])]
        return ids

    def text_of(self, ids: list[int]) -> str:
        """The text of ids, with every space: pieces joined, runs of byte pieces decoded."""
        pieces = [self.pieces[i] for i in ids]
        if not self.byte_ids.isdisjoint(ids):
            out, run = [], bytearray()
            for i, piece in zip([*ids, -1], [*pieces, ""], strict=True):
                if i in self.byte_ids:
                    run.append(int(piece[3:-1], 16))
                    continue
                if run:
                    out.append(run.decode(errors="replace"))
                    run = bytearray()
                out.append(piece)
            pieces = out
        return "".join(pieces).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        """The text of ids, as the library gives it: without the space added in front."""
        return self.text_of([i for i in ids if i not in self.silent]).removeprefix(" ")


#: A word: spaces, then what is no space; or spaces at the end.
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Encoder:
    """Encodes and decodes texts, remembering the frequent words."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.known: dict[str, tuple[str, int, str]] = {}

    def _word(self, word: str) -> tuple[str, int, str]:
        """(ids as text, how many, text of the pieces) of a word."""
        parts = self.vocabulary.cut(word)
        known = self.known
        told = [known.get(p) or self._part(p) for p in parts]
        if len(parts) == 1:
            return told[0]
        whole = (" ".join([t[0] for t in told]), sum([t[1] for t in told]),
                 "".join([t[2] for t in told]))
        if len(word) <= LONGEST:
            known[word] = whole
        return whole

    def _part(self, part: str) -> tuple[str, int, str]:
        v = self.vocabulary
        ids = v.word_ids(part)
        told = (" ".join(map(str, ids)), len(ids), v.text_of(ids))
        if len(part) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[part] = told
        return told

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids with the end id, ids as text, decoded text)."""
        v = self.vocabulary
        parts: list[tuple[str, int, str]] = []
        if text:
            known, word = self.known, self._word
            parts = [known.get(w) or word(w) for w in WORDS.findall(SPACE + text.replace(" ", SPACE))]
        ids = " ".join([*(p[0] for p in parts), str(v.end)])
        decoded = "".join([p[2] for p in parts])
        return sum([p[1] for p in parts]) + 1, ids, decoded.removeprefix(" ")


def _encode(model_file: str, keep_ids: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(Vocabulary(model_file))
            texts = batch.column("text")
            for at in range(0, batch.num_rows, 500):
                rows = [encoder.digest(t or "") for t in texts.slice(at, 500).to_pylist()]
                columns = [batch.column("doc").slice(at, 500), pa.array([r[0] for r in rows], pa.int64())]
                if keep_ids:
                    columns += [pa.array([list(map(int, r[1].split())) for r in rows], pa.list_(pa.int32())),
                                pa.array([r[2] for r in rows], pa.string())]
                else:
                    columns += [
                        pa.array([hashlib.sha256(r[k].encode()).hexdigest() for r in rows], pa.string())
                        for k in (1, 2)]
                names = ["doc", "n_tokens", *(("ids", "decoded") if keep_ids else
                                              ("ids_sha256", "decoded_sha256"))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return task


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """All columns of ``docs`` as ``doc``, with n_tokens, ids and the decoded text."""
    from pyspark.sql import functions as F

    packed = docs.select(F.struct("*").alias("doc"), "text")
    kind = packed.schema["doc"].dataType.simpleString()
    return map_texts(packed, _encode(model_file, True),
        f"doc {kind}, n_tokens long, ids array<int>, decoded string")


def report(docs: DataFrame, model_file: str) -> DataFrame:
    """Per document: doc_id, n_tokens and digests of the ids and of the decoded text."""
    from pyspark.sql import functions as F

    narrow = docs.select(F.col("doc_id").alias("doc"), "text")
    kind = narrow.schema["doc"].dataType.simpleString()
    told = map_texts(narrow, _encode(model_file, False),
        f"doc {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return told.withColumnRenamed("doc", "doc_id")
