"""Packing of token sequences by the dot-product heuristic for vector bins.

A piece is a vector (tokens, 1 segment, loss-bearing tokens); a sequence is a
bin with a limit on each.  The piece that has waited longest opens it; then, among the
waiting pieces that fit, the one with the largest dot product of its
(capacity-scaled) vector with the sequence's free capacity goes in next: large pieces
first, and pieces rich in whatever the sequence has most room for.  When none fits
whole, the best one is cut so that the sequence is exactly full.

A sequence is filled when the waiting pieces can fill it: when they hold its tokens, or
as many pieces as it may have.  If the limit on segments or loss tokens ends it before
it is full, it is cut back to a power of two, which needs no padding, and the rest waits
again.

Every task packs the rows it reads, with a bounded pool of waiting pieces, so
nothing is shuffled and a lost task packs the same rows again to the same
sequences (ids hold the partition number).  What is left at the end of a task is
cut into sequences whose lengths are powers of two, too.  With ``order_cols`` rows
are first dealt to range partitions in that order (one shuffle of the texts), and
sequences are numbered in the order of their earliest document.

Defined results: NULL or empty text is one piece holding the end token only;
NULL ``doc_id`` passes through; repeated rows are packed each on their own; very long
texts are cut into full sequences and a rest, one text in memory at a time; of equal
dot products the first piece of the pool goes in; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q
from .common import Recent
from .token_counts import byte_alphabet

SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, "
          "sequence_id long, offset long")
FLUSH_BYTES = 4 << 20


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold at most; ``pool`` pieces wait in a task at a time, or a sequence's segments if more."""

    tokens: int = 4096
    segments: int = 512
    loss_tokens: int = 4096
    pool: int = 256


#: Fixed value: the pre-tokens of the vocabulary with word ends.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
BYTE_LETTERS = {b: c for c, b in byte_alphabet().items()}


class WordIds:
    """Token ids of a text, as little-endian unsigned 32-bit bytes.

    The tokenizer's normaliser and pre-tokenizer never look across ASCII white
    space, so a text's ids are those of its words in turn; the ids of the words
    and pre-tokens seen last are kept.  Words of Latin letters below U+0250 are
    unchanged by NFC and lower-cased character by character, so only their
    pre-tokens go to the tokenizer's model; all other words go to the whole
    tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words, self.parts = Recent(self._word), Recent(self._part)

    def _part(self, part: str) -> bytes:
        raw = part if part.isascii() else "".join([BYTE_LETTERS[b] for b in part.encode()])
        return array("I", [t.id for t in self.model.tokenize(raw)]).tobytes()

    def _word(self, raw: bytes) -> bytes:
        word = raw.decode("utf-8", "replace")
        if word.isprintable() and max(word) < "\u0250" and not ("<" in word and any(s in word for s in self.special)):
            word = word.lower()
            if word.isalpha():
                return self.parts[word]
            return b"".join([self.parts[p] for p in PRE_TOKENS.findall(word)])
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, text.split()))


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One tokenizer per Python worker and file."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: bytes
    doc_tokens: int
    loss_from: int

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    @property
    def loss(self) -> int:
        return max(0, self.start + self.length - max(self.start, self.loss_from))

    def cut(self, length: int) -> tuple[Piece, Piece]:
        a, b = self.ids[:4 * length], self.ids[4 * length:]
        return (Piece(self.doc_id, self.start, a, self.doc_tokens, self.loss_from),
                Piece(self.doc_id, self.start + length, b, self.doc_tokens, self.loss_from))

    def longest(self, tokens: int, loss: int) -> int:
        """Length of the longest prefix within both limits."""
        return min(self.length, tokens, max(0, self.loss_from - self.start) + loss)


class Packer:
    """Packs a stream of pieces; ``add`` and ``finish`` yield (sequence number, offset, piece)."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.room = max(limits.pool, limits.segments)
        self.pool: list[Piece] = []
        self.waiting = 0  # tokens in the pool
        self.vectors = np.zeros((self.room + 2, 3))
        self.since = np.zeros(self.room + 2)  # turn in which the piece came
        self.turn = 0
        self.capacity = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=float)
        self.sequence = 0

    def _push(self, piece: Piece, since: float | None = None) -> None:
        at = len(self.pool)
        if at == len(self.vectors):
            self.vectors, self.since = np.concatenate((self.vectors,) * 2), np.concatenate((self.since,) * 2)
        self.turn += 1
        self.vectors[at], self.since[at] = (piece.length, 1, piece.loss), self.turn if since is None else since
        self.pool.append(piece)
        self.waiting += piece.length

    def _take(self, k: int) -> tuple[Piece, float]:
        piece, since, last = self.pool[k], self.since[k], self.pool.pop()
        at = len(self.pool)
        if k < at:
            self.pool[k], self.vectors[k], self.since[k] = last, self.vectors[at], self.since[at]
        self.waiting -= piece.length
        return piece, float(since)

    def _chosen(self, tokens: int) -> list[tuple[Piece, float]]:
        """Pieces for one sequence of at most ``tokens`` tokens."""
        free = np.array([tokens, self.limits.segments, self.limits.loss_tokens], dtype=float)
        out: list[tuple[Piece, float]] = []
        while self.pool and free[0] > 0 and free[1] > 0:
            v = self.vectors[:len(self.pool)]
            score = (v / self.capacity) @ (free / self.capacity)
            fits = (v <= free).all(axis=1)
            k = int(np.argmin(self.since[:len(self.pool)])) if not out else -1  # the first one has waited longest
            if k < 0 and fits.any():
                k = int(np.argmax(np.where(fits, score, -1.0)))
            if k >= 0 and fits[k]:
                piece, since = self._take(k)
            else:
                k = int(np.argmax(score)) if k < 0 else k
                length = self.pool[k].longest(int(free[0]), int(free[2]))
                if length <= 0:
                    break
                whole, since = self._take(k)
                piece, rest = whole.cut(length)
                self._push(rest, since)
            out.append((piece, since))
            free -= (piece.length, 1, piece.loss)
        return out

    def _fill(self, tokens: int) -> Iterator[tuple[int, int, Piece]]:
        """One sequence of ``tokens`` tokens, or of a power of two below where another limit ends it."""
        chosen = self._chosen(tokens)
        total = sum(p.length for p, _ in chosen)
        spare = total - (tokens if total >= tokens else 1 << (total.bit_length() - 1))
        while spare > 0:
            piece, since = chosen.pop()
            if piece.length > spare:
                piece, rest = piece.cut(piece.length - spare)
                chosen.append((piece, since))
                self._push(rest, since)
                break
            self._push(piece, since)
            spare -= piece.length
        offset = 0
        for piece, _ in chosen:
            yield self.sequence, offset, piece
            offset += piece.length
        self.sequence += 1

    def _ready(self) -> bool:
        return len(self.pool) >= self.room or (self.waiting >= self.limits.tokens and len(self.pool) >= self.limits.pool)

    def add(self, piece: Piece) -> Iterator[tuple[int, int, Piece]]:
        whole = self.limits.tokens
        while piece.length > whole or piece.loss > self.limits.loss_tokens:
            head, piece = piece.cut(piece.longest(whole, self.limits.loss_tokens))
            if head.length == whole:  # a full sequence of its own
                yield self.sequence, 0, head
                self.sequence += 1
            else:
                self._push(head)
                while self._ready():
                    yield from self._fill(whole)
        self._push(piece)
        while self._ready():
            yield from self._fill(whole)

    def finish(self) -> Iterator[tuple[int, int, Piece]]:
        while self.pool:
            yield from self._fill(min(self.limits.tokens, 1 << (self.waiting.bit_length() - 1)))


def _pack_batches(batches: Iterable[pa.RecordBatch], path: str, end_id: int, limits: Limits) -> Iterator[pa.RecordBatch]:
    encode, packer = word_ids(path), Packer(limits)
    end = np.array([end_id], dtype="<u4").tobytes()
    base = TaskContext.get().partitionId() << 36
    out: list[tuple] = []
    held = 0

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    def placed() -> Iterator[tuple[int, int, Piece]]:
        for b in batches:
            for doc_id, text, loss_from in zip(*(b.column(i) for i in range(3))):
                ids = encode(text.as_py() or b"") + end
                yield from packer.add(Piece(doc_id.as_py(), 0, ids, len(ids) // 4, loss_from.as_py() or 0))
        yield from packer.finish()

    for sequence, offset, p in placed():
        out.append((p.doc_id, p.start, p.length, p.ids, p.doc_tokens, p.loss, base + sequence, offset))
        held += len(p.ids)
        if held >= FLUSH_BYTES:
            yield batch()
            out, held = [], 0
    if out:
        yield batch()


def written_order(docs: DataFrame) -> list[Column]:
    """The order in which a frame read from files was written: file, then row; nothing for other frames."""
    order = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    try:
        docs.select(*order).schema
    except AnalysisException:
        return []
    return order


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, limits: Limits = Limits(), id_col: str = "doc_id",
         text_col: str = "text", loss_from_col: str | None = None, order_cols: Sequence[Column] = ()) -> DataFrame:
    """Pieces of all documents, placed in sequences.

    ``tokenizer`` is the path of a ``tokenizers`` file whose pre-tokenizer splits
    at white space.  ``loss_from_col`` gives, per row, the token at which the
    loss starts (a prompt's length in instruction data); without it, all tokens
    bear loss.  Returns ``ids`` (little-endian unsigned 32-bit), where the piece
    starts in its document, and where it lies in which sequence.
    """
    loss_from = q(loss_from_col).cast("long") if loss_from_col else F.lit(0).cast("long")
    order = [f"order{i}" for i in range(len(order_cols))]
    rows = docs.select(q(id_col).cast("long").alias("doc_id"), q(text_col).cast("binary").alias("text"),
                       loss_from.alias("loss_from"), *[c.alias(n) for c, n in zip(order_cols, order)])
    if order:
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop(*order)
    return rows.mapInArrow(lambda batches: _pack_batches(batches, tokenizer, end_id, limits), SCHEMA)
