"""Token counts by a compiled finite-state tokenizer.

The byte-pair merges are compiled, as far as the data need it, into a
deterministic transducer over bytes.  After a prefix of a pre-token, a state
holds the longest suffix that may still grow into a token, and for each position
in it the last token of the encoding that ends there and its count relative to
now.  That is all the next byte needs: the encoding of the longer prefix ends in
the one token that may follow the last token of the encoding before it.  Every
transition is annotated with the change in the number of emitted tokens, so a
count is a sum along a path.  States are made when first reached and kept per
Python worker up to a bound, then made anew.

Texts are cut where a single space stands between two characters that are not
white space: no pre-token crosses such a place.  A chunk of a long text maps what
is pending before it to (head, tokens between, tail): the maps compose
associatively, so chunks of any size are counted on their own and folded
pairwise.

Defined results: NULL text counts as empty (0 tokens, 0 bytes); repeated rows are
counted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q
from .common import Recent

#: Fixed value: the split into pre-tokens of byte-level vocabularies.
PRE_TOKENS = regex.compile(
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
IRREGULAR = 1 << 40
MAX_STATES = 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Transducer:
    """Counts the tokens of pre-tokens under byte-pair merges; compiled state by state.

    ``merges`` are pairs of byte strings in rank order; every single byte is a token.
    """

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.tokens = [bytes([b]) for b in range(256)]
        self.formed = [-1] * 256  # the rank of the merge that makes a token
        self.halves: list[tuple[int, int]] = [(-1, -1)] * 256
        self.number_of = {t: i for i, t in enumerate(self.tokens)}
        self.rank: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            pair = self.number_of[a], self.number_of[b]
            self.rank[pair] = r
            if a + b not in self.number_of:
                self.number_of[a + b] = len(self.tokens)
                self.tokens.append(a + b)
                self.formed.append(r)
                self.halves.append(pair)
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.may_follow = Recent(self._may_follow, 500_000)
        self.endings = Recent(self._endings, 500_000)
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple] = [(b"", (None,), (0,))]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def _may_follow(self, pair: tuple[int, int]) -> bool:
        """Whether two tokens stay apart: taking them apart in the reverse order of merging, no two
        neighbours across the border may have a merge that comes before both are merged further."""
        (x, y), left_until, right_until = pair, IRREGULAR, IRREGULAR
        while True:
            r = self.rank.get((x, y))
            if r is not None and r < left_until and r <= right_until:
                return False
            if self.formed[x] < 0 and self.formed[y] < 0:
                return True
            if self.formed[x] > self.formed[y]:
                left_until, x = self.formed[x], self.halves[x][1]
            else:
                right_until, y = self.formed[y], self.halves[y][0]

    def _endings(self, grown: bytes) -> tuple[list[tuple[int, int]], int]:
        """The tokens that end ``grown``, by start, and the start of its longest growing suffix."""
        ends = [(i, self.number_of[grown[i:]]) for i in range(len(grown)) if grown[i:] in self.number_of]
        keep = 0
        while keep < len(grown) and grown[keep:] not in self.prefixes:
            keep += 1
        return ends, keep

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of ``state`` under ``byte``: (next state, change in tokens)."""
        suffix, lasts, counts = self.states[state]
        grown = suffix + self.tokens[byte]
        ends, keep = self.endings[grown]
        start, token = next((i, t) for i, t in ends if lasts[i] is None or self.may_follow[lasts[i], t])
        change = counts[start] + 1
        after = (grown[keep:], (*lasts[keep:], token), (*(c - change for c in counts[keep:]), 0))
        number = self.number.get(after)
        if number is None:
            number = self.number[after] = len(self.states)
            self.states.append(after)
        move = self.moves[state << 8 | byte] = (number, change)
        return move

    def count(self, raw: bytes) -> int:
        if len(self.states) > MAX_STATES:
            self._reset()
        state, total, moves = 0, 0, self.moves
        for byte in raw:
            move = moves.get(state << 8 | byte) or self._compile(state, byte)
            state = move[0]
            total += move[1]
        return total


class Counter:
    """Counts the tokens of texts for a byte-level ``tokenizers`` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        special = [t["content"] for t in spec["added_tokens"]]
        self.transducer = Transducer([tuple(bytes(letters[c] for c in s) for s in p) for p in pairs])
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.first = Recent(lambda w: self._word("", w), 50_000)
        self.later = Recent(lambda w: self._word(" ", w))

    def _word(self, lead: str, word: str) -> int:
        """Tokens of a word with what stands before it; IRREGULAR if white space is at its border."""
        if word.isalpha():
            return self.transducer.count((lead + word).encode())
        if not word or word[-1].isspace() or lead and word[0].isspace():
            return IRREGULAR
        if word[-1] in ".,;:" and word[:-1].isalpha():  # the mark is a pre-token of its own, and one byte
            return (self.later if lead else self.first)[word[:-1]] + 1
        return self.pre_tokens(lead + word)

    def pre_tokens(self, text: str) -> int:
        count = self.transducer.count
        return sum(count(p.encode()) for p in PRE_TOKENS.findall(text))

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        words = text.split(" ")
        total = self.first[words[0]] + sum(map(self.later.__getitem__, words[1:]))
        if total < IRREGULAR:
            return total
        parts = SAFE_CUT.split(text)
        return self.pre_tokens(parts[0]) + sum(self.pre_tokens(" " + p) for p in parts[1:])

    def segment(self, text: str) -> int:
        """Tokens of a text between safe cuts, special strings counting one each."""
        if self.special is None or "<" not in text:
            return self._plain(text)
        parts = self.special.split(text)
        return sum(map(self._plain, parts)) + len(parts) - 1

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(head, tokens, tail) around the chunk's first and last safe cut; without one, all is head."""
        first = SAFE_CUT.search(chunk)
        if first is None:
            return chunk, None, ""
        at = len(chunk) - 1
        while True:
            at = chunk.rindex(" ", 0, at)
            if SAFE_CUT.match(chunk, at):
                return chunk[:first.start()], self.segment(chunk[first.start():at]), chunk[at:]

    def compose(self, a: tuple[str, int | None, str], b: tuple[str, int | None, str]) -> tuple[str, int | None, str]:
        """The map of two neighbouring chunks; associative."""
        if a[1] is None and b[1] is None:
            return self.chunk_map(a[0] + b[0])
        if a[1] is None:
            head, more, tail = self.chunk_map(a[0] + b[0])
            return (head, b[1], b[2]) if more is None else (head, more + self.segment(tail) + b[1], b[2])
        head, more, tail = self.chunk_map(a[2] + b[0])
        if b[1] is None:
            return (a[0], a[1], head) if more is None else (a[0], a[1] + self.segment(head) + more, tail)
        return a[0], a[1] + self.segment(a[2] + b[0]) + b[1], b[2]

    def count(self, text: str, chunk_chars: int) -> int:
        if len(text) <= chunk_chars:
            return self.segment(text)
        maps = [self.chunk_map(text[i:i + chunk_chars]) for i in range(0, len(text), chunk_chars)]
        while len(maps) > 1:  # pairwise, as in a parallel scan
            odd = [maps[-1]] if len(maps) % 2 else []
            maps = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])] + odd
        head, between, tail = maps[0]
        return self.segment(head) + (0 if between is None else between + self.segment(tail))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One compiled tokenizer per Python worker and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def _count_batches(batches: Iterable[pa.RecordBatch], path: str, chunk_chars: int) -> Iterator[pa.RecordBatch]:
    c = counter(path)
    for b in batches:
        n = [c.count(t.as_py() or "", chunk_chars) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())],
                                         ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, tokenizer: str, chunk_chars: int = 1 << 16, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every text, one row per input row.

    ``tokenizer`` is the path of a byte-level BPE file of the ``tokenizers`` library.
    """
    rows = docs.select(q(id_col).cast("long").alias("doc_id"), q(text_col).alias("text"),
                       F.coalesce(F.octet_length(q(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(lambda batches: _count_batches(batches, tokenizer, chunk_chars),
                           "doc_id long, n_bytes long, n_tokens long")
