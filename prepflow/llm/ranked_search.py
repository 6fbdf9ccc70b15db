"""Ranked lexical search by dense blocked matrix products.

Items are taken in tiles; a tile has a compact vocabulary, the distinct terms of
its own items.  Documents are read once per block of tiles and kept as the counts
of the block's terms (and their length).  For a tile of items and a tile of
documents, the counts of terms in items (items x terms) are multiplied by the
impacts of terms in documents (terms x documents), both in float64.  The columns
of a product are split so that its largest possible sum stays below 2^53, where
float64 holds every integer: the products are exact whatever the order of the
additions, and the parts are added as 64-bit integers.

A task keeps, per item, the ``k`` best documents by score, equal scores by
ascending id, over its tiles of documents; those of all tasks are merged by two
windows (salted, then per item).

A block has at most ``block_items`` items and, with all but one item, at most
``block_terms`` terms; its vocabulary is what is sent to the tasks.  Blocks are
fetched one after another, so the number of items does not matter for memory.

Terms are maximal runs of ASCII letters and digits and of all characters beyond
ASCII, of the whole text, A-Z lower-cased.  With N documents that have terms, L
terms in them, n terms in one document, df documents that hold a term and tf
occurrences in a document:

    w = floor(scale_w * ln((2 N + 2) / (2 df + 1)))
    m = (100 - b) + (b n N) div L
    score = sum over the item's terms of w * ((10^9 tf) div (1000 tf + 12 m))

Defined results: NULL and empty texts have no terms: such a document is never
found, such an item finds nothing.  Documents with NULL ids come last among equal
scores; rows that repeat an id are documents of their own, and so are items.  Very
long texts are cut at separators into stretches that are counted one after
another.  An empty table of either kind gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import q
from .common import frozen

#: Per byte: A-Z to lower case, ASCII characters outside terms to space, the rest as it is.
FOLDED = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
               for b in range(256))
STRETCH = 1 << 20  # bytes of a text that are split into terms at once
EXACT = 1 << 53
SALTS = 64


@dataclass(frozen=True)
class Search:
    """Ranking constants and sizes of tiles."""

    k: int = 20
    b: int = 25  # per cent of the length normalisation
    weight_scale: int = 1000
    impact_scale: int = 1_000_000_000
    tf_factor: int = 1000
    length_factor: int = 12
    block_items: int = 4096
    block_terms: int = 200_000
    tile_items: int = 64
    tile_cells: int = 1 << 20  # of the impacts of a tile: terms x documents
    tile_documents: int = 4096
    tile_columns: int = 4096  # terms in one product

    @property
    def largest_impact(self) -> int:
        return self.impact_scale // self.tf_factor

    def weight(self, documents: int, df: int) -> int:
        return math.floor(self.weight_scale * math.log((2 * documents + 2) / (2 * df + 1)))

    def impacts(self, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (self.impact_scale * tf) // (self.tf_factor * tf + self.length_factor * m)


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in stretches cut at separators."""
    folded, at = (text or b"").translate(FOLDED), 0
    while at < len(folded):
        end = folded.find(b" ", at + STRETCH)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


# ------------------------------------------------------------------ items
class Block:
    """Items with their term counts, and the numbers of all their terms."""

    def __init__(self) -> None:
        self.items: list = []  # (item id, Counter of term numbers)
        self.numbers: dict[bytes, int] = {}

    def add(self, item_id, text: bytes | None) -> None:
        counts: Counter = Counter()
        for some in terms(text):
            counts.update(some)
        self.items.append((item_id, Counter({self.numbers.setdefault(t, len(self.numbers)): c for t, c in counts.items()})))


def blocks(items: DataFrame, search: Search) -> Iterator[Block]:
    """The items in blocks of bounded size; one at a time is held."""
    block = Block()
    for item_id, text in items.toLocalIterator():
        block.add(item_id, None if text is None else bytes(text))
        if len(block.items) >= search.block_items or len(block.numbers) >= search.block_terms:
            yield block
            block = Block()
    if block.items:
        yield block


@dataclass
class Tile:
    """Some items over their own terms: products of exact parts."""

    first: int  # number of the first item in the block
    items: int
    columns: np.ndarray  # term number of each column
    weights: np.ndarray  # of the columns
    counts: np.ndarray  # items x columns
    parts: list[slice]  # columns whose products sum to less than 2^53


def tiles(block: Block, weights: dict[int, int], search: Search) -> list[Tile]:
    """Tiles of a block.  ``weights`` has the terms that some document holds.

    A count that alone could pass the bound is spread over several columns of its term.
    """
    out = []
    for first in range(0, len(block.items), search.tile_items):
        own = [counts for _, counts in block.items[first:first + search.tile_items]]
        cells: list[tuple[int, list[int]]] = []  # (term, count per item)
        for t in sorted({t for counts in own for t in counts if weights.get(t)}):
            most = (EXACT - 1) // (weights[t] * search.largest_impact)
            left = [counts[t] for counts in own]
            while any(left):
                cells.append((t, [min(c, most) for c in left]))
                left = [c - min(c, most) for c in left]
        parts, begin, room = [], 0, [0] * len(own)
        for i, (t, counts) in enumerate(cells):
            more = [c * weights[t] * search.largest_impact for c in counts]
            if i > begin and (i - begin >= search.tile_columns or any(a + b >= EXACT for a, b in zip(room, more))):
                parts.append(slice(begin, i))
                begin, room = i, [0] * len(own)
            room = [a + b for a, b in zip(room, more)]
        if cells:
            parts.append(slice(begin, len(cells)))
            columns = np.array([t for t, _ in cells], dtype=np.int64)
            out.append(Tile(first, len(own), columns, np.array([weights[t] for t in columns.tolist()], dtype=np.int64),
                            np.array([c for _, c in cells], dtype=np.float64).T.copy(), parts))
    return out


# ------------------------------------------------------------------ documents: counts of a block's terms
COUNTED = "doc_id long, n long, terms binary, times binary, term int, df long"


def _count(batches: Iterable[pa.RecordBatch], numbers: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """A row per document with terms, and at the end a row per term that documents of the task hold."""
    names = ["doc_id", "n", "terms", "times", "term", "df"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]
    df = np.zeros(len(numbers), dtype=np.int64)
    find, rows = numbers.get, []

    def flat() -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            n, found = 0, []
            for some in terms(text.as_py()):
                n += len(some)
                found += [x for x in map(find, some) if x is not None]
            if n == 0:
                continue
            held, times = np.unique(np.array(found, dtype=np.int32), return_counts=True)
            df[held] += 1
            rows.append((doc_id, n, held.tobytes(), times.astype(np.int64).tobytes(), None, None))
            if len(rows) >= 2000:
                yield flat()
                rows = []
    rows += [(None, None, None, None, t, int(df[t])) for t in np.flatnonzero(df).tolist()]
    yield flat()


# ------------------------------------------------------------------ products
class Best:
    """Per item the ``k`` best documents seen: by score, then NULL ids last, then by id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = [np.zeros(0, dtype=np.int64) for _ in range(items)]
        self.doc = [np.zeros(0, dtype=np.int64) for _ in range(items)]
        self.none = [np.zeros(0, dtype=bool) for _ in range(items)]

    def offer(self, item: int, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        held = self.score[item]
        least = held[-1] if len(held) == self.k else 1  # an equal score may still win by its id
        good = np.flatnonzero(score >= least)
        if len(good) > 4 * self.k:  # all that reach the k-th best score, ties included
            cut = np.partition(score[good], len(good) - self.k)[len(good) - self.k]
            good = good[score[good] >= cut]
        if len(good) == 0:
            return
        score = np.concatenate((held, score[good]))
        doc, none = np.concatenate((self.doc[item], doc[good])), np.concatenate((self.none[item], none[good]))
        first = np.lexsort((doc, none, -score))[:self.k]
        self.score[item], self.doc[item], self.none[item] = score[first], doc[first], none[first]


FOUND = "item int, doc_id long, score long"


def _score(batches: Iterable[pa.RecordBatch], own: list[Tile], n_items: int, vocabulary: int, documents: int,
           length: int, search: Search) -> Iterator[pa.RecordBatch]:
    """The best documents of a task per item, by products of tiles of items and tiles of documents."""
    best = Best(n_items, search.k)
    width = max((len(t.columns) for t in own), default=1)
    docs_in_tile = max(16, min(search.tile_documents, search.tile_cells // width))
    held: list[tuple] = []

    def multiply() -> None:
        ids = np.array([d or 0 for d, *_ in held], dtype=np.int64)
        none = np.array([d is None for d, *_ in held])
        m = np.array([100 - search.b + search.b * n * documents // length for _, n, *_ in held], dtype=np.int64)
        size = [len(t) for _, _, t, _ in held]
        at, term, tf = np.repeat(np.arange(len(held)), size), *(np.concatenate([r[i] for r in held]) for i in (2, 3))
        impact = search.impacts(tf, m[at])
        order = np.argsort(term, kind="stable")
        at, term, impact = at[order], term[order], impact[order]
        start = np.searchsorted(term, np.arange(vocabulary + 1))
        for tile in own:
            low, many = start[tile.columns], start[tile.columns + 1] - start[tile.columns]
            column = np.repeat(np.arange(len(tile.columns)), many)
            entry = np.arange(len(column)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            dense = np.zeros((len(tile.columns), len(held)))
            dense[column, at[entry]] = impact[entry] * tile.weights[column]
            total = np.zeros((tile.items, len(held)), dtype=np.int64)
            for part in tile.parts:
                total += (tile.counts[:, part] @ dense[part]).astype(np.int64)
            for i in range(tile.items):
                best.offer(tile.first + i, total[i], ids, none)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.append((row[0], row[1], np.frombuffer(row[2], dtype=np.int32), np.frombuffer(row[3], dtype=np.int64)))
            if len(held) >= docs_in_tile:
                multiply()
                held.clear()
    if held:
        multiply()
    item = np.repeat(np.arange(n_items, dtype=np.int32), [len(s) for s in best.score])
    doc = pa.array(np.concatenate(best.doc), mask=np.concatenate(best.none))
    yield pa.RecordBatch.from_arrays([pa.array(item), doc, pa.array(np.concatenate(best.score))], ["item", "doc_id", "score"])


def _block_results(docs: DataFrame, block: Block, search: Search, item_type) -> DataFrame:
    numbers = block.numbers
    counted = frozen(docs.mapInArrow(lambda b: _count(b, numbers), COUNTED))
    rows = counted.where(F.col("n").isNotNull())
    documents, length = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = counted.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("df").alias("df")).collect()
    own = tiles(block, {r["term"]: search.weight(documents, r["df"]) for r in df}, search)
    n_items, vocabulary = len(block.items), len(numbers)
    found = rows.select("doc_id", "n", "terms", "times").mapInArrow(
        lambda b: _score(b, own, n_items, vocabulary, documents, length, search), FOUND)
    order = F.col("score").desc(), F.col("doc_id").asc_nulls_last()
    salted = Window.partitionBy("item", "salt").orderBy(*order)
    found = (found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
             .withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= search.k))
    found = (found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
             .where(F.col("rank") <= search.k))
    names = docs.sparkSession.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block.items)],
                                              item_type)
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, search: Search = Search(), id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: per item the ``k`` documents of highest score above 0."""
    texts = docs.select(q(id_col).cast("long").alias("doc_id"), q(text_col).cast("binary").alias("text"))
    queries = items.select(q(item_col).alias("item_id"), q(item_text_col).cast("binary").alias("text"))
    item_type = T.StructType([T.StructField("item", T.IntegerType()), queries.schema["item_id"]])
    out = None
    for block in blocks(queries, search):
        found = _block_results(texts, block, search, item_type)
        out = found if out is None else out.unionAll(found)
    if out is None:
        empty = T.StructType([queries.schema["item_id"], T.StructField("rank", T.IntegerType()),
                              T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
        return docs.sparkSession.createDataFrame([], empty)
    return out
