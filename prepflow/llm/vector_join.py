"""Exact similarity self-join of vectors: a metric range join with pivots.

Vectors of one label (and dimension) are scaled to unit length; equal unit vectors
are one node with its number of rows.  Cosine >= ``cosine`` is then a range on the
angle between nodes, a metric.

A label with more nodes than a cell should hold gets pivots, vectors of its own,
and a node belongs to the cell of its nearest pivot.  By the triangle inequality a
partner within angle r has an angle to its own pivot that is at most 2 r more than
the node's to its pivot can explain: a node v with home p is copied to the cell of
p' only if angle(v, p') <= angle(v, p) + 2 r, and only if its angle to the great
sphere that separates p from p' is at most r (every partner in the other cell lies
beyond it).  Cells are in order, and a node is copied to later ones alone, so each
pair meets in one cell.  A cell that is still too large is dealt to blocks by hash,
and its nodes are copied to later blocks of it in the same way.

Cells join independently: a task holds the natives of one block, at most some
``cell_nodes``, and lets the copies pass by in tiles, with one matrix product in
double precision per tile.  It returns sums of links per node and a spanning forest
of what it linked, never all pairs of a group of near copies.

Pivots of all labels together hold at most ``pivot_bytes``; labels share them by
their number of nodes.  That bound, not the number of rows, limits what is sent to
tasks.  In data without structure a range of this size touches nearly all cells, so
nearly all pairs of a label are compared, each once.

Defined results: vectors that are NULL, empty, zero, or hold NULL or non-finite
components, and rows with a NULL label or id, link with nothing; so do vectors of
different dimensions.  Rows that share an id are vectors of their own, each with
its own links.  A component is named by its smallest id, so rows that share an id
may carry one name for two components.  A row without links is its own component
(NULL for a NULL id, and such rows are kept).  An empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import q
from .common import frozen, small_side
from .components import components

NEAR = 1e-9  # cosines this close to the limit are computed again, sums exact
SLACK = 1e-7  # added to bounds on angles, far above their rounding


@dataclass(frozen=True)
class VectorSimilarity:
    """Vectors link when their cosine is at least ``cosine``."""

    cosine: float = 0.93
    cell_nodes: int = 2048
    tile_rows: int = 1024
    pivot_bytes: int = 8 << 20
    most_pivots: int = 512  # of one label

    @property
    def angle(self) -> float:
        return math.acos(self.cosine)


# ------------------------------------------------------------------ unit vectors
def _units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``vec_id, label, unit, mark, dim`` from ``vec_id, label, vector``.

    ``mark`` stands for the unit vector in joins; both are NULL where nothing can link.
    """
    for b in batches:
        units, marks, dims = [], [], []
        for vec_id, label, vector in zip(*b.columns):
            unit = None
            if vec_id.is_valid and label.is_valid and vector.is_valid and vector.values.null_count == 0 and len(vector):
                x = vector.values.to_numpy(zero_copy_only=False)
                largest = np.abs(x).max()
                if np.isfinite(x).all() and largest > 0:
                    x = x / largest
                    unit = x / math.sqrt(math.fsum(x * x)) + 0.0  # + 0.0: one zero
            units.append(None if unit is None else unit.tobytes())
            marks.append(None if unit is None else hashlib.blake2b(units[-1], digest_size=16).digest())
            dims.append(None if unit is None else len(unit))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(units, pa.binary()), pa.array(marks, pa.binary()),
             pa.array(dims, pa.int32())], ["vec_id", "label", "unit", "mark", "dim"])


# ------------------------------------------------------------------ pivots and copies
class Pivots:
    """Pivots of one label and the number of blocks of each of their cells."""

    def __init__(self, vectors: np.ndarray, angle: float):
        self.vectors, self.angle = vectors, angle
        self.blocks = np.ones(len(vectors), dtype=np.int64)

    @cached_property
    def gap(self) -> np.ndarray:
        """Distances between pivots; made in the task that needs them."""
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (self.vectors @ self.vectors.T)))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home of each vector, and which cells may hold its partners."""
        near = np.clip(x @ self.vectors.T, -1.0, 1.0)
        home = near.argmax(axis=1)
        own = near[np.arange(len(x)), home]
        angles = np.arccos(near)
        reach = angles <= angles[np.arange(len(x)), home][:, None] + 2 * self.angle + SLACK
        # sine of the angle to the great sphere of equal distance from both pivots, times their distance
        beyond = math.sin(min(self.angle, math.pi / 2)) * (self.gap[home] + SLACK) + SLACK
        reach &= own[:, None] - near <= beyond
        reach[np.arange(len(x)), home] = True
        return home, reach


def _homes(batches: Iterable[pa.RecordBatch], pivots: dict[tuple, Pivots]) -> Iterator[pa.RecordBatch]:
    """Cell of each node of labels that have pivots."""
    for b in batches:
        keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        cell = [0] * len(keys)
        for key, at in _by_key(keys).items():
            for i, c in zip(at, pivots[key].cells(_matrix(b.column(2), at))[0].tolist()):
                cell[i] = c
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32())], ["label", "dim", "cell"])


def _by_key(keys: list[tuple]) -> dict[tuple, list[int]]:
    out: dict[tuple, list[int]] = {}
    for i, k in enumerate(keys):
        out.setdefault(k, []).append(i)
    return out


def _matrix(units: pa.Array, at: Iterable[int]) -> np.ndarray:
    return np.stack([np.frombuffer(units[i].as_py(), dtype=np.float64) for i in at])


COPIES = "label string, dim int, cell int, block long, copied boolean, node long, times long, unit binary"


def _copies(batches: Iterable[pa.RecordBatch], pivots: dict[tuple, Pivots]) -> Iterator[pa.RecordBatch]:
    """Each node in its own block, and its copies for later blocks that may hold partners."""
    names = [c.split()[0] for c in COPIES.split(", ")]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
    for b in batches:
        label, dim, unit, node, times, blocks, deal = (c.to_pylist() for c in b.columns)
        rows: list[tuple] = []
        for key, at in _by_key(list(zip(label, dim))).items():
            p = pivots.get(key)
            home, reach = p.cells(_matrix(b.column(2), at)) if p else (np.zeros(len(at), np.int64), np.ones((len(at), 1), bool))
            of_cell = p.blocks if p else None
            for i, h, near in zip(at, home.tolist(), reach):
                for cell in np.flatnonzero(near[h:]).tolist():
                    n = int(of_cell[h + cell]) if p else blocks[i]
                    own = deal[i] % n if cell == 0 else -1
                    rows += [(*key, h + cell, k, k != own, node[i], times[i], unit[i])
                             for k in range(max(own, 0), n)]
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


# ------------------------------------------------------------------ inside a block
class BlockJoin:
    """Natives of one block, compared with themselves and with copies that pass by."""

    def __init__(self, similarity: VectorSimilarity):
        self.similarity = similarity
        self.nodes: list[int] = []
        self.times: list[int] = []
        self.units: list[np.ndarray] = []
        self.passing: list[tuple] = []
        self.up: dict[int, int] = {}
        self.links: dict[int, int] = {}
        self.matrix: np.ndarray | None = None

    def root(self, v: int) -> int:
        while (above := self.up.get(v, v)) != v:
            self.up[v] = self.up.get(above, above)
            v = above
        return v

    def add(self, copied: bool, node: int, times: int, unit: bytes) -> None:
        x = np.frombuffer(unit, dtype=np.float64)
        if copied:
            self.passing.append((node, times, x))
            if len(self.passing) >= self.similarity.tile_rows:
                self.flush()
        else:
            self.nodes.append(node)
            self.times.append(times)
            self.units.append(x)

    def _linked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        limit = self.similarity.cosine
        near = left @ right.T
        out = near >= limit
        for i, j in zip(*np.nonzero(np.abs(near - limit) < NEAR)):
            out[i, j] = math.fsum(left[i] * right[j]) >= limit
        return out

    def _record(self, linked: np.ndarray, left: list[int], left_times: np.ndarray, right: list[int],
                right_times: np.ndarray) -> None:
        rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        for i, n in zip(rows.tolist(), (linked[rows] @ right_times).tolist()):
            self.links[left[i]] = self.links.get(left[i], 0) + n
        for j, n in zip(cols.tolist(), (left_times @ linked[:, cols]).tolist()):
            self.links[right[j]] = self.links.get(right[j], 0) + n
        roots = np.array([self.root(right[j]) for j in cols], dtype=np.int64)
        for i in rows.tolist():
            r = self.root(left[i])
            others = np.unique(roots[linked[i, cols]])
            others = others[others != r]
            if len(others):
                low = min(r, int(others[0]))
                for s in (r, *others.tolist()):
                    if s != low:
                        self.up[s] = low
                roots[np.isin(roots, others) | (roots == r)] = low

    def _prepare(self) -> None:
        """Natives among themselves, once all of them are there."""
        if self.matrix is not None or not self.nodes:
            return
        self.matrix = np.stack(self.units)
        self.units = []
        weight = np.array(self.times, dtype=np.int64)
        step = self.similarity.tile_rows
        for a in range(0, len(self.nodes), step):
            rows = slice(a, a + step)
            linked = self._linked(self.matrix[rows], self.matrix[a:])
            linked &= np.arange(linked.shape[1])[None] > np.arange(linked.shape[0])[:, None]
            self._record(linked, self.nodes[rows], weight[rows], self.nodes[a:], weight[a:])

    def flush(self) -> None:
        self._prepare()
        if self.passing and self.nodes:
            nodes, times, units = zip(*self.passing)
            self._record(self._linked(self.matrix, np.stack(units)), self.nodes, np.array(self.times, dtype=np.int64),
                         list(nodes), np.array(times, dtype=np.int64))
        self.passing = []

    def results(self) -> list[tuple[int, int | None, int | None]]:
        self.flush()
        return ([(v, self.root(v), None) for v in self.up] + [(v, None, n) for v, n in self.links.items()])


JOINED = "u long, v long, links long"


def _join_blocks(batches: Iterable[pa.RecordBatch], similarity: VectorSimilarity) -> Iterator[pa.RecordBatch]:
    """Forest edges (``u, v``) and sums of links (``u, links``); rows come sorted by block, natives first."""
    key, block, rows = None, None, []

    def flat() -> pa.RecordBatch:
        cols = zip(*rows) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["u", "v", "links"])

    for b in batches:
        for *this, copied, node, times, unit in zip(*(c.to_pylist() for c in b.columns)):
            if this != key:
                rows += block.results() if block else []
                key, block = this, BlockJoin(similarity)
                if len(rows) >= 20_000:
                    yield flat()
                    rows = []
            block.add(copied, node, times, unit)
    rows += block.results() if block else []
    yield flat()


# ------------------------------------------------------------------ the join
def _chosen_pivots(nodes: DataFrame, sizes: DataFrame, similarity: VectorSimilarity) -> dict[tuple, Pivots]:
    """Pivots of labels with more nodes than a cell holds: those of smallest hash, as many as their share allows.

    All labels together get ``pivot_bytes``: a label with n of N nodes gets the
    share n / N of it, so the collected rows are bounded.
    """
    total = F.sum("n").over(Window.partitionBy())
    share = F.floor(F.lit(float(similarity.pivot_bytes)) * F.col("n") / total / (F.col("dim") * 8))
    wanted = sizes.withColumn("pivots", F.least(F.ceil(F.col("n") / similarity.cell_nodes), share,
                                                F.lit(similarity.most_pivots))).where("pivots >= 2")
    order = Window.partitionBy("label", "dim").orderBy(F.xxhash64("unit"), "node")
    ranked = nodes.join(wanted.select("label", "dim", "pivots"), ["label", "dim"])
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(
        (F.col("rank") <= similarity.most_pivots) & (F.col("rank") <= F.col("pivots")))
    found: dict[tuple, list[np.ndarray]] = {}
    for r in ranked.select("label", "dim", "unit").orderBy("label", "dim", "rank").collect():
        found.setdefault((r["label"], r["dim"]), []).append(np.frombuffer(bytes(r["unit"]), dtype=np.float64))
    return {key: Pivots(np.stack(x), similarity.angle) for key, x in found.items()}


def near_vectors(vectors: DataFrame, similarity: VectorSimilarity = VectorSimilarity(), id_col: str = "vec_id",
                 label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    given = vectors.select(q(id_col).cast("long").alias("vec_id"), q(label_col).cast("string").alias("label"),
                           q(vector_col).cast("array<double>").alias("vector"))
    units = frozen(given.mapInArrow(_units, "vec_id long, label string, unit binary, mark binary, dim int"))
    able = units.where(F.col("unit").isNotNull())
    nodes = frozen(able.groupBy("label", "dim", "mark", "unit").agg(
        F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("smallest"))
        .withColumn("node", F.monotonically_increasing_id()))

    sizes = frozen(nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")))
    pivots = _chosen_pivots(nodes, sizes, similarity)
    if pivots:
        keys = vectors.sparkSession.createDataFrame(list(pivots), "label string, dim int")
        homes = nodes.join(F.broadcast(keys), ["label", "dim"]).select("label", "dim", "unit")
        cells = homes.mapInArrow(lambda b: _homes(b, pivots), "label string, dim int, cell int")
        for r in cells.groupBy("label", "dim", "cell").count().collect():  # at most one row per pivot
            pivots[r["label"], r["dim"]].blocks[r["cell"]] = -(-r["count"] // similarity.cell_nodes)
    blocks = sizes.select("label", "dim", F.ceil(F.col("n") / similarity.cell_nodes).alias("blocks"))
    placed = nodes.join(small_side(blocks, blocks.count()), ["label", "dim"]).select(
        "label", "dim", "unit", "node", "times", "blocks", F.pmod(F.xxhash64("node"), F.lit(1 << 40)).alias("deal"))
    dealt = placed.mapInArrow(lambda b: _copies(b, pivots), COPIES)
    by_block = ["label", "dim", "cell", "block"]
    joined = frozen(dealt.repartition(*by_block).sortWithinPartitions(*by_block, "copied")
                    .mapInArrow(lambda b: _join_blocks(b, similarity), JOINED))

    links = joined.where(F.col("links").isNotNull()).groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(joined.where(F.col("v").isNotNull()).select("u", "v")).withColumnRenamed("root", "top")
    named = frozen(nodes.drop("unit").join(links, "node", "left").join(roots, "node", "left")
                   .withColumn("top", F.coalesce("top", "node")))
    smallest = named.groupBy("top").agg(F.min("smallest").alias("component_id"))
    results = named.join(smallest, "top").select(
        "label", "dim", "mark", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    found = able.select("vec_id", "label", "dim", "mark").join(results, ["label", "dim", "mark"])
    alone = units.where(F.col("unit").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                                       F.col("vec_id").alias("component_id"))
    return found.select(*alone.columns).unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
