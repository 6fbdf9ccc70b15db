"""Pairwise-complete second moments of many columns from one scan.

For two columns, only rows where both are present count.  With X the values
(missing ones 0) and M the mask of present ones, the products M'M, X'M, (X^2)'M and
X'X hold the counts and sums of all pairs at once, so a task reads its rows in Arrow
batches and adds up four matrix products, whatever the number of pairs.  Values are
taken relative to the first present value of their column in the task, so large
offsets do not cancel and a constant column has no spread at all.

A task sends its moments (count, means, centred sums) by column blocks.  Blocks
merge by the pairwise update of centred moments, first by groups of tasks, then
altogether; a merging task holds one block of each kind at a time.

Moments of a task take about 50 bytes per pair of columns: 2000 columns a pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q

BLOCK = 64  # columns of a block
STRIP = 2000  # columns of a pass
TASKS = 64  # merged together first
CHUNK = 4096  # rows of a product
NOISE = 1e-14  # of the squared distance from the first value: rounding, not spread
MOMENTS = ("n", "mean_a", "mean_b", "sum_aa", "sum_bb", "sum_ab")


class Moments:
    """Sums over the rows of one task, relative to the first value of each column."""

    def __init__(self, left: int, right: int):
        self.left, self.right = left, right
        self.origin = np.full(left + right, np.nan)
        self.count = np.zeros((left, right))
        self.sums = {k: np.zeros((left, right)) for k in ("a", "b", "aa", "bb", "ab")}

    def add(self, x: np.ndarray) -> None:
        """Rows of all left columns, then all right columns; NaN is missing."""
        unset = np.isnan(self.origin)
        if unset.any():
            some = ~np.isnan(x)
            first = np.where(some.any(axis=0), x[some.argmax(axis=0), np.arange(x.shape[1])], np.nan)
            self.origin = np.where(unset, first, self.origin)
        mask = (~np.isnan(x)).astype(np.float64)
        x = np.where(mask > 0, x - self.origin, 0.0)
        a, b, ma, mb = x[:, :self.left], x[:, self.left:], mask[:, :self.left], mask[:, self.left:]
        self.count += ma.T @ mb
        for k, (u, v) in {"a": (a, mb), "b": (ma, b), "aa": (a * a, mb), "bb": (ma, b * b), "ab": (a, b)}.items():
            self.sums[k] += u.T @ v

    def centred(self) -> np.ndarray:
        """``MOMENTS`` stacked; spreads that are only rounding are 0."""
        n = np.maximum(self.count, 1.0)
        s = self.sums
        origin = np.nan_to_num(self.origin)
        aa, bb = s["aa"] - s["a"] ** 2 / n, s["bb"] - s["b"] ** 2 / n
        ab = s["ab"] - s["a"] * s["b"] / n
        return np.stack([self.count, origin[:self.left, None] + s["a"] / n, origin[None, self.left:] + s["b"] / n,
                         np.where(aa > NOISE * s["aa"], aa, 0.0), np.where(bb > NOISE * s["bb"], bb, 0.0), ab])


def merged(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Centred moments of two sets of rows together."""
    n = x[0] + y[0]
    share = np.divide(y[0], n, out=np.zeros_like(n), where=n > 0)
    da, db = (np.where((x[0] > 0) & (y[0] > 0), y[i] - x[i], 0.0) for i in (1, 2))
    weight = x[0] * share
    mean = [np.where(x[0] > 0, x[i] + d * share, y[i]) for i, d in ((1, da), (2, db))]
    return np.stack([n, *mean, x[3] + y[3] + da * da * weight, x[4] + y[4] + db * db * weight, x[5] + y[5] + da * db * weight])


def _sums(batches: Iterable[pa.RecordBatch], left: int, right: int, same: bool) -> Iterator[pa.RecordBatch]:
    """Moments of a task by blocks; with ``same`` columns on both sides, blocks of the upper half alone."""
    from pyspark import TaskContext
    moments, some = Moments(left, right), False
    for b in batches:
        if b.num_rows:
            some = True
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns])
            x = np.concatenate((x, x), axis=1) if same else x
            for at in range(0, len(x), CHUNK):
                moments.add(x[at:at + CHUNK])
    task = TaskContext.get().partitionId()
    if not some and task:  # the first task stands for an empty frame
        return
    stack, salt = moments.centred(), task // TASKS
    for i in range(0, left, BLOCK):
        for j in range(i if same else 0, right, BLOCK):
            data = np.ascontiguousarray(stack[:, i:i + BLOCK, j:j + BLOCK]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((i, pa.int32()), (j, pa.int32()), (salt, pa.int32()),
                                                                           (data, pa.binary()))], ["i", "j", "salt", "data"])


def _blocks(batches: Iterable[pa.RecordBatch], left: int, right: int, keys: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """Merged blocks; rows come sorted by their first ``keys`` columns."""
    key, held = None, None
    for b in batches:
        for *this, data in zip(*(c.to_pylist() for c in b.columns)):
            i, j = this[:2]
            block = np.frombuffer(data).reshape(len(MOMENTS), min(BLOCK, left - i), min(BLOCK, right - j))
            if tuple(this[:keys]) != key:
                if key is not None:
                    yield key, held
                key, held = tuple(this[:keys]), block
            else:
                held = merged(held, block)
    if key is not None:
        yield key, held


def _merge_some(batches: Iterable[pa.RecordBatch], left: int, right: int) -> Iterator[pa.RecordBatch]:
    for (i, j, salt), held in _blocks(batches, left, right, 3):
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((i, pa.int32()), (j, pa.int32()), (salt, pa.int32()),
                                                                       (held.tobytes(), pa.binary()))], ["i", "j", "salt", "data"])


def _merge_all(batches: Iterable[pa.RecordBatch], left: int, right: int, same: bool) -> Iterator[pa.RecordBatch]:
    """A row per pair of columns, both orders where the sides are the same."""
    names = ["i", "j", *MOMENTS]

    def flat(i: np.ndarray, j: np.ndarray, stack: np.ndarray) -> pa.RecordBatch:
        grid = np.meshgrid(i, j, indexing="ij")
        return pa.RecordBatch.from_arrays([pa.array(g.ravel().astype(np.int32)) for g in grid]
                                          + [pa.array(m.ravel()) for m in stack], names)

    for (i, j), held in _blocks(batches, left, right, 2):
        rows, cols = i + np.arange(held.shape[1]), j + np.arange(held.shape[2])
        yield flat(rows, cols, held)
        if same and i != j:
            yield flat(cols, rows, held[[0, 2, 1, 4, 3, 5]].transpose(0, 2, 1))


def _strip(df: DataFrame, a: Sequence[str], b: Sequence[str]) -> DataFrame:
    same = list(a) == list(b)
    left, right = len(a), len(b)
    given = df.select(*[q(c).cast("double").alias(f"c{k}") for k, c in enumerate([*a] if same else [*a, *b])])
    sent = given.mapInArrow(lambda x: _sums(x, left, right, same), "i int, j int, salt int, data binary")
    some = sent.repartition("i", "j", "salt").sortWithinPartitions("i", "j", "salt").mapInArrow(
        lambda x: _merge_some(x, left, right), "i int, j int, salt int, data binary")
    pairs = some.repartition("i", "j").sortWithinPartitions("i", "j", "salt").mapInArrow(
        lambda x: _merge_all(x, left, right, same), "i int, j int, " + ", ".join(f"{m} double" for m in MOMENTS))
    name = lambda names, k: F.element_at(F.lit(list(names)), F.col(k) + 1)
    return pairs.select(name(a, "i").alias("column_a"), name(b, "j").alias("column_b"), F.col("n").cast("long").alias("n"), *MOMENTS[1:])


def pair_moments(df: DataFrame, left: Sequence[str], right: Sequence[str] | None = None) -> DataFrame:
    """``column_a, column_b, n, mean_a, mean_b, sum_aa, sum_bb, sum_ab`` of the left columns with the right ones.

    ``right`` defaults to the left columns.  NULL and NaN are missing; ``n`` counts
    the rows where both columns are present, and the sums are centred on their means.
    """
    left = list(left)
    right = left if right is None else list(right)
    out = None
    for i in range(0, len(left), STRIP):
        for j in range(0, len(right), STRIP):
            part = _strip(df, left[i:i + STRIP], right[j:j + STRIP])
            out = part if out is None else out.unionByName(part)
    return out
