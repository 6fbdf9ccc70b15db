"""Rows of a large table by lists of ids, without moving the other rows.

A join of two large tables shuffles all rows of both, texts too.  Here a bitmap of
the ids (three bits each, some 16 bits of room an id) goes to the tasks first, and rows whose
bits are not all set are told apart where they are read.  A bitmap is never wrong about
an id that it holds, and the few rows that it takes for held are settled by a join: results
are exact, and the room of a bitmap (32 MB at most) affects cost alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, unused

LEAST_BITS, MOST_BITS = 16, 28  # powers of two
BITS_PER_ID = 16
CHUNK_BITS = 19  # of the bitmap, made in one task
PROBES = 3


def _slots(ids: np.ndarray, bits: int) -> np.ndarray:
    """The places of each id, one row per probe."""
    h = ids.astype(np.int64).view(np.uint64)
    out = np.empty((PROBES, len(h)), dtype=np.int64)
    for i in range(PROBES):
        x = (h + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        out[i] = ((x ^ (x >> np.uint64(32))) >> np.uint64(64 - bits)).astype(np.int64)
    return out


def bitmap(ids: DataFrame, rows: int) -> np.ndarray:
    """Bitmap of the column of ``ids`` (long, ``rows`` of them; NULL has no place); its parts are made in tasks."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_PER_ID * max(1, rows) - 1).bit_length()))
    chunk = min(bits, CHUNK_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_slots(b.column(0).drop_null().to_numpy(zero_copy_only=False), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> chunk).astype(np.int32)), pa.array((at & (1 << chunk) - 1).astype(np.int32))],
                                             ["part", "at"])

    def part(b: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << chunk, dtype=bool)
        flags[b["at"].to_numpy()] = True
        return pd.DataFrame({"part": b["part"].iloc[:1], "bits": [np.packbits(flags).tobytes()]})

    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in ids.mapInArrow(places, "part int, at int").groupBy("part").applyInPandas(part, "part int, bits binary").collect():
        out[r["part"] << (chunk - 3):][:1 << (chunk - 3)] = np.frombuffer(r["bits"], np.uint8)
    return out


def may_hold(marks: np.ndarray, id_: Column) -> Column:
    """False only where ``id_`` (long) is NULL or not among the ids of ``marks``; the ids alone go to Python."""
    bits = len(marks).bit_length() + 2

    def held(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in ids:
            at = _slots(s.to_numpy(), bits)
            yield pd.Series(((marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0))

    # a NULL among longs would make doubles of them
    return F.when(id_.isNull(), F.lit(False)).otherwise(F.pandas_udf(held, "boolean")(F.coalesce(id_, F.lit(0).cast("long"))))


def near(df: DataFrame, id_: Column, ids: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` before an inner join with ``ids`` on ``id_``: beyond what is broadcast, rows without a partner go (nearly all)."""
    return df if rows <= bound else df.where(may_hold(bitmap(ids, rows), id_))


def staying(df: DataFrame, id_: Column, verdicts: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose ``id_`` (long) stays by ``verdicts`` (``id, stays``; each id once); NULL ids stay.

    A short list of those that go is broadcast.  Else a bitmap of each side settles nearly all rows where they are read, and
    only those in both are joined.
    """
    sides = {r["stays"]: r["count"] for r in verdicts.groupBy("stays").count().collect()}
    name = unused(df, "id_")
    ids = {side: verdicts.where(F.col("stays") == side).select(F.col("id").alias(name)) for side in (True, False)}
    goes = sides.get(False, 0)
    if goes <= bound:
        return df.join(F.broadcast(ids[False]), id_ == F.col(name), "left_anti")
    may_stay, may_go = (may_hold(bitmap(ids[side], sides.get(side, 0)), id_) for side in (True, False))
    sure = df.where(~may_go)
    doubt = df.where(may_go & may_stay).join(ids[False], id_ == F.col(name), "left_anti")
    return sure.unionByName(doubt)
