"""Mixing sources to target weights under a time-varying curriculum.

Each source gets a share of a word budget in proportion to its weight, at most
``max_epochs`` times its own size; what is beyond that goes to the others by
weight.  Over the course of training (time 0 to 1) a source's weight follows a
schedule.  The integral of the schedule is the source's cumulative demand; a
document that starts at word c of its source's stream of T words is read at the
time where the demand reaches c / T.  Sorting by that time by range gives the
training order.

Within a source, documents come in the order of a hash of their id, pass after
pass.  Running sums are kept per hash bucket of about ``bucket_rows`` rows, and
the sums of whole buckets are added, so a source that holds a third of all rows
is spread over many tasks.

Defined results: NULL text has size 0; NULL is a source of its own, last in
order; NULL ``doc_id`` sorts as the empty string; repeated rows are taken each on
their own; rows with equal ids go by size, then (in ``mixed_documents``) by a number of
their own; documents of size 0 are taken 0 times; texts of any length are one document,
cut only where a target ends; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import q
from .common import frozen, ids_name_rows, packed, small_side, unpacked, word_count

HASH_BITS = 60


@dataclass(frozen=True)
class Schedule:
    """A weight's course: linear between (time, height) knots from time 0 to 1, heights >= 0, not all 0."""

    knots: tuple[tuple[float, float], ...] = ((0.0, 1.0), (1.0, 1.0))

    def inverse(self, share: Column) -> Column:
        """The time at which ``share`` (0 to 1) of the integral is reached."""
        pieces, done = [], 0.0
        for (t0, v0), (t1, v1) in zip(self.knots, self.knots[1:]):
            area = (v0 + v1) / 2.0 * (t1 - t0)
            pieces.append((done, t0, t1, v0, (v1 - v0) / (t1 - t0)))
            done += area
        x = share * F.lit(done)
        out = F.lit(None).cast("double")
        for before, t0, t1, v0, slope in pieces:  # later pieces override earlier ones
            r = x - F.lit(before)
            root = F.lit(v0) + F.sqrt(F.greatest(F.lit(v0 * v0) + F.lit(2.0 * slope) * r, F.lit(0.0)))
            inside = F.when(root > 0, F.least(F.lit(t0) + F.lit(2.0) * r / root, F.lit(t1))).otherwise(F.lit(t0))
            out = F.when(r >= 0, inside).otherwise(out)
        return out


#: Per place in the cycle of weights: steady, rising and falling over training.
SCHEDULES = (Schedule(), Schedule(((0.0, 0.5), (1.0, 1.5))), Schedule(((0.0, 1.5), (1.0, 0.5))))


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, max_epochs: float) -> DataFrame:
    """Per source (columns ``source``, ``source_size``): ``slot``, ``weight`` and ``target``.

    Sources that stop at ``max_epochs`` times their size are those with the
    smallest size per weight.  With sources in that order, (budget left by those
    before) / (weight from here on) rises until the first source that does not
    stop, then falls; its maximum is the words per weight of all that do not.
    The table has one row per source, the labels of the recipe.
    """
    slot = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("slot", slot.cast("int"))
    w = F.lit(float(weights[-1]))
    for i, x in enumerate(weights[:-1]):
        w = F.when(F.col("slot") % len(weights) == i, F.lit(float(x))).otherwise(w)
    s = s.withColumn("weight", w).withColumn("cap", F.col("source_size").cast("double") * F.lit(float(max_epochs)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "slot")
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    demand = F.sum("source_size").over(everything).cast("double") * F.lit(float(budget))
    s = s.withColumn("level", (demand - before) / rest)
    level = F.max("level").over(everything)
    return s.select("source", "source_size", "slot",
                    F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), schedules: Sequence[Schedule] = SCHEDULES,
        budget: float = 1.5, max_epochs: float = 2.0, seed: str = "mix", bucket_rows: int = 50_000,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        row_col: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken, copies``.

    With ``row_col``, a number that no two rows share, it comes back as ``row``.

    ``copies`` lists the passes in which the document is read: ``epoch``, ``take``
    (words; the last document of a source is cut where its target is reached) and
    ``position``, the training time.  ``taken`` is the sum of the takes.
    """
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(q(id_col).cast("string"), F.lit("")), F.lit(seed))),
                             1, HASH_BITS // 4), 16, 10).cast("long")
    row = q(row_col).alias("row") if row_col else F.lit(0).cast("long").alias("row")
    base = frozen(docs.select(q(id_col).alias("doc_id"), q(source_col).alias("source"),
                              word_count(q(text_col)).alias("size"), key.alias("key"), row))
    buckets = max(1, math.ceil(base.count() / bucket_rows))
    bucket = F.least(F.floor(F.col("key").cast("double") / F.lit(2.0 ** HASH_BITS) * F.lit(buckets)),
                     F.lit(buckets - 1)).cast("int")
    base = base.withColumn("bucket", bucket)
    sums = base.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sizes = sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    targets = frozen(source_targets(sizes, weights, budget, max_epochs))
    same = lambda other: base["source"].eqNullSafe(other["source"])

    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("offset"))
    offsets = (offsets.join(targets, offsets["source"].eqNullSafe(targets["source"]))
               .select("slot", "bucket", "offset"))
    rows = base.join(targets, same(targets)).select(
        "doc_id", base["source"], "size", "key", "row", "bucket", "slot", "source_size", "target")
    here = Window.partitionBy("slot", "bucket").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    rows = (rows.withColumn("before", F.sum("size").over(here) - F.col("size"))
            .join(offsets, ["slot", "bucket"]))
    wanted = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    start = F.col("offset") + F.col("before")

    def position(first: Column) -> Column:
        share = F.least(first.cast("double") / F.col("target"), F.lit(1.0))
        out = schedules[-1].inverse(share)
        for i, s in enumerate(schedules[:-1]):
            out = F.when(F.col("slot") % len(schedules) == i, s.inverse(share)).otherwise(out)
        return out

    passes = []
    for epoch in range(math.ceil(max_epochs)):
        first = start + F.col("source_size") * F.lit(epoch)
        take = F.least(F.col("size"), F.greatest(wanted - first, F.lit(0)))
        passes.append(F.when(take > 0, F.struct(F.lit(epoch).alias("epoch"), take.cast("long").alias("take"),
                                                position(first).alias("position"))))
    copies = F.filter(F.array(*passes), lambda c: c.isNotNull())
    rows = rows.withColumn("copies", copies)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda acc, c: acc + c["take"])
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "copies",
                       *(["row"] if row_col else []))


def training_order(mixed: DataFrame, *by: str) -> DataFrame:
    """Rows sorted by training position (range partitions in order)."""
    return mixed.orderBy("position", *by)


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` (``doc_id``, ``text``, ``source`` and other columns) in training order, once per pass.

    A pass that reads less than half of a document leaves it out and one that
    reads more has all of it, so a source is within one document of its target.
    Where ids repeat or are NULL, rows are numbered first, so each has passes of its own.
    """
    rows = packed(docs, q("doc_id").alias("doc_id"), q("text").alias("text"), q("source").alias("source"))
    named = ids_name_rows(docs, "doc_id")
    rows = rows if named else frozen(rows.withColumn("number", F.monotonically_increasing_id()))
    plan = mix(rows, **how, row_col=None if named else "number")
    copies = F.transform(F.filter("copies", lambda c: c["take"] * 2 >= F.col("size")), lambda c: c["position"])
    key = "doc_id" if named else "number"
    plan = frozen(plan.select(F.col("doc_id" if named else "row").alias("of"), F.explode(copies).alias("position")))
    both = rows.join(small_side(plan, plan.count()), F.col(key) == F.col("of"))
    return unpacked(both.orderBy("position", "doc_id", *([] if named else ["number"])), docs.columns)
