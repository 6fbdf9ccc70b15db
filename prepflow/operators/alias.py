"""Sampling from frequency dictionaries through alias tables.

An alias table has one slot per category, all of equal probability.  A slot keeps
its own category for a part of its weight and gives the rest to one other category,
its alias, so a draw is one equi-join on (feature, slot) whatever the frequencies.

With K categories and N counted values, category i weighs n_i K and a slot holds N.
Categories below N leave room, those above have a surplus.  Laid out one after
another, the rooms and the surpluses cover the same line, in integers:

* a light slot's room is filled by the heavy category whose surplus covers the
  point where the room begins;
* a heavy category that is asked for more than its surplus (a room reaches beyond
  its end) leaves that much of its own slot to the next heavy category.

So the tables come from running sums and two range lookups, each an equi-join on
buckets of the line; no task walks through the categories.

Only cells that are NULL are drawn: they are unpivoted, joined with the tables of
all features at once, and folded back by row key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_uniform, q
from .prefix import running_sums
from .state import DEFAULT_MAX_BROADCAST_ROWS, StateTable, freeze

DICT_SEED = "dict"  # seed of the hash that orders dictionary categories
ORDER_BUCKETS = 1024


def fill_seed(seed: int) -> str:
    """Seed namespace of the sampling draws (independent of the split draws)."""
    return f"fill:{seed}"


def _covering(points: DataFrame, intervals: DataFrame, buckets: Column, extra: Sequence[str], how: str) -> DataFrame:
    """``points`` (``feature, point``) with the interval ``[lo, hi)`` of the feature's line that covers each.

    ``line`` (the line's length) and ``k`` are columns of both; the lookup is an
    equi-join on buckets of the line, as many as there are categories.  One bucket of
    margin absorbs the rounding of the division.
    """
    place = lambda x: F.floor(x.cast("double") / F.col("line") * buckets)
    spread = intervals.select(
        F.col("feature").alias("of"), "lo", "hi", *extra,
        F.explode(F.sequence(F.greatest(place(F.col("lo")) - 1, F.lit(0)), place(F.col("hi")) + 1)).alias("bucket"))
    asked = points.withColumn("at", place(F.col("point")))
    return asked.join(spread, (F.col("feature") == F.col("of")) & (F.col("at") == F.col("bucket"))
                      & (F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi")), how).drop("of", "at", "bucket", "lo", "hi")


def alias_tables(counts: DataFrame) -> DataFrame:
    """``feature, slot, value, keep, alias, total, k`` from ``feature, value, n`` (``n`` at least 1).

    The slot keeps ``value`` for ``keep`` of its ``total`` weight and gives the rest
    to ``alias`` (NULL if it keeps all).  Slots are numbered from 0 in the order of
    (hash bucket of the value, value).  ``n * k`` must fit 64 bits.
    """
    sizes = counts.groupBy("feature").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    rest = F.col("n") * F.col("k") - F.col("total")
    rows = counts.select("feature", "value", "n").join(F.broadcast(sizes), "feature").withColumns({
        "one": F.lit(1).cast("long"), "room": F.greatest(-rest, F.lit(0)), "surplus": F.greatest(rest, F.lit(0))})
    bucket = F.floor(hash_uniform(["value"], DICT_SEED) * F.lit(ORDER_BUCKETS)).cast("long")
    rows = running_sums(rows, bucket, [F.asc("value")], ["one", "room", "surplus"], "upto_", ["feature"], ORDER_BUCKETS)
    lines = rows.groupBy("feature").agg(F.sum("room").alias("line"))
    rows = freeze(rows.join(F.broadcast(lines), "feature").withColumn("slot", F.col("upto_one") - 1)).df
    light, heavy = rows.where(F.col("room") > 0), rows.where(F.col("room") == 0)

    rooms = light.select("feature", "k", "line", (F.col("upto_room") - F.col("room")).alias("lo"), F.col("upto_room").alias("hi"),
                         F.col("upto_room").alias("room_end"))
    surpluses = heavy.where(F.col("surplus") > 0).select(
        "feature", "k", "line", (F.col("upto_surplus") - F.col("surplus")).alias("lo"), F.col("upto_surplus").alias("hi"),
        F.col("value").alias("alias"))
    # a room that starts before a heavy category's end and reaches beyond it
    ends = _covering(heavy.withColumn("point", F.col("upto_surplus") - 1).where(F.col("surplus") > 0), rooms, F.col("k"),
                     ["room_end"], "left")
    over = F.coalesce(F.col("room_end") - F.col("upto_surplus"), F.lit(0))
    columns = ["feature", "slot", "value", "total", "k", "line"]
    asking = light.select(*columns, (F.col("n") * F.col("k")).alias("keep"), (F.col("upto_room") - F.col("room")).alias("point"))
    asking = asking.unionByName(ends.where(over > 0).select(*columns, (F.col("total") - over).alias("keep"),
                                                            F.col("upto_surplus").alias("point")))
    given = _covering(asking, surpluses, F.col("k"), ["alias"], "inner").select("feature", "slot", "value", "keep", "alias", "total", "k")
    whole = ends.where(over == 0).unionByName(heavy.where(F.col("surplus") == 0), allowMissingColumns=True)
    return given.unionByName(whole.select("feature", "slot", "value", F.col("total").alias("keep"),
                                          F.lit(None).cast("string").alias("alias"), "total", "k"))


@dataclass
class AliasState:
    """Frozen alias tables and the number of slots of each feature."""

    table: StateTable
    slots: dict[str, int]


def fit_alias(counts: DataFrame) -> AliasState:
    table = freeze(alias_tables(counts))
    slots = table.df.groupBy("feature").agg(F.max("k").alias("k")).collect()  # a row per feature
    return AliasState(table, {r["feature"]: r["k"] for r in slots})


def drawn_cells(df: DataFrame, seeds: Mapping[str, int], state: AliasState, row_key: Sequence[str],
                max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """One row per row key with a NULL among the features: the drawn values, ``__drawn_{feature}``.

    The draw of a cell depends on the row key and the feature's seed alone, so rows
    that share a key share their draws.  A feature without categories draws nothing.
    """
    names = [f"__r{i}" for i in range(len(row_key))]
    cells = []
    for f, seed in seeds.items():
        if f in state.slots:
            at = hash_uniform(list(row_key), fill_seed(seed)) * F.lit(float(state.slots[f]))
            cells.append(F.when(q(f).isNull(), F.struct(F.lit(f).alias("__feature"), at.alias("__at"))))
    if not cells:
        cells = [F.lit(None).cast("struct<__feature:string,__at:double>")]
    asked = df.select(*[q(k).alias(n) for k, n in zip(row_key, names)],
                      F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull())))
    table = state.table.for_join(max_broadcast_rows)
    found = asked.withColumn("__slot", F.floor("__at")).join(
        table, (F.col("__feature") == F.col("feature")) & (F.col("__slot") == F.col("slot")))
    value = F.when((F.col("__at") - F.col("__slot")) * F.col("total") < F.col("keep"), F.col("value")).otherwise(F.col("alias"))
    return found.groupBy(*names).agg(*[F.max(F.when(F.col("__feature") == f, value)).alias(f"__drawn_{f}") for f in seeds])


def alias_fill(df: DataFrame, seeds: Mapping[str, int], state: AliasState, row_key: Sequence[str],
               max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS, of: DataFrame | None = None) -> DataFrame:
    """NULLs of all features take draws from their dictionaries: one join with the tables, one by row key.

    ``of`` is the frame whose NULL cells are drawn (by default ``df``): a caller that
    fills some of them by other means passes the frame it started from.
    """
    drawn = drawn_cells(df if of is None else of, seeds, state, row_key, max_broadcast_rows)
    same = F.lit(True)
    for i, k in enumerate(row_key):
        same = same & q(k).eqNullSafe(F.col(f"__r{i}"))
    filled = {f: F.coalesce(q(f), F.col(f"__drawn_{f}").cast(df.schema[f].dataType)) for f in seeds}
    return df.join(drawn, same, "left").select(*[filled[c].alias(c) if c in filled else q(c) for c in df.columns])
