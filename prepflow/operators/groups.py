"""Group statistics broadcast back to rows.

pandas ``groupby(...).transform(...)`` is an unordered whole-group window.
Two physical shapes are offered:

* ``via="join"`` (default): ``groupBy(key).agg(...)`` with map-side partial
  aggregation, then a left join of the one-row-per-group result back to the
  rows.  AQE turns the join into a broadcast hash join when the statistics
  turn out small at runtime (a measured size bound), and otherwise keeps a
  sort-merge join whose skewed partitions it splits.  A group holding a
  third of all rows is therefore never processed by one task.
* ``via="window"``: ``agg.over(Window.partitionBy(key))`` - one exchange and
  one sort for any number of statistics, but a hot group lands in one task.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import q

STAT_PREFIX = "__gs_"


def with_group_stats(df: DataFrame, key: str, stats: Mapping[str, Column],
                     via: str = "join") -> DataFrame:
    """Add one column per ``stats`` entry holding that aggregate of the row's group.

    Rows whose key is NULL get NULL statistics (pandas drops NaN keys in
    ``groupby``).  ``stats`` maps output name -> aggregate expression.
    """
    if not stats:
        return df
    if via == "window":
        w = Window.partitionBy(key)
        cols = {name: F.when(q(key).isNotNull(), agg.over(w)) for name, agg in stats.items()}
        return df.withColumns(cols)
    if via != "join":
        raise ValueError(f"unknown strategy {via!r}")
    tmp_key = STAT_PREFIX + key
    agg_df = (df.where(q(key).isNotNull())
              .groupBy(q(key).alias(tmp_key))
              .agg(*[agg.alias(name) for name, agg in stats.items()]))
    out = df.join(agg_df, q(key) == q(tmp_key), "left").drop(tmp_key)
    return out


def group_size(df: DataFrame, key: str, name: str = "GroupSize", via: str = "join") -> DataFrame:
    """Number of non-null keys in the row's group."""
    return with_group_stats(df, key, {name: F.count(q(key))}, via=via)


def counted_modes(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
                  name: Callable[[str], str] = lambda c: c) -> DataFrame:
    """Per ``keys``, the most frequent non-null value of each column (the smallest on ties).

    All columns go through one unpivot and one count per (keys, column, value); the
    largest count then wins by an aggregate that combines map-side.  No task holds the
    values of a group, so a group of any size and any number of values is spread.
    Values keep their type (each type has a place of its own in the unpivoted row).
    Keys without any value have no row; without keys there is one row.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    types = list(dict.fromkeys(df.schema[c].dataType for c in cols))
    at = {c: types.index(df.schema[c].dataType) for c in cols}
    cells = [F.struct(F.lit(i).alias("__col"), *[
        (q(c) if at[c] == j else F.lit(None)).cast(t).alias(f"__v{j}") for j, t in enumerate(types)])
        for i, c in enumerate(cols)]
    values = [f"__v{j}" for j in range(len(types))]
    long = (df.select(*[q(k).alias(n) for k, n in zip(keys, names)], F.inline(F.array(*cells)))
            .where(functools.reduce(Column.__or__, [F.col(v).isNotNull() for v in values])))
    counts = long.groupBy(*names, "__col", *values).agg(F.count(F.lit(1)).alias("__n"))
    best = [F.min(F.when((F.col("__col") == i) & F.col(f"__v{at[c]}").isNotNull(),
                         F.struct((-F.col("__n")).alias("less"), F.col(f"__v{at[c]}").alias("value"))))["value"]
            .alias(name(c)) for i, c in enumerate(cols)]
    return counts.groupBy(*names).agg(*best).select(*[q(n).alias(k) for k, n in zip(keys, names)],
                                                    *[q(name(c)) for c in cols])


def with_group_modes(df: DataFrame, key: str, cols: Sequence[str], name: Callable[[str], str],
                     of: DataFrame | None = None) -> DataFrame:
    """``df`` with the modes of each column in the row's group (of the rows ``of``, by default ``df`` itself)."""
    if not cols:
        return df
    given = (df if of is None else of).where(q(key).isNotNull()).select(q(key).alias(STAT_PREFIX + key), *map(q, cols))
    modes = counted_modes(given, [STAT_PREFIX + key], cols, name)
    return df.join(modes, q(key) == q(STAT_PREFIX + key), "left").drop(STAT_PREFIX + key)
