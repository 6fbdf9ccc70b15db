"""Radix selection and running sums over the order of doubles.

A double has an order-preserving 64-bit image (the number its bits spell, negated
for negative values).  Values are counted per (key, value) first, so repeats cost
nothing.  Then cells are refined from the top: the cell of level 0 is a key, that of
level k the next ``BITS`` bits of the image.  Only cells with more than ``limit``
distinct values are refined, and for ranks only those that hold a wanted one; the
counts of a cell's children give the running sums up to each child.  What is left
are cells of at most ``limit`` values, and one window per cell orders them.

So a key that holds most of the rows, or values that crowd in a narrow range, are
spread over many tasks, and keys of a few values - or small tables - need the window
alone.  Nothing is approximate, and no cut points pass through the driver: a level
asks for one number, the largest count of a cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import q
from .state import StateTable, freeze

BITS = 16
LIMIT = 20_000  # distinct values in one window
MANTISSA = 52
LEAST_EXPONENT = -1022
#: Images of +infinity and NaN: their bits.
INFINITE, NOT_A_NUMBER = 0x7FF0000000000000, 0x7FF8000000000000


def double_image(value: Column) -> Column:
    """Order-preserving 64-bit image of a double (long): NULL stays NULL, -0.0 is 0.0, NaN comes last."""
    size = F.abs(value)
    guess = F.greatest(F.floor(F.log2(size)), F.lit(LEAST_EXPONENT))
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    # the logarithm may round to the next exponent
    exponent = F.greatest(F.when(size < power(guess), guess - 1).when(size / power(guess) >= 2.0, guess + 1)
                          .otherwise(guess), F.lit(LEAST_EXPONENT))
    fraction = (size / power(exponent) * F.lit(2.0 ** MANTISSA)).try_cast("long")
    bits = F.when(size == 0.0, F.lit(0).cast("long")).when(F.isnan(size), F.lit(NOT_A_NUMBER)).when(
        size == F.lit(float("inf")), F.lit(INFINITE)).otherwise(
        (exponent - LEAST_EXPONENT).cast("long") * F.lit(1 << MANTISSA) + fraction)
    return F.when(value < 0.0, -bits).otherwise(bits)


def _prefix(level: int) -> Column:
    """The image's bits down to a level; level 0 has none."""
    return F.shiftright("__image", 64 - BITS * level) if level else F.lit(0).cast("long")


@dataclass
class Counted:
    """Rows ``names..., __value, __image, sums...``: one per key and distinct value."""

    rows: StateTable
    names: list[str]
    sums: list[str]
    keys: list[str]

    def named(self) -> list[Column]:
        """The key columns under their own names."""
        return [q(n).alias(k) for n, k in zip(self.names, self.keys)]

    def joined(self, cells: DataFrame, level: int, extra: Sequence[str]) -> DataFrame:
        """The rows inside ``cells`` of a level, with the cells' ``extra`` columns."""
        named = cells.select(*[q(n).alias(f"__c{n}") for n in self.names], F.col("__cell").alias("__in"), *extra)
        same = F.col("__at") == F.col("__in")
        for n in self.names:
            same = same & q(n).eqNullSafe(q(f"__c{n}"))
        rows = self.rows.df.withColumn("__at", _prefix(level))
        return rows.join(named, same).drop("__at", *[f"__c{n}" for n in self.names])


def counted(df: DataFrame, keys: Sequence[str], value: str, aggregates: dict[str, Column],
            checkpoint: bool = True) -> Counted:
    """``df`` reduced to one row per (keys, value); rows without a value are left out.

    Written to the checkpoint folder, as every level reads it; ``checkpoint=False``
    is for frames that are already there.
    """
    names = [f"__k{i}" for i in range(len(keys))] or ["__one"]
    by = [q(k).alias(n) for k, n in zip(keys, names)] or [F.lit(0).alias("__one")]
    rows = (df.where(q(value).isNotNull()).groupBy(*by, q(value).cast("double").alias("__value"))
            .agg(*[a.alias(n) for n, a in aggregates.items()]))
    rows = rows.withColumn("__image", double_image(F.col("__value")))
    return Counted(freeze(rows, checkpoint), names, list(aggregates), list(keys))


def _leaves(per: Counted, limit: int, wanted: Column | None = None) -> Iterator[tuple[int, DataFrame]]:
    """(level, cells of at most ``limit`` values): ``names, __cell, __before_x, __total_x, __all`` per sum x.

    ``__before_x`` is the sum over all smaller values of the key.  ``wanted`` is a
    condition on these columns and on ``__all`` (the key's sum of the first column)
    for the cells to keep; others are not refined either.
    """
    sums = per.sums
    totals = [F.count(F.lit(1)).alias("__d"), *[F.sum(s).alias(f"__total_{s}") for s in sums]]
    cells = (per.rows.df.groupBy(*per.names).agg(*totals).withColumn("__cell", F.lit(0).cast("long"))
             .withColumn("__all", F.col(f"__total_{sums[0]}")))
    cells = cells.withColumns({f"__before_{s}": F.lit(0).cast("long") for s in sums})
    kept = [f"__before_{s}" for s in sums] + [f"__total_{s}" for s in sums] + ["__all"]
    level = 0
    while True:
        if wanted is not None:
            cells = cells.where(wanted)
        if level * BITS >= 64 or (cells.agg(F.max("__d")).first()[0] or 0) <= limit:
            yield level, cells.select(*per.names, "__cell", *kept)
            return
        yield level, cells.where(F.col("__d") <= limit).select(*per.names, "__cell", *kept)
        # each of these holds more than ``limit`` of the counted values
        big = freeze(cells.where(F.col("__d") > limit).select(*per.names, "__cell", *[f"__before_{s}" for s in sums], "__all"))
        level += 1
        above = [F.col(f"__before_{s}").alias(f"__above_{s}") for s in sums]
        inside = per.joined(big.for_join(), level - 1, [*above, "__all"])
        parent = [*per.names, "__in"]
        cells = (inside.withColumn("__cell", _prefix(level))
                 .groupBy(*parent, "__cell", "__all", *[f"__above_{s}" for s in sums]).agg(*totals))
        earlier = Window.partitionBy(*parent).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = freeze(cells.withColumns({
            f"__before_{s}": F.col(f"__above_{s}") + F.coalesce(F.sum(f"__total_{s}").over(earlier), F.lit(0))
            for s in sums})).df


def _small_keys(per: Counted, limit: int) -> bool:
    """Whether no key has more than ``limit`` values."""
    if per.rows.n_rows <= limit:
        return True
    most = per.rows.df.groupBy(*per.names).agg(F.count(F.lit(1)).alias("d")).agg(F.max("d")).first()[0]
    return most <= limit


def running(per: Counted, limit: int | None = None, prefix: str = "cum_", wanted: Column | None = None) -> DataFrame:
    """The counted rows with inclusive running sums ``{prefix}{sum}`` in the order of the values, per key.

    ``__all`` is the key's total of the first sum.  With ``wanted`` (see
    :func:`_leaves`) rows of cells that do not meet it may be left out.
    """
    limit = limit or LIMIT
    if _small_keys(per, limit):
        by_key = Window.partitionBy(*per.names)
        upto = by_key.orderBy("__image").rowsBetween(Window.unboundedPreceding, 0)
        return per.rows.df.withColumns({**{f"{prefix}{s}": F.sum(s).over(upto) for s in per.sums},
                                        "__all": F.sum(per.sums[0]).over(by_key)}).drop("__image")
    out = None
    for level, cells in _leaves(per, limit, wanted):
        rows = per.joined(cells, level, [*[f"__before_{s}" for s in per.sums], "__all"])
        upto = Window.partitionBy(*per.names, "__in").orderBy("__image").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({f"{prefix}{s}": F.col(f"__before_{s}") + F.sum(s).over(upto) for s in per.sums})
        rows = rows.drop("__in", "__image", *[f"__before_{s}" for s in per.sums])
        out = rows if out is None else out.unionByName(rows)
    return out


def exact_medians(df: DataFrame, keys: Sequence[str], target: str, out: str = "median",
                  limit: int | None = None) -> DataFrame:
    """Exact medians (interpolated) of ``target`` per ``keys``; NULL targets are left out, NULL keys are a key."""
    per = counted(df, keys, target, {"__n": F.count(F.lit(1))})
    low, high = F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)
    first, last = F.col("__before___n"), F.col("__before___n") + F.col("__total___n")
    rows = running(per, limit, "__upto", (low < last) & (high >= first))
    at = lambda place: F.max(F.when((F.col("__upto__n") - F.col("__n") <= place)
                                    & (place < F.col("__upto__n")), F.col("__value")))
    both = rows.groupBy(*per.names).agg(at(low).alias("__low"), at(high).alias("__high"))
    return both.select(*per.named(), ((F.col("__low") + F.col("__high")) / 2.0).alias(out)).where(q(out).isNotNull())
