"""Missing-value and column profiles (A1-A3, Q1-Q6).

The missing-value reports share one table: rows are grouped by their null mask, the
set of their NULL columns as bits (``null_masks``; one scan, pre-aggregated
map-side).  Counts per column, per row, per combination and per pair of columns are
sums over that table, which has as many rows as there are different masks, so any
number of reports reads the data once.

Distinct values are counted by (column, value), never by a distinct aggregate per
column; for tables that grow by parts, sketches of the values are kept per part and
merged (``distinct_sketches``, ``merged_sketches``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import pct, q
from .state import freeze

# Fixed value: label of the "no column missing" combination in the report.
NO_MISSING_LABEL = "NESSUNA"
COMBO_SEPARATOR = " | "
MASK_BITS = 62  # of one word of a null mask


def _cols(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    return list(cols) if cols else list(df.columns)


@dataclass
class NullMasks:
    """Rows ``__w0, __w1, ..., n_rows``: how many rows have exactly these columns NULL."""

    table: DataFrame
    cols: list[str]

    def words(self) -> list[str]:
        return [f"__w{k}" for k in range(-(-len(self.cols) // MASK_BITS))]

    def has(self, i: int, prefix: str = "__w") -> Column:
        """Whether column ``i`` is NULL in the rows of a mask."""
        return F.col(f"{prefix}{i // MASK_BITS}").bitwiseAND(F.lit(1 << i % MASK_BITS)) != 0

    def total(self) -> Column:
        """Total row count as a scalar subquery (evaluated once, no join)."""
        return self.table.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).scalar()


def null_masks(df: DataFrame, cols: Sequence[str] | None = None, keep: bool = False) -> NullMasks:
    """The table of null masks of ``cols``; ``keep`` writes it, for several reports."""
    cols = _cols(df, cols)
    words = []
    for k in range(0, len(cols), MASK_BITS):
        bits = [F.when(q(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(cols[k:k + MASK_BITS])]
        words.append(sum(bits[1:], bits[0]).alias(f"__w{k // MASK_BITS}"))
    table = df.groupBy(*words).agg(F.count(F.lit(1)).alias("n_rows"))
    return NullMasks(freeze(table).df if keep else table, cols)


def _masks(df: DataFrame | NullMasks, cols: Sequence[str] | None) -> NullMasks:
    return df if isinstance(df, NullMasks) else null_masks(df, cols)


def null_counts(df: DataFrame | NullMasks, cols: Sequence[str] | None = None, only_missing: bool = False) -> DataFrame:
    """A1/Q1: ``column, n_missing, pct_missing, n_non_missing`` per column.

    ``only_missing`` keeps the affected columns only (A1).
    """
    m = _masks(df, cols)
    one = m.table.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("__n"), *[
        F.coalesce(F.sum(F.when(m.has(i), F.col("n_rows"))), F.lit(0)).alias(f"__m{i}") for i in range(len(m.cols))])
    stacked = one.select("__n", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"__m{i}").alias("n_missing")) for i, c in enumerate(m.cols)])))
    out = stacked.select(
        "column", "n_missing",
        pct(F.col("n_missing"), F.col("__n")).alias("pct_missing"),
        (F.col("__n") - F.col("n_missing")).alias("n_non_missing"))
    if only_missing:
        out = out.where(F.col("n_missing") > 0)
    return out.orderBy(F.desc("n_missing"), "column")


def missing_per_row(df: DataFrame | NullMasks, cols: Sequence[str] | None = None) -> DataFrame:
    """Q2: number of rows by how many of ``cols`` are NULL in them."""
    m = _masks(df, cols)
    k = sum((F.bit_count(w) for w in m.words()), F.lit(0))
    g = m.table.groupBy(k.alias("n_missing")).agg(F.sum("n_rows").alias("n_rows"))
    return g.select("n_missing", "n_rows", pct(F.col("n_rows"), m.total()).alias("pct_rows")).orderBy("n_missing")


def missing_combinations(df: DataFrame | NullMasks, cols: Sequence[str] | None = None) -> DataFrame:
    """Q3: frequency of each set of NULL columns, ``A | B`` in column order."""
    m = _masks(df, cols)
    combo = F.concat_ws(COMBO_SEPARATOR, *[F.when(m.has(i), F.lit(c)) for i, c in enumerate(m.cols)])
    label = F.when(combo == "", F.lit(NO_MISSING_LABEL)).otherwise(combo)
    return (m.table.select(label.alias("missing_columns"), "n_rows", pct(F.col("n_rows"), m.total()).alias("pct_rows"))
            .orderBy(F.desc("n_rows"), "missing_columns"))


def co_missing(df: DataFrame | NullMasks, cols: Sequence[str] | None = None, wide: bool = False) -> DataFrame:
    """Q4: for each column pair, whether some row has both NULL.

    Per column, the OR of the masks that contain it has the bits of all its partners;
    long form ``(column_a, column_b, both_missing)`` or the wide matrix.
    """
    m = _masks(df, cols)
    one = m.table.agg(*[F.bit_or(F.when(m.has(i), F.col(w))).alias(f"__or{i}_{k}")
                        for i in range(len(m.cols)) for k, w in enumerate(m.words())])
    rows = one.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("column_a"), F.array(*[F.col(f"__or{i}_{k}") for k in range(len(m.words()))]).alias("words"))
        for i, a in enumerate(m.cols)])))

    def partner(name: Column, j: Column) -> Column:
        word = F.get("words", F.floor(j / MASK_BITS).cast("int"))
        bit = F.call_function("shiftright", word, (j % MASK_BITS).cast("int")).bitwiseAND(F.lit(1)) == 1
        return F.struct(name.alias("column_b"), F.coalesce(bit, F.lit(False)).alias("both_missing"))

    long = rows.select("column_a", F.inline(F.transform(F.lit(m.cols), partner)))
    if not wide:
        return long
    return long.groupBy("column_a").pivot("column_b", m.cols).agg(F.first("both_missing"))


# ------------------------------------------------------------------ distinct values
def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column`` (number), ``value`` (string): the distinct non-null values, de-duplicated map-side."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("column"), q(c).cast(T.StringType()).alias("value")) for i, c in enumerate(cols)])))
    return long.where(F.col("value").isNotNull()).distinct()


def column_overview(df: DataFrame, cols: Sequence[str] | None = None, exact_distinct: bool = True,
                    rsd: float = 0.01) -> DataFrame:
    """Q5: ``feature, dtype, total_rows, missing_count, missing_percentage,
    unique_non_null_values``.

    Exact counts come from the distinct (column, value) pairs; ``exact_distinct=False``
    switches to ``approx_count_distinct`` (HyperLogLog, relative error ``rsd``) for
    very wide or very large tables.
    """
    cols = _cols(df, cols)
    dtypes = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.count_if(q(c).isNull()).alias(f"__m{i}") for i, c in enumerate(cols)]
    if not exact_distinct:
        aggs += [F.approx_count_distinct(q(c), rsd).alias(f"__d{i}") for i, c in enumerate(cols)]
    rows = df.agg(*aggs).select("__n", F.inline(F.array(*[
        F.struct(F.lit(i).alias("column"), F.lit(c).alias("feature"), F.lit(dtypes[c]).alias("dtype"), q(f"__m{i}").alias("missing_count"),
                 (F.lit(None).cast("long") if exact_distinct else F.col(f"__d{i}")).alias("n_distinct"))
        for i, c in enumerate(cols)])))
    if exact_distinct:
        counts = distinct_values(df, cols).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
        rows = rows.join(counts, "column", "left").withColumn("n_distinct", F.coalesce("n", F.lit(0)))
    return rows.select(
        "feature", "dtype", F.col("__n").alias("total_rows"), "missing_count",
        pct(F.col("missing_count"), F.col("__n")).alias("missing_percentage"),
        F.col("n_distinct").cast(T.LongType()).alias("unique_non_null_values"))


def distinct_sketches(df: DataFrame, part: Column, cols: Sequence[str] | None = None, lg_k: int = 12) -> DataFrame:
    """Mergeable state of a profile: ``part, column, n_rows, n_missing, sketch`` per part of a table.

    A part (a day, a file, a run) is profiled once; later runs add their parts' rows
    to the stored ones and merge (:func:`merged_sketches`) without reading old data.
    """
    cols = _cols(df, cols)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        aggs += [F.count_if(q(c).isNull()).alias(f"__m{i}"), F.hll_sketch_agg(q(c).cast(T.StringType()), lg_k).alias(f"__s{i}")]
    return df.groupBy(part.alias("part")).agg(*aggs).select("part", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col("__n").alias("n_rows"), F.col(f"__m{i}").alias("n_missing"),
                 F.col(f"__s{i}").alias("sketch")) for i, c in enumerate(cols)])))


def sketch_error(lg_k: int = 12, deviations: float = 3.0) -> float:
    """Bound of the relative error of an estimate from merged sketches (``deviations`` standard errors)."""
    return deviations * 1.04 / 2 ** (lg_k / 2)


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """``column, n_rows, n_missing, n_distinct`` (estimated) over all parts."""
    return sketches.groupBy("column").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_missing").alias("n_missing"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def distinct_preview(df: DataFrame, cols: Sequence[str] | None = None, preview: int = 20) -> DataFrame:
    """A2: per text column, the number of distinct non-null values and the
    ``preview`` smallest of them joined by ``', '``.

    Distinct values come from one ``groupBy(column, value)`` (map-side
    de-duplication); the preview is a per-column row-number limit that Spark
    pushes below the shuffle (window group limit), so no column's values are
    ever gathered in one task beyond ``preview`` per partition.
    """
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    cols = list(cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, n_distinct long, preview string")
    names = F.lit(cols)
    distinct = distinct_values(df, cols).select(F.element_at(names, F.col("column") + 1).alias("column"), "value")
    counts = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    w = Window.partitionBy("column").orderBy("value")
    head = (distinct.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= preview)
            .groupBy("column")
            .agg(F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("preview")))
    return counts.join(head, "column", "left")


def shape(df: DataFrame) -> DataFrame:
    """A3: rows, columns and the distinct column types, as one row."""
    types = sorted({t for _, t in df.dtypes})
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast(T.LongType()).alias("n_columns"),
        F.lit(", ".join(types)).alias("dtypes"))


def summary(df: DataFrame, cols: Sequence[str] | None = None, top: int = 20) -> dict[str, DataFrame]:
    """Q6: the text summary as DataFrames (shape, per column, per row, top combinations, pairs); one scan."""
    given = df.select(*[q(c) for c in _cols(df, cols)])
    m = null_masks(given, keep=True)
    types = sorted({t for _, t in given.dtypes})
    return {
        "shape": m.table.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")).select(
            "n_rows", F.lit(len(m.cols)).cast(T.LongType()).alias("n_columns"), F.lit(", ".join(types)).alias("dtypes")),
        "missing_per_column": null_counts(m),
        "missing_per_row": missing_per_row(m),
        "top_combinations": missing_combinations(m).limit(top),
        "missing_together": co_missing(m),
    }
