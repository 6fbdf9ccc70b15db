"""Categorical and numeric encodings with fit/apply state.

The fitted state of categories is a table ``column, value, code, n``: values are
counted by (column, value) and numbered in order by distributed ranks, whatever
their number (``fit_category_table``).

* Wide output (one 0/1 column per category) decides the schema, so its categories
  are brought to the driver, under a limit; applying is a projection.
* Codes come from a literal map for columns within the limit and from a join with
  the table beyond it, broadcast only under a size bound.
* Sparse output - the indices of the active categories, or one sparse ML vector -
  has no limit: a row holds one index per encoded column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import q
from .prefix import ranks_by_range
from .reshape import drop_existing
from .state import DEFAULT_MAX_BROADCAST_ROWS, StateTable, freeze

DEFAULT_MAX_CATEGORIES = 1000  # of a column, for wide output and literal maps
NULL_LABEL = "nan"  # fixed: pandas' string form of a missing float after astype(str)


@dataclass
class OneHotState:
    columns: list[str]
    categories: dict[str, list[str]]   # sorted category labels per column
    null_label: str | None
    drop_first: bool

    def output_names(self) -> list[str]:
        names = []
        for c in self.columns:
            cats = self.categories[c][1:] if self.drop_first else self.categories[c]
            names += [f"{c}_{v}" for v in cats]
        return names


def _labels(c: str, null_label: str | None) -> Column:
    s = q(c).cast(T.StringType())
    return F.coalesce(s, F.lit(null_label)) if null_label is not None else s


@dataclass
class CategoryTable:
    """Frozen categories ``column, value, code, n`` and the number of categories per column."""

    table: StateTable
    sizes: dict[str, int]  # of the columns, in their order
    null_label: str | None = None

    def small(self, most: int) -> dict[str, list[str]]:
        """Sorted categories of the columns with at most ``most`` of them (a bounded collect)."""
        out: dict[str, list[str]] = {c: [] for c, n in self.sizes.items() if n <= most}
        if out:
            for r in self.table.df.where(F.col("column").isin(*out)).orderBy("column", "code").select("column", "value").collect():
                out[r["column"]].append(r["value"])
        return out


def fit_category_table(df: DataFrame, cols: Sequence[str], null_label: str | None = None) -> CategoryTable:
    """Categories of any number, numbered from 0 in the bytewise order of their string form per column."""
    cols = [c for c in cols if c in df.columns]
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), _labels(c, null_label).alias("value")) for c in cols]))) if cols else \
        df.sparkSession.createDataFrame([], "column string, value string")
    counts = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    table = freeze(ranks_by_range(counts, ["column"], ["value"], "code").select("column", "value", "code", "n"))
    found = {r["column"]: r["n"] for r in table.df.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    return CategoryTable(table, {c: found.get(c, 0) for c in cols}, null_label)


def fit_categories(df: DataFrame, cols: Sequence[str], null_label: str | None = NULL_LABEL,
                   max_categories: int = DEFAULT_MAX_CATEGORIES) -> dict[str, list[str]]:
    """Sorted distinct labels per column for wide output; raises if a column exceeds ``max_categories``."""
    if not cols:
        return {}
    state = fit_category_table(df, cols, null_label)
    too_many = {c: n for c, n in state.sizes.items() if n > max_categories}
    if too_many:
        raise ValueError(f"too many categories for one column each: {too_many} (max {max_categories}); "
                         "use sparse_indices or sparse_vector")
    return state.small(max_categories)


# ------------------------------------------------------------------ codes and sparse output
def _coded(df: DataFrame, state: CategoryTable, names: dict[str, str], max_categories: int,
           max_broadcast_rows: int) -> DataFrame:
    """``df`` with the code (long, NULL if unseen) of each column ``c`` as ``names[c]``."""
    maps = state.small(max_categories)
    out = df
    for i, c in enumerate(state.sizes):
        if c in maps:
            code = F.lit(None).cast("long")
            if maps[c]:
                pairs = F.create_map(*[x for k, v in enumerate(maps[c]) for x in (F.lit(v), F.lit(k).cast("long"))])
                code = F.element_at(pairs, _labels(c, state.null_label))
            out = out.withColumn(names[c], code)
            continue
        part = state.table.df.where(F.col("column") == c).select(F.col("value").alias(f"__value{i}"), F.col("code").alias(names[c]))
        part = F.broadcast(part) if state.sizes[c] <= max_broadcast_rows else part
        out = out.join(part, _labels(c, state.null_label) == F.col(f"__value{i}"), "left").drop(f"__value{i}")
    return out


def sparse_indices(df: DataFrame, state: CategoryTable, out: str = "active", drop_first: bool = False,
                   max_categories: int = DEFAULT_MAX_CATEGORIES,
                   max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """C14/C16 without a limit: ``out`` lists the indices of the row's categories in one space of all columns.

    Column i's categories follow those of the columns before it; unseen values (and the
    first category with ``drop_first``) have no index.
    """
    names = {c: f"__code{i}" for i, c in enumerate(state.sizes)}
    coded = _coded(df, state, names, max_categories, max_broadcast_rows)
    indices, offset = [], 0
    for c, n in state.sizes.items():
        code = F.col(names[c]) - (1 if drop_first else 0)
        indices.append(F.when(code >= 0, code + F.lit(offset)))
        offset += max(0, n - (1 if drop_first else 0))
    active = F.filter(F.array(*indices), lambda x: x.isNotNull()) if indices else F.array().cast("array<bigint>")
    return coded.select(*map(q, df.columns), active.alias(out))


def sparse_vector(df: DataFrame, state: CategoryTable, out: str = "features", drop_first: bool = False,
                  max_categories: int = DEFAULT_MAX_CATEGORIES,
                  max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """The same as one sparse ML vector per row, ready for training; unseen values are zeros."""
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler
    names = {c: f"__code{i}" for i, c in enumerate(state.sizes)}
    coded = _coded(df, state, names, max_categories, max_broadcast_rows)
    kept, inputs = {}, []
    for c, n in state.sizes.items():
        size = n - (1 if drop_first else 0)
        if size < 1:
            continue
        code = F.col(names[c]) - (1 if drop_first else 0)
        # the size is known, so fitting the encoder reads no data; an index beyond it gives zeros
        sized = {"ml_attr": {"type": "nominal", "num_vals": size, "name": names[c]}}
        kept[names[c]] = F.when(code >= 0, code).otherwise(F.lit(size)).cast("double").alias(names[c], metadata=sized)
        inputs.append(names[c])
    coded = coded.select(*map(q, df.columns), *kept.values())
    encoder = OneHotEncoder(inputCols=inputs, outputCols=[f"{n}v" for n in inputs], handleInvalid="keep", dropLast=True)
    vectors = encoder.fit(coded).transform(coded)
    whole = VectorAssembler(inputCols=[f"{n}v" for n in inputs], outputCol=out).transform(vectors)
    return whole.select(*map(q, df.columns), q(out))


def onehot_fit(df: DataFrame, cols: Sequence[str], null_label: str | None = NULL_LABEL,
               drop_first: bool = False, max_categories: int = DEFAULT_MAX_CATEGORIES) -> OneHotState:
    """C14/C16/R5 fit: categories of the columns present."""
    cols = [c for c in cols if c in df.columns]
    return OneHotState(cols, fit_categories(df, cols, null_label, max_categories), null_label, drop_first)


def onehot_apply(df: DataFrame, state: OneHotState, drop_columns: Sequence[str] = (),
                 dtype: T.DataType = T.DoubleType()) -> DataFrame:
    """C14 apply: replace each encoded column by ``{col}_{value}`` 0/1 columns
    appended after the other columns; unseen values give all zeros."""
    new_cols = []
    for c in state.columns:
        lab = _labels(c, state.null_label)
        cats = state.categories[c][1:] if state.drop_first else state.categories[c]
        for v in cats:
            name = f"{c}_{v}"
            if name in drop_columns:
                continue
            new_cols.append(F.when(lab == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0)).cast(dtype).alias(name))
    rest = [q(c) for c in df.columns if c not in state.columns]
    return df.select(*rest, *new_cols)


def dummy_encode(train: DataFrame, test: DataFrame | None, cols: Sequence[str], key_col: str = "__part",
                 max_categories: int = DEFAULT_MAX_CATEGORIES) -> tuple[DataFrame, DataFrame | None, OneHotState]:
    """Dummies with the first category dropped, categories from train+test
    (union only for the fit), every output column cast to double."""
    both = train.select(*[q(c) for c in cols if c in train.columns])
    if test is not None:
        both = both.unionByName(test.select(*[q(c) for c in cols if c in test.columns]))
    state = onehot_fit(both, cols, null_label=None, drop_first=True, max_categories=max_categories)

    def enc(d: DataFrame) -> DataFrame:
        out = onehot_apply(d, state)
        num = [f.name for f in out.schema.fields
               if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
        return out.withColumns({c: q(c).cast(T.DoubleType()) for c in num})

    return enc(train), (enc(test) if test is not None else None), state


def passthrough_encode(df: DataFrame, drop: Sequence[str] = ("Group", "Surnames")) -> DataFrame:
    """Tree branch - only drops the group id and surnames."""
    return drop_existing(df, drop)


# ---------------------------------------------------------------------- C17
def ordinal_fit(df: DataFrame, cols: Sequence[str]) -> CategoryTable:
    """C17 fit: alphabetical codes per column (``OrdinalEncoder`` / ``StringIndexer(alphabetAsc)``)."""
    return fit_category_table(df, cols)


def ordinal_apply(df: DataFrame, state: CategoryTable, suffix: str = "", unknown: float | None = None,
                  max_categories: int = DEFAULT_MAX_CATEGORIES,
                  max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """C17 apply: code = position in the sorted train categories (double).

    Unseen or NULL values get ``unknown``; the default is the number of
    categories, like ``StringIndexer(handleInvalid="keep")``.
    """
    names = {c: f"__code{i}" for i, c in enumerate(state.sizes)}
    coded = _coded(df, state, names, max_categories, max_broadcast_rows)
    code = {f"{c}{suffix}": F.coalesce(F.col(names[c]).cast(T.DoubleType()), F.lit(float(n) if unknown is None else unknown))
            for c, n in state.sizes.items()}
    return coded.withColumns(code).drop(*names.values())


def ordinal_indexers(cols: Sequence[str], suffix: str = "_idx"):
    """C17 as Spark ML stages (for ML pipelines)."""
    from pyspark.ml.feature import StringIndexer
    return [StringIndexer(inputCol=c, outputCol=f"{c}{suffix}", stringOrderType="alphabetAsc",
                          handleInvalid="keep") for c in cols]


# ---------------------------------------------------------------------- C18
@dataclass
class ScalerState:
    means: dict[str, float | None]
    stds: dict[str, float | None]


def standard_fit(df: DataFrame, cols: Sequence[str]) -> ScalerState:
    """C18 fit: mean and population std per column, one aggregation (one row)."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return ScalerState({}, {})
    row = df.agg(*[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(q(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return ScalerState({c: row[f"m{i}"] for i, c in enumerate(cols)},
                       {c: row[f"s{i}"] for i, c in enumerate(cols)})


def standard_apply(df: DataFrame, state: ScalerState) -> DataFrame:
    """C18 apply: ``(x - mean) / std``; a constant column (std 0) becomes 0."""
    cols = {}
    for c, m in state.means.items():
        if c not in df.columns or m is None:
            continue
        s = state.stds[c] or 0.0
        centred = q(c).cast(T.DoubleType()) - F.lit(m)
        cols[c] = centred / F.lit(s) if s > 0 else centred
    return df.withColumns(cols) if cols else df
