"""Pairwise-complete Pearson correlations.

All coefficients of a frame come from one scan: the second moments of every pair of
columns over the rows where both are present (``gram.py``).  A pair whose rows have
a constant column has no coefficient (NULL, where pandas gives NaN); a deviation
below ``CONSTANT`` times the mean counts as constant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import q
from .encode import onehot_apply, onehot_fit
from .gram import pair_moments
from .reshape import columns_of_kind

BANDS = ((0.15, "strong"), (0.05, "medium"))  # fixed thresholds of the target-correlation chart


CONSTANT = 1e-12


def correlations(df: DataFrame, left: Sequence[str], right: Sequence[str] | None = None) -> DataFrame:
    """``(column_a, column_b, corr)`` of each left column with each right one (by default the left ones again)."""
    m = pair_moments(df, left, right)

    def spread(total: str, mean: str) -> Column:
        deviation = F.sqrt(F.try_divide(F.col(total), F.col("n").cast(T.DoubleType())))
        return F.when(deviation > F.abs(F.col(mean)) * F.lit(CONSTANT), deviation)

    covariance = F.try_divide(F.col("sum_ab"), F.col("n").cast(T.DoubleType()))
    corr = F.try_divide(covariance, spread("sum_aa", "mean_a") * spread("sum_bb", "mean_b"))
    return m.select("column_a", "column_b", F.when(corr.isNotNull() & ~F.isnan(corr), F.greatest(F.least(corr, F.lit(1.0)), F.lit(-1.0))).alias("corr"))


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Symmetric matrix in long form, diagonal 1 (NULL for a constant column)."""
    return correlations(df, list(cols) if cols else columns_of_kind(df, "number"))


def encode_for_correlation(df: DataFrame, text_cols: Sequence[str] | None = None,
                           bool_cols: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Booleans to 0/1, text one-hot encoded (no category dropped, NULL gets
    no column), then every numeric column."""
    text_cols = list(text_cols) if text_cols is not None else columns_of_kind(df, "string")
    bool_cols = list(bool_cols) if bool_cols is not None else columns_of_kind(df, "boolean")
    out = df.withColumns({c: q(c).cast(T.IntegerType()) for c in bool_cols}) if bool_cols else df
    if text_cols:
        out = onehot_apply(out, onehot_fit(out, text_cols, null_label=None), dtype=T.IntegerType())
    return out, columns_of_kind(out, "number")


def target_correlation(df: DataFrame, target: str, cols: Sequence[str] | None = None,
                       top: int | None = 15) -> DataFrame:
    """``|corr(feature, target)|`` for every other numeric column, sorted
    descending, banded; ``top`` keeps the first rows (the report's top 15)."""
    cols = [c for c in (cols or columns_of_kind(df, "number")) if c != target]
    pairs = correlations(df, cols, [target])
    a = F.abs(F.col("corr"))
    band = F.when(a >= BANDS[0][0], BANDS[0][1]).when(a >= BANDS[1][0], BANDS[1][1]).otherwise("weak")
    out = pairs.select(F.col("column_a").alias("feature"), a.alias("abs_corr"), band.alias("band"))
    out = out.orderBy(F.desc_nulls_last("abs_corr"), "feature")
    return out.limit(top) if top else out
