"""Projections, column housekeeping, unions and orderings.

All of these are plan-time decisions on ``df.columns`` / ``df.schema`` plus
lazy DataFrame calls; none launches a job.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import q


def drop_existing(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop columns, ignoring those that are absent."""
    present = [c for c in cols if c in df.columns]
    return df.drop(*present) if present else df


def reorder(df: DataFrame, first: Sequence[str] = (), last: Sequence[str] = ()) -> DataFrame:
    """Put ``first`` columns in front and ``last`` at the end (those present)."""
    start = [c for c in first if c in df.columns]
    end = [c for c in last if c in df.columns and c not in start]
    middle = [c for c in df.columns if c not in start and c not in end]
    return df.select(*[q(c) for c in start + middle + end])


def require_columns(df: DataFrame, cols: Iterable[str], what: str = "operator") -> None:
    """Raise ``ValueError`` listing required columns that are missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")


def present(df: DataFrame, cols: Iterable[str]) -> list[str]:
    """The subset of ``cols`` that exists, in the given order."""
    return [c for c in cols if c in df.columns]


_KINDS = {
    "string": (T.StringType,),
    "boolean": (T.BooleanType,),
    "number": (T.NumericType,),
}


def columns_of_kind(df: DataFrame, kind: str, exclude: Iterable[str] = ()) -> list[str]:
    """Names of the columns whose type is ``string`` / ``boolean`` / ``number``."""
    types = _KINDS[kind]
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, types) and f.name not in skip]


def drop_null_rows(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """P5: drop rows with a NULL in any of ``subset``."""
    return df.dropna(subset=list(subset))


def align_columns(df: DataFrame, reference_cols: Sequence[str], fill: float = 0.0) -> DataFrame:
    """P10: give ``df`` exactly ``reference_cols`` in that order.

    Columns missing in ``df`` are filled with ``fill`` (double); extra
    columns are dropped.
    """
    return df.select(*[q(c) if c in df.columns else F.lit(fill).cast(T.DoubleType()).alias(c)
                       for c in reference_cols])


def union_splits(parts: dict[str, DataFrame], split_col: str = "split") -> DataFrame:
    """Vertical union by name of labelled parts, missing columns as NULL.

    The label goes into ``split_col`` so that the union can be re-split later
    with a filter instead of by position.
    """
    out = None
    for label, part in parts.items():
        tagged = part.withColumn(split_col, F.lit(label))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing to union")
    return out


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """O1/O3: the first ``k`` rows by ``order`` (Spark plans TakeOrderedAndProject:
    a per-partition top-k, then one merge of k rows per partition)."""
    return df.orderBy(*order).limit(k)


def argmax(df: DataFrame, value: str, tiebreak: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per ``keys`` (or overall) the row with the largest ``value``; ties go to
    the smallest ``tiebreak`` (first-seen wins in the reference).

    One aggregation with map-side partial results: the smallest pair of (negated
    value, tiebreak), rows without a value last.  NULL tiebreaks come last too.
    """
    if not isinstance(df.schema[value].dataType, T.NumericType):
        raise ValueError(f"{value!r} is not a number")
    others = [c for c in df.columns if c not in keys]
    order_key = F.struct(q(value).isNull().alias("no_value"), (-q(value)).alias("less"),
                         q(tiebreak).isNull().alias("no_tiebreak"), q(tiebreak).alias("tiebreak"))
    packed = F.struct(*[q(c) for c in others])
    agg = F.min_by(packed, order_key).alias("__best")
    grouped = df.groupBy(*[q(k) for k in keys]).agg(agg) if keys else df.agg(agg)
    return grouped.select(*[q(k) for k in keys], "__best.*")
