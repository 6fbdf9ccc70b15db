"""Scalar column builders (F1-F10, P11, P12 of the survey).

Everything here returns a ``Column`` made of built-in Spark expressions, so it
stays inside whole-stage codegen; nothing runs Python per row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TWO_POW_52 = 4503599627370496.0


def q(name: str) -> Column:
    """Column by its exact name: dots, spaces and backticks are taken literally
    (one-hot outputs such as ``Destination_PSO J318.5-22`` contain dots)."""
    return F.col("`" + name.replace("`", "``") + "`")


def col_(c: str | Column) -> Column:
    return q(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- splitting
def split_parts(c: str | Column, sep: str, n: int | None = None) -> Column:
    """``split`` on a literal separator (escaped, Spark takes a regex).

    ``n`` caps the number of pieces (the last one keeps the rest), like a
    ``split(sep, n-1)`` in Python.
    """
    pattern = re.escape(sep)
    return F.split(col_(c), pattern, n if n else -1)


def split_part(c: str | Column, sep: str, index: int, n: int | None = None) -> Column:
    """Piece ``index`` of a split; NULL when the string is NULL or too short.

    ``F.get`` instead of ``getItem`` because the latter raises on short arrays
    under ANSI mode.
    """
    return F.get(split_parts(c, sep, n), index)


def split_into(c: str | Column, sep: str, names: Sequence[str], n: int | None = None) -> list[Column]:
    """Split one composite column into ``len(names)`` aliased columns."""
    arr = split_parts(c, sep, n)
    return [F.get(arr, i).alias(name) for i, name in enumerate(names)]


def to_double(c: str | Column) -> Column:
    """String -> double, NULL on bad input (plain ``cast`` raises under ANSI)."""
    return col_(c).try_cast(T.DoubleType())


# ------------------------------------------------------------------ binning
def bin_fixed(c: str | Column, start: float, width: float, count: int,
              first_label: float = 1.0) -> Column:
    """Left-closed fixed-width bins ``[start + k*width, start + (k+1)*width)``.

    Labelled ``first_label + k`` (double); values outside ``[start, start +
    count*width)`` and NULL map to NULL.
    """
    x = col_(c).cast(T.DoubleType())
    hi = start + width * count
    return F.when((x >= F.lit(start)) & (x < F.lit(hi)),
                  F.floor((x - F.lit(start)) / F.lit(width)).cast(T.DoubleType()) + F.lit(first_label)) \
        .otherwise(F.lit(None).cast(T.DoubleType()))


# --------------------------------------------------------------- arithmetic
def row_sum(cols: Iterable[str | Column]) -> Column:
    """Row-wise sum skipping NULLs; all-NULL rows give 0.0 (pandas ``sum(axis=1)``)."""
    terms = [F.coalesce(col_(c).cast(T.DoubleType()), F.lit(0.0)) for c in cols]
    if not terms:
        return F.lit(0.0)
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 int, NULL comparisons count as 0 (as in pandas)."""
    return F.coalesce(cond, F.lit(False)).cast(T.IntegerType())


def safe_ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """``num / den``; ``default`` when the denominator is 0 or NULL."""
    r = F.try_divide(num.cast(T.DoubleType()), den.cast(T.DoubleType()))
    return r if default is None else F.coalesce(r, F.lit(default))


def pct(num: Column, den: Column, digits: int = 2) -> Column:
    """Percentage rounded for reports."""
    return F.round(safe_ratio(num * F.lit(100.0), den), digits)


# ---------------------------------------------------------------- booleans
def normalise_bool(df: DataFrame, c: str) -> Column:
    """Map boolean-like values to the strings ``'True'``/``'False'``.

    Booleans and 0/1 numbers are mapped; strings ``'0.0'``/``'1.0'`` too; any
    other non-null value is kept as its string form; NULL stays NULL.
    """
    dtype = df.schema[c].dataType
    x = q(c)
    if isinstance(dtype, T.BooleanType):
        return F.when(x, F.lit("True")).when(~x, F.lit("False")).alias(c)
    if isinstance(dtype, T.NumericType):
        return (F.when(x == 0, F.lit("False")).when(x == 1, F.lit("True"))
                .otherwise(x.cast(T.StringType())).alias(c))
    s = x.cast(T.StringType())
    return (F.when(s == "0.0", F.lit("False")).when(s == "1.0", F.lit("True"))
            .otherwise(s).alias(c))


def coerce_prediction(df: DataFrame, c: str) -> Column:
    """Predictions to boolean: strings equal to 'true' in any case are true."""
    dtype = df.schema[c].dataType
    x = q(c)
    if isinstance(dtype, T.StringType):
        return F.coalesce(F.lower(x) == F.lit("true"), F.lit(False))
    return x.cast(T.BooleanType())


# --------------------------------------------------------- portable uniform
def hash_uniform(keys: Sequence[str | Column], seed: int | str) -> Column:
    """Deterministic uniform in ``[0, 1)`` from the row key and a seed.

    ``md5(key1|...|seed)``, first 52 bits as an unsigned integer, over 2^52.
    It depends only on the key, never on row order or partitioning, so a
    lost executor recomputes the same draw, and DuckDB computes the same
    value with ``('0x' || substr(md5(...), 1, 13))::BIGINT / 2^52``.
    """
    parts = [col_(k).cast(T.StringType()) for k in keys] + [F.lit(str(seed))]
    h = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return F.conv(h, 16, 10).cast(T.DoubleType()) / F.lit(TWO_POW_52)


def hash_uniform_sql(keys: Sequence[str], seed: int | str) -> str:
    """The DuckDB / ANSI text of :func:`hash_uniform` (for oracles)."""
    inner = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return (f"(CAST(CAST(('0x' || substr(md5({inner} || '|' || '{seed}'), 1, 13)) AS BIGINT) AS DOUBLE)"
            f" / CAST(4503599627370496 AS DOUBLE))")
