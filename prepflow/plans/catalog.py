"""Queries over the driver tables, one per operator family of the survey.

Each query runs the library operators on whole tables; the SQL next to it is
the DuckDB oracle used by the correctness gate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import BinSpec, CompositeConfig, SplitSpec, split_composite
from .registry import register
from .tables import load

# ------------------------------------------------------------------ C1 / F1-F5 / W1
SPLIT_COMPOSITE_SQL = """
WITH b AS (
  SELECT o_orderkey, o_totalprice,
         string_split(o_orderpriority, '-')[1] AS prio_group,
         TRY_CAST(string_split(o_orderpriority, '-')[1] AS DOUBLE) AS prio_code,
         CASE WHEN strpos(o_orderpriority, '-') = 0 THEN NULL
              ELSE substr(o_orderpriority, strpos(o_orderpriority, '-') + 1) END AS prio_name,
         string_split(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '-')[1] AS yr,
         TRY_CAST(string_split(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '-')[2] AS DOUBLE) AS mon,
         string_split(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '-')[3] AS dy,
         CASE WHEN o_totalprice >= 0 AND o_totalprice < 500000
              THEN CAST(floor(o_totalprice / 50000.0) AS DOUBLE) + 1.0 END AS price_zone
  FROM orders)
SELECT prio_group,
       CASE WHEN prio_group IS NULL THEN NULL
            ELSE count(prio_group) OVER (PARTITION BY prio_group) END AS group_size,
       o_orderkey, o_totalprice, prio_code, prio_name, yr, mon, dy, price_zone
FROM b
"""


@register("split_composite", "C1 F1 F2 F3 F4 F5 W1 A8 P1 P2 P9 S3", SPLIT_COMPOSITE_SQL)
def q_split_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = (load(spark, sf_dir, "orders")
         .select("o_orderkey", "o_orderpriority", "o_totalprice",
                 F.col("o_orderdate").cast("date").cast("string").alias("order_day")))
    cfg = CompositeConfig(
        id_col="o_orderpriority", id_sep="-", group_col="prio_group", size_col="group_size",
        splits=(SplitSpec("o_orderpriority", "-", ("prio_code", "prio_name"), max_parts=2,
                          doubles=("prio_code",)),
                SplitSpec("order_day", "-", ("yr", "mon", "dy"), doubles=("mon",))),
        bins=(BinSpec("o_totalprice", "price_zone", 0.0, 50000.0, 10),),
        drop_train=("o_orderpriority", "order_day"), drop_test=(),
        first=("prio_group", "group_size"), last=())
    return split_composite(o, is_train=True, config=cfg)


# ------------------------------------------------------------------ C2-C6 / P4 / P6 / F8
from ..operators.rules import Rule, apply_rules, fill_constant  # noqa: E402
from .tables import orders_with_nulls, orders_with_nulls_sql  # noqa: E402

# Rule set on the orders view, same shape as the passenger rules: NULL-only
# updates in order, later rules seeing earlier results.
ORDER_RULES = (
    Rule("o_orderstatus", "F", "order_month IN (1, 2)"),
    Rule("o_orderstatus", "O", "c_mktsegment = 'BUILDING'"),
    Rule("o_orderpriority", "5-LOW", "o_totalprice < 100000"),
    Rule("o_orderpriority", "3-MEDIUM", "o_orderstatus = 'P'"),
    Rule("c_mktsegment", "AUTOMOBILE", "n_regionkey IN (0, 1)"),
    Rule("o_totalprice", 0.0, "order_month = 12"),
)

ORDERS_VIEW_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice",
                       "c_mktsegment", "c_nationkey", "n_regionkey", "order_month")

RULE_CASCADE_SQL = f"""
WITH v AS ({orders_with_nulls_sql()}),
r1 AS (SELECT * REPLACE (COALESCE(o_orderstatus,
          CASE WHEN order_month IN (1, 2) THEN 'F' WHEN c_mktsegment = 'BUILDING' THEN 'O' END) AS o_orderstatus)
       FROM v),
r2 AS (SELECT * REPLACE (COALESCE(o_orderpriority,
          CASE WHEN o_totalprice < 100000 THEN '5-LOW' WHEN o_orderstatus = 'P' THEN '3-MEDIUM' END)
          AS o_orderpriority) FROM r1),
r3 AS (SELECT * REPLACE (
          COALESCE(c_mktsegment, CASE WHEN n_regionkey IN (0, 1) THEN 'AUTOMOBILE' END) AS c_mktsegment,
          COALESCE(o_totalprice, CASE WHEN order_month = 12 THEN 0.0 END, 0.0) AS o_totalprice) FROM r2)
SELECT * FROM r3
"""


@register("rule_cascade", "C2 C3 C4 C5 C6 P4 P6 P9 F8", RULE_CASCADE_SQL)
def q_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = orders_with_nulls(spark, sf_dir)
    return fill_constant(apply_rules(v, ORDER_RULES), ["o_totalprice"], 0.0)


# ------------------------------------------------------------------ A1-A3 / Q1-Q5
from ..operators import profile as prof  # noqa: E402

_V = f"v AS ({orders_with_nulls_sql()})"
_PCOLS = ORDERS_VIEW_COLUMNS
_N = "(SELECT count(*) FROM v)"


def _pct_sql(num: str, den: str) -> str:
    return f"round(100.0 * ({num}) / ({den}), 2)"


NULL_PROFILE_SQL = f"WITH {_V} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column, count_if({c} IS NULL) AS n_missing, "
    f"{_pct_sql(f'count_if({c} IS NULL)', 'count(*)')} AS pct_missing, "
    f"count(*) - count_if({c} IS NULL) AS n_non_missing FROM v" for c in _PCOLS)


@register("null_profile", "A1 Q1 F10", NULL_PROFILE_SQL)
def q_null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.null_counts(orders_with_nulls(spark, sf_dir))


_NULLSUM = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in _PCOLS)
NULL_ROWS_SQL = f"""WITH {_V}
SELECT {_NULLSUM} AS n_missing, count(*) AS n_rows, {_pct_sql('count(*)', _N)} AS pct_rows
FROM v GROUP BY 1"""


@register("null_rows", "Q2", NULL_ROWS_SQL)
def q_null_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.missing_per_row(orders_with_nulls(spark, sf_dir))


_COMBO = "concat_ws(' | ', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in _PCOLS) + ")"
NULL_COMBOS_SQL = f"""WITH {_V}
SELECT CASE WHEN {_COMBO} = '' THEN '{prof.NO_MISSING_LABEL}' ELSE {_COMBO} END AS missing_columns,
       count(*) AS n_rows, {_pct_sql('count(*)', _N)} AS pct_rows
FROM v GROUP BY 1"""


@register("null_combos", "Q3", NULL_COMBOS_SQL)
def q_null_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.missing_combinations(orders_with_nulls(spark, sf_dir))


NULL_PAIRS_SQL = f"WITH {_V} " + " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, "
    f"COALESCE(bool_or({a} IS NULL AND {b} IS NULL), false) AS both_missing FROM v"
    for a in _PCOLS for b in _PCOLS)


@register("null_pairs", "Q4", NULL_PAIRS_SQL)
def q_null_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.co_missing(orders_with_nulls(spark, sf_dir))


_SPARK_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
                "o_orderpriority": "string", "o_totalprice": "double", "c_mktsegment": "string",
                "c_nationkey": "int", "n_regionkey": "int", "order_month": "int"}
COLUMN_OVERVIEW_SQL = f"WITH {_V} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, '{_SPARK_TYPES[c]}' AS dtype, count(*) AS total_rows, "
    f"count_if({c} IS NULL) AS missing_count, "
    f"{_pct_sql(f'count_if({c} IS NULL)', 'count(*)')} AS missing_percentage, "
    f"count(DISTINCT {c}) AS unique_non_null_values FROM v" for c in _PCOLS)


@register("column_overview", "Q5 A3", COLUMN_OVERVIEW_SQL)
def q_column_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.column_overview(orders_with_nulls(spark, sf_dir))


DISTINCT_MERGE_SQL = f"WITH {_V} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS n_rows, count_if({c} IS NULL) AS n_missing, "
    f"count(DISTINCT {c}) AS n_distinct, true AS within_bound FROM v" for c in _PCOLS)


@register("distinct_merge", "A2 Q5", DISTINCT_MERGE_SQL)
def q_distinct_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of the table's parts, merged; whether each estimate keeps its error bound against the exact count."""
    v = orders_with_nulls(spark, sf_dir)
    merged = prof.merged_sketches(prof.distinct_sketches(v, F.pmod("o_orderkey", F.lit(7))))
    exact = prof.column_overview(v).select(F.col("feature").alias("column"), "unique_non_null_values")
    error = F.abs(F.col("n_distinct") - F.col("unique_non_null_values"))
    return merged.join(exact, "column").select(
        F.col("column").alias("feature"), "n_rows", "n_missing", F.col("unique_non_null_values").alias("n_distinct"),
        (error <= F.lit(prof.sketch_error()) * F.col("unique_non_null_values")).alias("within_bound"))


_TEXT = ("o_orderstatus", "o_orderpriority", "c_mktsegment")
DISTINCT_PREVIEW_SQL = f"WITH {_V}, long AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM v WHERE {c} IS NOT NULL"
    for c in _TEXT) + """),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY value) AS rn FROM long)
SELECT "column", count(*) AS n_distinct,
       string_agg(CASE WHEN rn <= 20 THEN value END, ', ' ORDER BY value) AS preview
FROM ranked GROUP BY 1"""


@register("distinct_preview", "A2 P8", DISTINCT_PREVIEW_SQL)
def q_distinct_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.distinct_preview(orders_with_nulls(spark, sf_dir))


TABLE_SHAPE_SQL = f"""WITH {_V}
SELECT count(*) AS n_rows, CAST(9 AS BIGINT) AS n_columns, 'bigint, double, int, string' AS dtypes FROM v"""


@register("table_shape", "A3", TABLE_SHAPE_SQL)
def q_table_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.shape(orders_with_nulls(spark, sf_dir))


# ------------------------------------------------------------------ further families
from . import q_impute  # noqa: E402,F401
from . import q_analysis  # noqa: E402,F401
from . import q_eval  # noqa: E402,F401
from . import q_models  # noqa: E402,F401
from . import q_io  # noqa: E402,F401
from . import q_reshape  # noqa: E402,F401
