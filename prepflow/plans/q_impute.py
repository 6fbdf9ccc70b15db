"""Queries of the fit/apply imputation family (A4-A7, C7-C12) and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alias
from ..operators import impute as imp
from ..operators import split as sp
from ..operators.rules import Rule
from ..operators.state import freeze
from . import sqlgen
from .registry import register
from .tables import load, orders_with_nulls, orders_with_nulls_sql

V = f"v AS ({orders_with_nulls_sql()})"
FEATURES = ("o_orderstatus", "o_orderpriority", "c_mktsegment")
ALIAS_FEATURES = (*FEATURES, "order_month", "o_custkey")  # the last has many categories


# ---------------------------------------------------------------------- A4
@register("frequency_dictionary", "A4",
          f"WITH {V} SELECT * FROM {sqlgen.frequency_dictionary('v', FEATURES)}")
def q_frequency_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imp.frequency_dictionary(orders_with_nulls(spark, sf_dir), FEATURES)


# ---------------------------------------------------------------------- C8 / A5 / W2
_MODE_COLS = ("o_orderstatus", "o_orderpriority", "order_month")
GROUP_MODE_FILL_SQL = f"""WITH {V}
SELECT v.o_orderkey, v.o_custkey,
       COALESCE(v.o_orderstatus, m1.m1) AS o_orderstatus,
       COALESCE(v.o_orderpriority, m2.m2) AS o_orderpriority,
       COALESCE(v.order_month, m3.m3) AS order_month
FROM v
LEFT JOIN {sqlgen.group_mode('v', ['o_custkey'], 'o_orderstatus', 'm1')} m1 ON v.o_custkey = m1.o_custkey
LEFT JOIN {sqlgen.group_mode('v', ['o_custkey'], 'o_orderpriority', 'm2')} m2 ON v.o_custkey = m2.o_custkey
LEFT JOIN {sqlgen.group_mode('v', ['o_custkey'], 'order_month', 'm3')} m3 ON v.o_custkey = m3.o_custkey
"""


@register("group_mode_fill", "C8 A5 W2 J1", GROUP_MODE_FILL_SQL)
def q_group_mode_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = orders_with_nulls(spark, sf_dir).select("o_orderkey", "o_custkey", *_MODE_COLS)
    return imp.group_mode_fill(v, "o_custkey", _MODE_COLS)


# ---------------------------------------------------------------------- W3 / A7
GROUP_MEDIAN_FILL_SQL = f"""WITH {V}
SELECT v.o_orderkey, v.o_custkey, round(COALESCE(v.o_totalprice, g.gmed), 6) AS o_totalprice
FROM v LEFT JOIN (SELECT o_custkey, median(o_totalprice) AS gmed FROM v
                  WHERE o_custkey IS NOT NULL GROUP BY o_custkey) g ON v.o_custkey = g.o_custkey
"""


@register("group_median_fill", "W3 A7 C10", GROUP_MEDIAN_FILL_SQL)
def q_group_median_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = orders_with_nulls(spark, sf_dir).select("o_orderkey", "o_custkey", "o_totalprice")
    out = imp.group_median_fill(v, "o_custkey", "o_totalprice")
    return out.withColumn("o_totalprice", F.round("o_totalprice", 6))


MEDIANS_BY_KEY_SQL = f"""WITH {V}, m AS (
  SELECT 'c_mktsegment' AS key_name, CAST(c_mktsegment AS VARCHAR) AS key_value, median(o_totalprice) AS median
  FROM v WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment
  UNION ALL
  SELECT 'n_regionkey', CAST(n_regionkey AS VARCHAR), median(o_totalprice)
  FROM v WHERE n_regionkey IS NOT NULL GROUP BY n_regionkey
  UNION ALL
  SELECT '*', NULL, median(o_totalprice) FROM v)
SELECT key_name, key_value, round(median, 6) AS median FROM m WHERE median IS NOT NULL
"""


@register("medians_by_key", "A7 A6", MEDIANS_BY_KEY_SQL)
def q_medians_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = imp.medians_by_key(orders_with_nulls(spark, sf_dir), "o_totalprice", ["c_mktsegment", "n_regionkey"])
    return m.withColumn("median", F.round("median", 6))


GLOBAL_MODE_SQL = f"""WITH {V}
SELECT (SELECT o_orderpriority FROM v WHERE o_orderpriority IS NOT NULL GROUP BY 1
        ORDER BY count(*) DESC, 1 ASC LIMIT 1) AS o_orderpriority,
       (SELECT order_month FROM v WHERE order_month IS NOT NULL GROUP BY 1
        ORDER BY count(*) DESC, 1 ASC LIMIT 1) AS order_month
"""


@register("global_mode", "A6", GLOBAL_MODE_SQL)
def q_global_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = orders_with_nulls(spark, sf_dir)
    return imp.global_mode(v, "o_orderpriority", "order_month")


# ---------------------------------------------------------------------- C9 / J5
SAMPLE_FILL_SQL = f"""WITH {V}, d AS {sqlgen.frequency_dictionary('v', FEATURES)}
SELECT o_orderkey,
       COALESCE(o_orderstatus, s1) AS o_orderstatus,
       COALESCE(c_mktsegment, s2) AS c_mktsegment
FROM (SELECT v.*,
        {sqlgen.sample_pick('d', 'o_orderstatus', sqlgen.u('v.o_orderkey', imp.fill_seed(42)), 's1')},
        {sqlgen.sample_pick('d', 'c_mktsegment', sqlgen.u('v.o_orderkey', imp.fill_seed(43)), 's2')}
      FROM v)
"""


@register("sample_fill", "C9 J5 A4", SAMPLE_FILL_SQL)
def q_sample_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = orders_with_nulls(spark, sf_dir)
    d = freeze(imp.frequency_dictionary(v, FEATURES))
    out = imp.sample_fill(v, "o_orderstatus", d, ["o_orderkey"], 42)
    out = imp.sample_fill(out, "c_mktsegment", d, ["o_orderkey"], 43)
    return out.select("o_orderkey", "o_orderstatus", "c_mktsegment")


ALIAS_TABLES_SQL = f"""WITH {V}, d AS {sqlgen.frequency_dictionary('v', ALIAS_FEATURES)},
{sqlgen.alias_tables('a', 'd')}
SELECT * FROM a
"""


@register("alias_tables", "C9 J5 A4", ALIAS_TABLES_SQL)
def q_alias_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alias.alias_tables(imp.frequency_dictionary(orders_with_nulls(spark, sf_dir), ALIAS_FEATURES))


ALIAS_FILL_SQL = f"""WITH {V}, d AS {sqlgen.frequency_dictionary('v', FEATURES)},
{sqlgen.alias_tables('a', 'd')}
SELECT o_orderkey, COALESCE(o_orderstatus, s0) AS o_orderstatus, COALESCE(o_orderpriority, s1) AS o_orderpriority,
       COALESCE(c_mktsegment, s2) AS c_mktsegment
FROM (SELECT v.*, {", ".join(sqlgen.alias_pick('a', f, sqlgen.u('v.o_orderkey', imp.fill_seed(42 + i)), f's{i}')
                             for i, f in enumerate(FEATURES))}
      FROM v)
"""


@register("alias_fill", "C9 J5 A4", ALIAS_FILL_SQL)
def q_alias_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = orders_with_nulls(spark, sf_dir).select("o_orderkey", *FEATURES)
    state = alias.fit_alias(imp.frequency_dictionary(v, FEATURES))
    return alias.alias_fill(v, {f: 42 + i for i, f in enumerate(FEATURES)}, state, ["o_orderkey"])


# ---------------------------------------------------------------------- C10 cascade
CASCADE_SQL = f"""WITH {V},
g AS (SELECT o_custkey, median(o_totalprice) AS gmed FROM v WHERE o_custkey IS NOT NULL GROUP BY o_custkey),
m1 AS (SELECT c_mktsegment AS k, median(o_totalprice) AS m FROM v WHERE c_mktsegment IS NOT NULL GROUP BY 1),
m2 AS (SELECT n_regionkey AS k, median(o_totalprice) AS m FROM v WHERE n_regionkey IS NOT NULL GROUP BY 1)
SELECT v.o_orderkey,
       round(COALESCE(v.o_totalprice, g.gmed, m1.m, m2.m, (SELECT median(o_totalprice) FROM v)), 6) AS o_totalprice
FROM v LEFT JOIN g ON v.o_custkey = g.o_custkey
       LEFT JOIN m1 ON v.c_mktsegment = m1.k
       LEFT JOIN m2 ON v.n_regionkey = m2.k
"""


@register("cascade_median_fill", "C10 A7 W3 J1", CASCADE_SQL)
def q_cascade_median_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = orders_with_nulls(spark, sf_dir).select("o_orderkey", "o_custkey", "o_totalprice",
                                                 "c_mktsegment", "n_regionkey")
    keys = ["c_mktsegment", "n_regionkey"]
    medians = freeze(imp.medians_by_key(v, "o_totalprice", keys))
    out = imp.group_median_fill(v, "o_custkey", "o_totalprice")
    out = imp.lookup_medians(out, "o_totalprice", medians, keys)
    return out.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))


# ---------------------------------------------------------------------- C12 fit/apply
ORDER_PRE_RULES = (
    Rule("o_orderstatus", "F", "order_month IN (1, 2)"),
    Rule("o_orderstatus", "O", "c_mktsegment = 'BUILDING'"),
    Rule("o_orderpriority", "5-LOW", "o_totalprice < 100000"),
    Rule("o_orderpriority", "3-MEDIUM", "o_orderstatus = 'P'"),
)
ORDER_POST_RULES = (Rule("c_mktsegment", "AUTOMOBILE", "n_regionkey IN (0, 1)"),)
ORDER_SAMPLE = ("o_orderstatus", "c_mktsegment", "o_orderpriority")

ORDERS_IMPUTE = imp.ImputeConfig(
    row_key=("o_orderkey",), group_col="o_custkey", id_col=None, bool_cols=(),
    pre_rules=lambda df: list(ORDER_PRE_RULES), zero_fill=(),
    cascade_target="o_totalprice", cascade_keys=("c_mktsegment", "n_regionkey"),
    post_rules=lambda df: list(ORDER_POST_RULES),
    zone_col="order_month", zone_model=None,
    sample_features=ORDER_SAMPLE, no_group_mode=("c_mktsegment",), seed=42)

_U_SPLIT = sqlgen.u("o_orderkey", sp.split_seed(42))
IMPUTE_FIT_APPLY_SQL = f"""WITH {V},
p1 AS (SELECT * REPLACE (COALESCE(o_orderstatus,
          CASE WHEN order_month IN (1, 2) THEN 'F' WHEN c_mktsegment = 'BUILDING' THEN 'O' END) AS o_orderstatus)
       FROM v),
p2 AS (SELECT * REPLACE (COALESCE(o_orderpriority,
          CASE WHEN o_totalprice < 100000 THEN '5-LOW' WHEN o_orderstatus = 'P' THEN '3-MEDIUM' END)
          AS o_orderpriority) FROM p1),
p3 AS (SELECT * REPLACE (COALESCE(c_mktsegment, CASE WHEN n_regionkey IN (0, 1) THEN 'AUTOMOBILE' END)
          AS c_mktsegment),
          c_mktsegment AS pre_seg, n_regionkey AS pre_reg,
          CASE WHEN {_U_SPLIT} < 0.2 THEN 'test' ELSE 'train' END AS split
       FROM p2),
tr AS (SELECT * FROM p3 WHERE split = 'train'),
med AS (SELECT 'c_mktsegment' AS key_name, CAST(pre_seg AS VARCHAR) AS key_value, median(o_totalprice) AS median
        FROM tr WHERE pre_seg IS NOT NULL GROUP BY pre_seg
        UNION ALL
        SELECT 'n_regionkey', CAST(pre_reg AS VARCHAR), median(o_totalprice)
        FROM tr WHERE pre_reg IS NOT NULL GROUP BY pre_reg),
gmed AS (SELECT median(o_totalprice) AS m FROM tr),
d AS {sqlgen.frequency_dictionary('tr', ORDER_SAMPLE)},
{sqlgen.alias_tables('al', 'd')},
gs AS (SELECT split, o_custkey, median(o_totalprice) AS gmed FROM p3
       WHERE o_custkey IS NOT NULL GROUP BY split, o_custkey),
a AS (SELECT p3.*, gs.gmed, mm.mode_month, ms.mode_status, mp.mode_prio
      FROM p3
      LEFT JOIN gs ON p3.split = gs.split AND p3.o_custkey = gs.o_custkey
      LEFT JOIN {sqlgen.group_mode('p3', ['split', 'o_custkey'], 'order_month', 'mode_month')} mm
             ON p3.split = mm.split AND p3.o_custkey = mm.o_custkey
      LEFT JOIN {sqlgen.group_mode('p3', ['split', 'o_custkey'], 'o_orderstatus', 'mode_status')} ms
             ON p3.split = ms.split AND p3.o_custkey = ms.o_custkey
      LEFT JOIN {sqlgen.group_mode('p3', ['split', 'o_custkey'], 'o_orderpriority', 'mode_prio')} mp
             ON p3.split = mp.split AND p3.o_custkey = mp.o_custkey),
zm AS (SELECT COALESCE(order_month, mode_month) AS m FROM a
       WHERE split = 'train' AND COALESCE(order_month, mode_month) IS NOT NULL
       GROUP BY 1 ORDER BY count(*) DESC, 1 ASC LIMIT 1),
b AS (SELECT a.split, a.o_orderkey, a.o_custkey, a.c_nationkey, a.n_regionkey,
             COALESCE(a.o_totalprice, a.gmed, m1.median, m2.median, (SELECT m FROM gmed)) AS o_totalprice,
             COALESCE(a.order_month, a.mode_month, (SELECT m FROM zm)) AS order_month,
             COALESCE(a.o_orderstatus, a.mode_status) AS o_orderstatus,
             a.c_mktsegment,
             COALESCE(a.o_orderpriority, a.mode_prio) AS o_orderpriority
      FROM a
      LEFT JOIN med m1 ON m1.key_name = 'c_mktsegment' AND m1.key_value = CAST(a.pre_seg AS VARCHAR)
                       AND m1.median IS NOT NULL
      LEFT JOIN med m2 ON m2.key_name = 'n_regionkey' AND m2.key_value = CAST(a.pre_reg AS VARCHAR)
                       AND m2.median IS NOT NULL),
c AS (SELECT b.*,
        {sqlgen.alias_pick('al', 'o_orderstatus', sqlgen.u('b.o_orderkey', imp.fill_seed(42)), 's1')},
        {sqlgen.alias_pick('al', 'c_mktsegment', sqlgen.u('b.o_orderkey', imp.fill_seed(43)), 's2')},
        {sqlgen.alias_pick('al', 'o_orderpriority', sqlgen.u('b.o_orderkey', imp.fill_seed(44)), 's3')}
      FROM b)
SELECT split, o_orderkey, o_custkey,
       COALESCE(o_orderstatus, s1) AS o_orderstatus,
       COALESCE(o_orderpriority, s3) AS o_orderpriority,
       round(o_totalprice, 6) AS o_totalprice,
       COALESCE(c_mktsegment, s2) AS c_mktsegment,
       c_nationkey, n_regionkey, order_month
FROM c
"""


def orders_impute_fit_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = sp.holdout_split(orders_with_nulls(spark, sf_dir), "o_orderkey", 0.2, seed=42)
    train = v.where(F.col("split") == sp.TRAIN)
    test = v.where(F.col("split") == sp.TEST)
    tr, te, _ = imp.fit_apply(train, test, ORDERS_IMPUTE)
    out = tr.unionByName(te)
    return out.select("split", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
                      F.round("o_totalprice", 6).alias("o_totalprice"), "c_mktsegment",
                      "c_nationkey", "n_regionkey", "order_month")


register("impute_fit_apply", "C12 C7 C8 C9 C10 C6 X1 A4 A5 A6 A7 J1 J5 W2 W3",
         IMPUTE_FIT_APPLY_SQL)(orders_impute_fit_apply)


# ---------------------------------------------------------------------- X1-X3
@register("holdout_split", "X1",
          f"SELECT o_orderkey, CASE WHEN {_U_SPLIT} < 0.2 THEN 'test' ELSE 'train' END AS split FROM orders")
def q_holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderkey")
    return sp.holdout_split(o, "o_orderkey", 0.2, seed=42)


@register("kfold_split", "X2",
          f"SELECT o_orderkey, CAST(least(floor({_U_SPLIT} * 5), 4) AS INTEGER) AS fold FROM orders")
def q_kfold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderkey")
    return sp.kfold(o, "o_orderkey", 5, seed=42)


EXACT_SPLIT_SQL = f"""WITH r AS (
  SELECT o_orderkey, row_number() OVER (ORDER BY {_U_SPLIT}, o_orderkey) - 1 AS rk,
         count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN rk < ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split,
       CAST(rk % 5 AS INTEGER) AS fold FROM r"""


@register("exact_split", "X1 X2 O2", EXACT_SPLIT_SQL)
def q_exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderkey")
    h = sp.holdout_split(o, "o_orderkey", 0.2, seed=42, exact=True)
    return sp.kfold(h, "o_orderkey", 5, seed=42, exact=True)


STRATIFIED_SQL = f"""SELECT o_orderkey, o_orderstatus,
  CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_U_SPLIT}, o_orderkey) - 1) % 5 AS INTEGER) AS fold
FROM orders"""


@register("stratified_fold", "X3", STRATIFIED_SQL)
def q_stratified_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return sp.stratified_kfold(o, "o_orderkey", "o_orderstatus", 5, seed=42)
