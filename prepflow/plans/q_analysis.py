"""Queries of the encoding, correlation, rule-mining and derived-feature families
(C13-C18, A12-A13, R1-R5, J2, J3, O1)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import correlate as cor
from ..operators import encode as enc
from ..operators import relations as rel
from ..operators import split as sp
from ..operators.features import SpendConfig, spend_features
from ..operators.groups import group_size
from . import sqlgen
from .registry import register
from .tables import event_costs, event_costs_sql, load, orders_with_nulls, orders_with_nulls_sql

V = f"v AS ({orders_with_nulls_sql()})"
_U_SPLIT = sqlgen.u("o_orderkey", sp.split_seed(42))
_SPLIT_CASE = f"CASE WHEN {_U_SPLIT} < 0.2 THEN 'test' ELSE 'train' END"
CATS = ("o_orderstatus", "o_orderpriority", "c_mktsegment")

# Domain values of the three order columns (fixed by the data generator).
STATUS_VALUES = ("F", "O", "P")
PRIORITY_VALUES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SEGMENT_VALUES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
DOMAINS = {"o_orderstatus": STATUS_VALUES, "o_orderpriority": PRIORITY_VALUES, "c_mktsegment": SEGMENT_VALUES}


def _split_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.holdout_split(orders_with_nulls(spark, sf_dir), "o_orderkey", 0.2, seed=42)


# ---------------------------------------------------------------------- C14
def _onehot_sql_cols() -> str:
    cols = []
    for c in CATS:
        labels = sorted(list(DOMAINS[c]) + [enc.NULL_LABEL])
        for v in labels:
            cond = f"{c} IS NULL" if v == enc.NULL_LABEL else f"{c} = '{v}'"
            cols.append(f'CASE WHEN {cond} THEN 1.0 ELSE 0.0 END AS "{c}_{v}"')
    return ", ".join(cols)


ONEHOT_SQL = f"WITH {V} SELECT o_orderkey, {_SPLIT_CASE} AS split, {_onehot_sql_cols()} FROM v"


@register("onehot_fit_apply", "C14 C15 J4 P10", ONEHOT_SQL)
def q_onehot_fit_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _split_orders(spark, sf_dir).select("o_orderkey", "o_custkey", "split", *CATS)
    v = enc.passthrough_encode(v, drop=("o_custkey",))  # tree branch: the group id goes
    state = enc.onehot_fit(v.where(F.col("split") == sp.TRAIN), CATS)
    return enc.onehot_apply(v, state)


# ---------------------------------------------------------------------- C16
def _dummy_sql_cols() -> str:
    cols = []
    for c in ("o_orderstatus", "c_mktsegment"):
        for v in sorted(DOMAINS[c])[1:]:
            cols.append(f'CASE WHEN {c} = \'{v}\' THEN 1.0 ELSE 0.0 END AS "{c}_{v}"')
    return ", ".join(cols)


DUMMY_SQL = f"""SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_totalprice, {_dummy_sql_cols()}
FROM orders JOIN customer ON o_custkey = c_custkey"""


@register("dummy_drop_first", "C16 U1", DUMMY_SQL)
def q_dummy_drop_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    c = load(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_totalprice", "o_orderstatus",
                                                    "c_mktsegment")
    j = sp.holdout_split(j, "o_orderkey", 0.2, seed=42)
    train = j.where(F.col("split") == sp.TRAIN).drop("split")
    test = j.where(F.col("split") == sp.TEST).drop("split")
    tr, te, _ = enc.dummy_encode(train, test, ["o_orderstatus", "c_mktsegment"])
    return tr.unionByName(te)


# ---------------------------------------------------------------------- C17
def _ordinal_sql() -> str:
    parts, joins = [], []
    for i, c in enumerate(CATS):
        parts.append(f"CAST(CASE WHEN v2.{c} IS NULL THEN (SELECT count(DISTINCT {c}) FROM tr) "
                     f"ELSE COALESCE(k{i}.code, (SELECT count(DISTINCT {c}) FROM tr)) END AS DOUBLE) AS {c}_code")
        joins.append(f"LEFT JOIN (SELECT {c} AS val, row_number() OVER (ORDER BY {c}) - 1 AS code "
                     f"FROM (SELECT DISTINCT {c} FROM tr WHERE {c} IS NOT NULL)) k{i} ON v2.{c} = k{i}.val")
    return (f"WITH {V}, v2 AS (SELECT *, {_SPLIT_CASE} AS split FROM v), tr AS (SELECT * FROM v2 WHERE split = 'train') "
            f"SELECT v2.o_orderkey, v2.split, {', '.join(parts)} FROM v2 {' '.join(joins)}")


@register("ordinal_codes", "C17", _ordinal_sql())
def q_ordinal_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _split_orders(spark, sf_dir).select("o_orderkey", "split", *CATS)
    state = enc.ordinal_fit(v.where(F.col("split") == sp.TRAIN), CATS)
    return enc.ordinal_apply(v, state, suffix="_code").select("o_orderkey", "split", *[f"{c}_code" for c in CATS])


# ---------------------------------------------------------------------- C14 / C16 / C17 with many categories
MANY = ("o_custkey", "o_orderpriority", "order_month")


def _sparse_sql(drop_first: int) -> str:
    ctes, cells, offset = [], [], []
    for i, c in enumerate(MANY):
        ctes.append(f"k{i} AS (SELECT val, row_number() OVER (ORDER BY val) - 1 - {drop_first} AS code FROM "
                    f"(SELECT DISTINCT CAST({c} AS VARCHAR) AS val FROM v2 WHERE split = 'train' AND {c} IS NOT NULL))")
        cells.append(f"(SELECT k.code + {' + '.join(offset) or 0} FROM k{i} k WHERE k.val = CAST(v2.{c} AS VARCHAR) AND k.code >= 0)")
        offset.append(f"(SELECT count(*) - {drop_first} FROM k{i})")
    return (f"WITH {V}, v2 AS (SELECT *, {_SPLIT_CASE} AS split FROM v), {', '.join(ctes)} "
            f"SELECT o_orderkey, split, concat_ws(',', {', '.join(cells)}) AS active FROM v2")


def _active(spark: SparkSession, sf_dir: str, drop_first: bool) -> DataFrame:
    v = _split_orders(spark, sf_dir).select("o_orderkey", "split", *MANY)
    state = enc.fit_category_table(v.where(F.col("split") == sp.TRAIN), MANY)
    out = enc.sparse_indices(v, state, drop_first=drop_first)
    return out.select("o_orderkey", "split", F.array_join("active", ",").alias("active"))


@register("onehot_sparse", "C14 C17", _sparse_sql(0))
def q_onehot_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _active(spark, sf_dir, False)


@register("dummy_sparse", "C16 C17", _sparse_sql(1))
def q_dummy_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _active(spark, sf_dir, True)


# ---------------------------------------------------------------------- C18
STANDARDISE_SQL = f"""WITH {V}, v2 AS (SELECT *, {_SPLIT_CASE} AS split FROM v),
s AS (SELECT avg(o_totalprice) AS m1, stddev_pop(o_totalprice) AS s1,
             avg(c_nationkey) AS m2, stddev_pop(c_nationkey) AS s2 FROM v2 WHERE split = 'train')
SELECT o_orderkey, split, round((o_totalprice - m1) / s1, 6) AS o_totalprice,
       round((c_nationkey - m2) / s2, 6) AS c_nationkey
FROM v2, s"""


@register("standardise", "C18", STANDARDISE_SQL)
def q_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _split_orders(spark, sf_dir).select("o_orderkey", "split", "o_totalprice", "c_nationkey")
    state = enc.standard_fit(v.where(F.col("split") == sp.TRAIN), ["o_totalprice", "c_nationkey"])
    out = enc.standard_apply(v, state)
    return out.select("o_orderkey", "split", F.round("o_totalprice", 6).alias("o_totalprice"),
                      F.round("c_nationkey", 6).alias("c_nationkey"))


# ---------------------------------------------------------------------- A13
LI_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


def _corr_sql(a: str, b: str, src: str) -> str:
    return (f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(covar_pop({a}, {b}) / "
            f"nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6) AS corr FROM {src}")


CORR_MATRIX_SQL = " UNION ALL ".join(_corr_sql(a, b, "lineitem") for a in LI_NUM for b in LI_NUM)


@register("corr_matrix", "A13", CORR_MATRIX_SQL)
def q_corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").select(*LI_NUM)
    m = cor.correlation_matrix(li, list(LI_NUM))
    return m.withColumn("corr", F.round("corr", 6))


_NULLED = ("o_totalprice", "order_month", "c_nationkey", "n_regionkey")
_NULLED_TEXT = ("o_orderstatus", "c_mktsegment", "o_orderpriority")
CORR_NULLS_SQL = f"""WITH v AS ({orders_with_nulls_sql()}),
e AS (SELECT *, COALESCE(o_orderstatus = 'F', false)::INT AS "o_orderstatus_F",
        COALESCE(c_mktsegment = 'BUILDING', false)::INT AS "c_mktsegment_BUILDING",
        COALESCE(o_orderpriority = '1-URGENT', false)::INT AS "o_orderpriority_1-URGENT" FROM v)
""" + " UNION ALL ".join(
    f"""SELECT '{a}' AS column_a, '{b}' AS column_b,
        (SELECT round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6)
         FROM (SELECT "{a}"::DOUBLE AS x, "{b}"::DOUBLE AS y FROM e WHERE "{a}" IS NOT NULL AND "{b}" IS NOT NULL)) AS corr"""
    for a in (*_NULLED, "o_orderstatus_F", "c_mktsegment_BUILDING", "o_orderpriority_1-URGENT")
    for b in (*_NULLED, "o_orderstatus_F", "c_mktsegment_BUILDING", "o_orderpriority_1-URGENT"))


@register("corr_nulls", "A13 R5", CORR_NULLS_SQL)
def q_corr_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = orders_with_nulls(spark, sf_dir).select(*_NULLED, *_NULLED_TEXT)
    encoded, _ = cor.encode_for_correlation(v, list(_NULLED_TEXT), [])
    m = cor.correlation_matrix(encoded, [*_NULLED, "o_orderstatus_F", "c_mktsegment_BUILDING", "o_orderpriority_1-URGENT"])
    return m.withColumn("corr", F.round("corr", 6))


_T_FEATS = list(LI_NUM) + ["l_linestatus_F", "l_linestatus_O"]
CORR_TARGET_SQL = """WITH t AS (SELECT *, CAST(l_returnflag = 'R' AS INTEGER) AS is_r,
    CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS l_linestatus_F,
    CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS l_linestatus_O FROM lineitem),
c AS (""" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, abs(covar_pop({f}, is_r) / nullif(stddev_pop({f}) * stddev_pop(is_r), 0)) AS a FROM t"
    for f in _T_FEATS) + """)
SELECT feature, round(a, 6) AS abs_corr,
       CASE WHEN a >= 0.15 THEN 'strong' WHEN a >= 0.05 THEN 'medium' ELSE 'weak' END AS band
FROM c ORDER BY a DESC NULLS LAST, feature LIMIT 15"""


@register("corr_target", "R4 R5 O1 C14 P8", CORR_TARGET_SQL)
def q_corr_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").select(*LI_NUM, "l_linestatus",
                                                (F.col("l_returnflag") == "R").cast("int").alias("is_r"))
    encoded, num = cor.encode_for_correlation(li, ["l_linestatus"], [])
    out = cor.target_correlation(encoded, "is_r", num, top=15)
    return out.withColumn("abs_corr", F.round("abs_corr", 6))


# ---------------------------------------------------------------------- R1 / J3 / A12
PART_CATS = ("p_type", "p_brand", "p_size")
EXCLUSION_SQL = "WITH p AS (SELECT CAST(p_type AS VARCHAR) AS p_type, CAST(p_brand AS VARCHAR) AS p_brand, " \
    "CAST(p_size AS VARCHAR) AS p_size FROM part) " + " UNION ALL ".join(
        f"""SELECT '{a}' AS column_a, va AS value_a, '{b}' AS column_b, vb AS value_b FROM (
          (SELECT a.va, b.vb FROM (SELECT DISTINCT {a} AS va FROM p WHERE {a} IS NOT NULL AND {b} IS NOT NULL) a
             CROSS JOIN (SELECT DISTINCT {b} AS vb FROM p WHERE {a} IS NOT NULL AND {b} IS NOT NULL) b)
          EXCEPT (SELECT {a}, {b} FROM p WHERE {a} IS NOT NULL AND {b} IS NOT NULL))"""
        for a, b in combinations(PART_CATS, 2))


@register("exclusion_pairs", "R1 J3 A12", EXCLUSION_SQL)
def q_exclusion_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.exclusion_rules(load(spark, sf_dir, "part"), PART_CATS)


EXCLUSION_MANY_SQL = """WITH s AS (SELECT DISTINCT CAST(l_linenumber AS VARCHAR) AS va, CAST(l_partkey AS VARCHAR) AS vb FROM lineitem
           WHERE l_linenumber IS NOT NULL AND l_partkey IS NOT NULL)
SELECT 'l_linenumber' AS column_a, va AS value_a, 'l_partkey' AS column_b, vb AS value_b
FROM ((SELECT a.va, b.vb FROM (SELECT DISTINCT va FROM s) a, (SELECT DISTINCT vb FROM s) b) EXCEPT SELECT va, vb FROM s)"""


@register("exclusion_many", "R1 J3 A12", EXCLUSION_MANY_SQL)
def q_exclusion_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A domain that grows with the data: parts never seen on some line number."""
    return rel.exclusion_rules(load(spark, sf_dir, "lineitem"), ["l_linenumber", "l_partkey"])


CONTINGENCY_SQL = """SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY 1, 2"""


@register("contingency", "A12", CONTINGENCY_SQL)
def q_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.contingency(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


# ---------------------------------------------------------------------- R2 / A9 / A10
def _cohesion_sql(src: str, g: str, t: str) -> str:
    return f"""SELECT '{g}' AS group_col, '{t}' AS target_col, count(*) AS n_groups,
        count_if(nd = 1) AS n_pure,
        round(COALESCE(100.0 * count_if(nd = 1) / nullif(count(*), 0), 0.0), 6) AS pct_pure
      FROM (SELECT {g}, count(DISTINCT {t}) AS nd, count(*) AS n FROM {src}
            WHERE {g} IS NOT NULL AND {t} IS NOT NULL GROUP BY {g}) WHERE n > 1"""


COHESION_SQL = f"WITH {V} " + " UNION ALL ".join([
    _cohesion_sql("v", "o_custkey", "o_orderstatus"), _cohesion_sql("v", "o_custkey", "o_orderpriority"),
    _cohesion_sql("v", "c_nationkey", "c_mktsegment"),
    _cohesion_sql("lineitem", "l_orderkey", "l_returnflag"),
    _cohesion_sql("lineitem", "l_orderkey", "l_linestatus")])


@register("group_cohesion", "R2 A9 A10", COHESION_SQL)
def q_group_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = orders_with_nulls(spark, sf_dir)
    a = rel.cohesion(v, [("o_custkey", "o_orderstatus"), ("o_custkey", "o_orderpriority"),
                         ("c_nationkey", "c_mktsegment")])
    b = rel.cohesion(load(spark, sf_dir, "lineitem"), [("l_orderkey", "l_returnflag"),
                                                        ("l_orderkey", "l_linestatus")])
    return a.unionByName(b).withColumn("pct_pure", F.round("pct_pure", 6))


MULTI_MEMBER_SQL = f"""WITH {V}
SELECT o_orderkey, o_custkey FROM v WHERE o_custkey IN (
  SELECT o_custkey FROM v WHERE o_custkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"""


@register("multi_member_rows", "J2 A8", MULTI_MEMBER_SQL)
def q_multi_member_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = orders_with_nulls(spark, sf_dir).select("o_orderkey", "o_custkey")
    return rel.multi_member_rows(v, "o_custkey")


# ---------------------------------------------------------------------- R3 / A11
COSTS = tuple(f"cost_{t}" for t in ("view", "click", "purchase", "signup", "error"))
_TOTAL_SQL = " + ".join(f"COALESCE({c}, 0.0)" for c in COSTS)
SPEND_CHECK_SQL = f"""WITH e AS ({event_costs_sql()}), t AS (SELECT *, {_TOTAL_SQL} AS total FROM e)
SELECT round(avg(CASE WHEN event_type = 'error' THEN total END), 6) AS mean_spend_flagged,
       round(avg(CASE WHEN value < 13 THEN total END), 6) AS mean_spend_children,
       COALESCE(avg(CASE WHEN event_type = 'error' THEN total END) > 0, false) AS flagged_spend_violation
FROM t JOIN (SELECT event_id, value FROM events) USING (event_id)"""


@register("spend_check", "R3 A11 F6 P7", SPEND_CHECK_SQL)
def q_spend_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_costs(spark, sf_dir).join(load(spark, sf_dir, "events").select("event_id", "value"), "event_id")
    r = rel.spending_checks(e, COSTS, F.col("event_type") == "error", F.col("value") < 13)
    return r.select(F.round("mean_spend_flagged", 6).alias("mean_spend_flagged"),
                    F.round("mean_spend_children", 6).alias("mean_spend_children"), "flagged_spend_violation")


# ---------------------------------------------------------------------- C13 / F6 / F7
SPEND_FEATURES_SQL = f"""WITH e AS ({event_costs_sql()})
SELECT event_id, user_id, round({_TOTAL_SQL}, 6) AS total_spending,
       CAST(({_TOTAL_SQL}) = 0 AS INTEGER) AS spending_zero,
       CAST((COALESCE(cost_purchase, 0.0) + COALESCE(cost_signup, 0.0)) > 0 AS INTEGER) AS has_luxury,
       CAST(count(user_id) OVER (PARTITION BY user_id) = 1 AS INTEGER) AS is_alone
FROM e"""


@register("spend_features", "C13 F6 F7 W1", SPEND_FEATURES_SQL)
def q_spend_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = group_size(event_costs(spark, sf_dir), "user_id", "user_events")
    cfg = SpendConfig(cost_cols=COSTS, luxury_cols=("cost_purchase", "cost_signup"), size_col="user_events",
                      total_col="total_spending", zero_col="spending_zero", luxury_col="has_luxury",
                      alone_col="is_alone", drop=())
    out = spend_features(e, cfg)
    return out.select("event_id", "user_id", F.round("total_spending", 6).alias("total_spending"),
                      "spending_zero", "has_luxury", "is_alone")
