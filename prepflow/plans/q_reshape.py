"""Projection / union / ordering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import coerce_prediction, normalise_bool
from ..operators import reshape as rs
from ..operators import split as sp
from . import sqlgen
from .registry import register
from .tables import load

_U = sqlgen.u("o_orderkey", sp.split_seed(42))

ALIGN_SQL = """SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'F' THEN 'True' WHEN o_orderstatus <> 'F' THEN 'False' END AS is_final,
  CASE WHEN o_custkey % 2 = 0 THEN 'False' WHEN o_custkey % 2 = 1 THEN 'True' END AS odd_customer,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'TRUE' ELSE 'no' END = 'TRUE' AS urgent_pred,
  0.0 AS c_acctbal, o_totalprice
FROM orders"""


@register("align_normalise", "P1 P2 P10 P11 P12", ALIGN_SQL)
def q_align_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boolean-like columns to 'True'/'False' (from a boolean and from 0/1
    numbers), a text prediction coerced to boolean, then the columns aligned to
    a reference list (missing ones filled with 0.0, extras dropped)."""
    o = load(spark, sf_dir, "orders")
    x = o.select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").alias("is_final"),
                 (F.col("o_custkey") % 2).alias("odd_customer"),
                 F.when(F.col("o_orderpriority") == "1-URGENT", "TRUE").otherwise("no").alias("urgent_pred"),
                 F.lit("x").alias("extra"))
    x = x.select("o_orderkey", "o_totalprice", normalise_bool(x, "is_final"), normalise_bool(x, "odd_customer"),
                 coerce_prediction(x, "urgent_pred").alias("urgent_pred"), "extra")
    x = rs.drop_existing(x, ["extra", "not_there"])
    x = rs.reorder(x, ["o_orderkey"], ["o_totalprice"])
    return rs.align_columns(x, ["o_orderkey", "is_final", "odd_customer", "urgent_pred", "c_acctbal",
                                "o_totalprice"])


UNION_TOPK_SQL = f"""WITH s AS (
  SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN {_U} < 0.2 THEN 'test' ELSE 'train' END AS split
  FROM orders),
top AS (SELECT 'top' AS kind, split, o_orderkey, o_totalprice FROM (
          SELECT *, row_number() OVER (PARTITION BY split ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM s)
        WHERE rn <= 10),
best AS (SELECT 'best' AS kind, split, o_orderkey, o_totalprice FROM (
          SELECT *, row_number() OVER (PARTITION BY split ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM s)
        WHERE rn = 1)
SELECT * FROM top UNION ALL SELECT * FROM best"""


@register("union_topk", "U1 U2 O1 O2 O4 S11", UNION_TOPK_SQL)
def q_union_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and test parts unioned with a label (U1/U2), the 10 most expensive
    orders of each part (O1, a per-part top-k) and the single best one (O4,
    ``max_by``, ties to the smaller key), ordered (O2)."""
    o = sp.holdout_split(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"),
                         "o_orderkey", 0.2, seed=42)
    parts = {label: o.where(F.col("split") == label).drop("split") for label in (sp.TRAIN, sp.TEST)}
    u = rs.union_splits(parts)
    from pyspark.sql import Window
    w = Window.partitionBy("split").orderBy(F.desc("o_totalprice"), "o_orderkey")
    top = (u.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 10)
            .select(F.lit("top").alias("kind"), "split", "o_orderkey", "o_totalprice"))
    best = rs.argmax(u.select("split", "o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", ["split"])
    best = best.select(F.lit("best").alias("kind"), "split", "o_orderkey", "o_totalprice")
    return top.unionByName(best).orderBy("kind", "split", F.desc("o_totalprice"))
