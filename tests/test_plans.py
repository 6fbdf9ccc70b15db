"""Physical plan shape: skew-safe group statistics, pruning, no cross joins."""

from pyspark.sql import functions as F

from prepflow.operators import impute as imp
from prepflow.operators.groups import with_group_stats
from prepflow.plans.registry import REGISTRY
from prepflow.plans import catalog  # noqa: F401

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_group_stats_use_partial_aggregation_not_window(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet")
    out = with_group_stats(df, "o_custkey", {"m": F.median("o_totalprice"), "n": F.count("o_custkey")})
    p = plan(out)
    assert "Window" not in p
    assert "partial_" in p or "ObjectHashAggregate" in p


def test_hot_group_correct(spark):
    # a third of the rows share one key
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("g"),
                                  F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 11)
                                  .cast("double").alias("x"))
    a = imp.group_median_fill(df, "g", "x", via="join")
    b = imp.group_median_fill(df, "g", "x", via="window")
    assert sorted(a.collect()) == sorted(b.collect())
    approx = imp.group_median_fill(df, "g", "x", accuracy=10000)
    assert approx.where((F.col("g") == -1) & F.col("x").isNull()).count() == 0


def test_scan_is_pruned(spark):
    df = REGISTRY["split_composite"].fn(spark, SF)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "o_custkey" not in p.split("ReadSchema")[1].split("\n")[0]


def test_no_cartesian_or_nested_loop_joins(spark):
    for name in ("exclusion_pairs", "null_combos", "sample_fill", "impute_fit_apply", "metrics"):
        p = plan(REGISTRY[name].fn(spark, SF))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
