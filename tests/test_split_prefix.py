"""Splits (X1-X3) and bucketed ranks / running sums against brute force."""

import math

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from prepflow.operators import prefix, split as sp


def test_kfold_each_row_once(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    out = sp.kfold(df, "k", 5)
    assert out.count() == 1000 and out.select("k").distinct().count() == 1000
    assert {r["fold"] for r in out.select("fold").distinct().collect()} == set(range(5))


def test_exact_sizes(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    h = sp.holdout_split(df, "k", 0.2, exact=True)
    assert h.where(F.col("split") == "test").count() == math.ceil(1003 * 0.2)
    f = sp.kfold(df, "k", 5, exact=True)
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 1003


def test_stratified_balanced(spark):
    df = spark.range(900).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).alias("y"))
    f = sp.stratified_kfold(df, "k", "y", 5)
    per = f.groupBy("y", "fold").count().collect()
    for y in (True, False):
        sizes = [r["count"] for r in per if r["y"] == y]
        assert max(sizes) - min(sizes) <= 1


def test_group_key_keeps_groups_whole(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 50).alias("g"))
    h = sp.holdout_split(df, "k", 0.3, group_key="g")
    assert h.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=40), min_size=1, max_size=60),
       st.integers(min_value=1, max_value=8))
def test_running_sums_brute_force(spark_session_values, buckets):  # noqa: D103
    from prepflow.session import get_session
    spark = get_session()
    vals = spark_session_values
    rows = [(i, v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "k long, v long")
    n = len(rows)
    bucket = F.floor(F.col("k") * buckets / F.lit(n)).cast("long")
    out = prefix.running_sums(df, bucket, [F.col("k")], ["v"], buckets=buckets)
    got = {r["k"]: r["cum_v"] for r in out.collect()}
    acc = 0
    for i, v in rows:
        acc += v
        assert got[i] == acc
    rk = prefix.global_rank(df, bucket, [F.col("k")], "r", buckets=buckets)
    assert {r["k"]: r["r"] for r in rk.collect()} == {i: i for i, _ in rows}


def test_argmax_ties_and_text():
    from prepflow.operators.reshape import argmax
    from prepflow.session import get_session
    df = get_session().createDataFrame([("x", 2, "b"), ("x", 2, "a"), ("x", 1, "c"), ("y", None, "d"), ("y", 0, "e")],
                                       "k string, v int, t string")
    assert {r["k"]: r["t"] for r in argmax(df, "v", "t", ["k"]).collect()} == {"x": "a", "y": "e"}


def test_exact_sizes_refuse_groups():
    import pytest

    from prepflow.operators import split as sp
    from prepflow.session import get_session
    df = get_session().createDataFrame([(1, "g")], "id int, g string")
    with pytest.raises(ValueError):
        sp.holdout_split(df, "id", exact=True, group_key="g")
    with pytest.raises(ValueError):
        sp.kfold(df, "id", exact=True, group_key="g")
