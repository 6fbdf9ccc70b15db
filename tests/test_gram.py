"""Correlations of many columns against pandas."""

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from prepflow.operators import correlate as cor
from prepflow.operators.gram import Moments, merged, pair_moments


def frame(n=400, p=130, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 5))
    x = base @ rng.normal(size=(5, p)) + rng.normal(size=(n, p))
    x[rng.random((n, p)) < 0.2] = np.nan
    x[:, 3] = 7.5  # constant
    x[:, 4] += 1e8  # a large offset
    x[:, 5] = np.nan  # never there
    x[0::2, 6] = np.nan  # never there together
    x[1::2, 7] = np.nan
    return pd.DataFrame(x, columns=[f"c{i}" if i else "a.b `c" for i in range(p)])


def same(got, want):
    if got is None or want is None:
        return got is None and (want is None or math.isnan(want))
    return abs(got - want) < 1e-6


def test_matrix_of_three_blocks_against_pandas(spark):
    pdf = frame()
    df = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(F.col(f"`{c.replace('`', '``')}`")), F.col(f"`{c.replace('`', '``')}`")).alias(c)
                                             for c in pdf.columns]).repartition(7)
    got = {(r["column_a"], r["column_b"]): r["corr"] for r in cor.correlation_matrix(df).collect()}
    want = pdf.corr()
    assert len(got) == len(pdf.columns) ** 2
    wrong = [(k, v, want.loc[k]) for k, v in got.items() if not same(v, None if k[0] == "c3" or k[1] == "c3" else want.loc[k])]
    assert not wrong, wrong[:5]


def test_target_and_one_scan_of_a_thousand_columns(spark, tmp_path):
    pdf = frame(60, 1000, 2)
    spark.createDataFrame(pdf).write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    m = pair_moments(df, df.columns)
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert m.count() == 1_000_000
    top = cor.target_correlation(df, "c1", df.columns, top=5).collect()
    want = pdf.corrwith(pdf["c1"]).abs().drop("c1").drop("c3").sort_values(ascending=False).head(5)
    assert all(abs(r["abs_corr"] - w) < 1e-6 for r, w in zip(top, want))


def test_empty_and_all_missing(spark):
    df = spark.createDataFrame([(None, None)], "x double, y double")
    assert {r["corr"] for r in cor.correlation_matrix(df).collect()} == {None}
    assert {r["corr"] for r in cor.correlation_matrix(df.limit(0)).collect()} <= {None}
    one = spark.createDataFrame([(1.0, 2), (2.0, None)], "x double, y int")
    assert {r["corr"] for r in cor.correlations(one, ["x"], ["y"]).collect()} == {None}


def test_merging_is_the_same_as_adding():
    rng, parts = random.Random(1), []
    x = frame(300, 9, 3).to_numpy()
    for at in range(0, 300, 60):
        m = Moments(9, 9)
        m.add(np.concatenate((x[at:at + 60],) * 2, axis=1))
        parts.append(m.centred())
    rng.shuffle(parts)
    whole = Moments(9, 9)
    whole.add(np.concatenate((x, x), axis=1))
    total = parts[0]
    for p in parts[1:]:
        total = merged(total, p)
    want = whole.centred()
    present = want[0] > 1
    assert np.array_equal(total[0], want[0])
    assert np.allclose(total[5][present], want[5][present], rtol=1e-6, atol=1e-6)
