"""Sources and sinks."""

import pytest
from pyspark.sql import functions as F

from prepflow.operators import evaluate as ev
from prepflow.operators import impute as imp
from prepflow.sources import io


def test_extension_dispatch():
    assert io.format_of("a/b.CSV") == "csv" and io.format_of("x.Parquet") == "parquet"
    with pytest.raises(ValueError):
        io.format_of("book.xlsx")


def test_round_trip_keeps_nulls_and_nan(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "a"), (2, None, None)], "k int, x double, s string")
    p = str(tmp_path / "t.json")
    io.write_table(df, p)
    back = io.read_table(spark, p, schema=df.schema)
    assert back.where(F.col("x").isNull()).count() == 2  # NaN -> NULL at ingest


def test_metrics_append_and_leaderboard(spark, tmp_path):
    a = spark.createDataFrame([(True, True, 0.9), (False, False, 0.1)], "y boolean, p boolean, s double")
    m1 = ev.metrics(a, "y", "p", "s", model="first")
    m2 = ev.metrics(a, "y", "p", None, model="second")
    path, out = str(tmp_path / "metrics"), str(tmp_path / "board")
    io.append_metrics(m2, path, 1)
    io.append_metrics(m1, path, 0)
    io.write_leaderboard(spark, path, out)
    board = spark.read.option("header", True).csv(out)
    assert board.columns == ["Model", "accuracy", "precision", "recall", "f1", "roc_auc"]
    assert [r["Model"] for r in board.collect()] == ["first", "second"]  # in the order of the runs


def test_dictionary_sink(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string")
    d = imp.frequency_dictionary(df, ["v"])
    p = str(tmp_path / "dict")
    io.write_dictionaries(d, p)
    got = {r["value"]: r["rel_freq"] for r in spark.read.json(p).collect()}
    assert got == {"a": 2 / 3, "b": 1 / 3}


def test_row_key_fallback(spark):
    df = spark.createDataFrame([("x",), ("y",)], "v string")
    out = io.with_row_key(df)
    assert out.select("row_key").distinct().count() == 2
    assert io.with_row_key(df, "k", "v").first()["k"] == "x"


def test_bucketed_groups_need_no_exchange(spark, tmp_path):
    """Statistics of groups and their join back, over a table in buckets of the group."""
    from prepflow.operators.groups import with_group_modes, with_group_stats
    df = spark.range(3000).select((F.col("id") % 40).alias("g"), "id", (F.col("id") % 7).cast("string").alias("v"))
    table = io.write_bucketed(df, "bucketed_for_test", "g", 4, str(tmp_path / "b"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = with_group_stats(table, "g", {"n": F.count(F.lit(1)), "last": F.max("id")})
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE bucketed_for_test")
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert len(rows) == 3000 and all(r["n"] == 75 and r["last"] % 40 == r["g"] for r in rows)


def test_folds_are_listed_without_reading(spark, tmp_path):
    df = spark.range(60).select("id", (F.col("id") % 3).alias("fold"), F.when((F.col("id") % 3 == 1), "train").otherwise("test").alias("split"))
    io.write_splits(df, str(tmp_path / "f"), by=("fold", "split"))
    listed = io.list_folds(spark, str(tmp_path / "f"))
    assert [r["fold"] for r in listed.collect()] == [0, 2]
    read = listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1].split("\n")[0]
    assert read.startswith("struct<length") and "content" not in read
    assert [(r["fold"], r["n_test"]) for r in io.discover_folds(spark, str(tmp_path / "f")).collect()] == [(0, 20), (2, 20)]
