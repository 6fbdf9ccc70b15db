"""Zone forest on counted combinations (C11)."""

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from prepflow.operators import forest
from prepflow.operators import impute as imp


def _rows(spark, n):
    # two predictors, three zones; the shares of the zones differ per combination
    return spark.range(n).select((F.col("id") % 2).cast("string").alias("a"), F.floor(F.col("id") / 2 % 3).cast("string").alias("b"),
                                 F.when(F.col("id") % 7 < F.col("id") % 2 * 3 + 2, 1.0).when(F.col("id") % 7 < 6, 2.0).otherwise(3.0).alias("z"))


def test_trees_grow_on_combinations(spark, monkeypatch):
    """A tree's training rows are the combinations, however many rows they stand for; its weights are all rows."""
    seen, fit = [], RandomForestClassifier._fit

    def counted(self, dataset):
        seen.append(dataset.count())
        return fit(self, dataset)
    monkeypatch.setattr(RandomForestClassifier, "_fit", counted)
    cfg = imp.ZoneModelConfig(predictors=("a", "b"), num_trees=4, max_depth=4)
    df = _rows(spark, 42_000)
    model = imp.fit_zone_model(df, "z", cfg)
    assert seen and max(seen) <= 64
    last = model.stages[-1]
    assert last.getNumTrees == 4 and last.numClasses == 3
    # each tree's root holds a bootstrap of all rows
    for t in last.trees:
        total = t._java_obj.rootNode().impurityStats().count()
        assert total != 42_000 and abs(total - 42_000) < 6 * 42_000 ** 0.5


def test_forest_knows_the_shares_of_each_combination(spark):
    df = _rows(spark, 42_000)
    cfg = imp.ZoneModelConfig(predictors=("a", "b"), num_trees=20, max_depth=4)
    model = imp.fit_zone_model(df, "z", cfg)
    holes = df.groupBy("a", "b").agg(F.lit(None).cast("double").alias("z"))
    got = {(r["a"], r["b"]): r["z"] for r in imp.apply_zone_model(holes, "z", model, cfg).collect()}
    best = {}
    for r in df.groupBy("a", "b", "z").count().collect():
        best[r["a"], r["b"]] = max(best.get((r["a"], r["b"]), (0, 0)), (r["count"], r["z"]))
    assert got == {k: v for k, (_, v) in best.items()}


def test_bootstraps_do_not_depend_on_partitions(spark):
    cells = spark.createDataFrame([("x", 1000), ("y", 1), ("z", 250_000)], "c string, n long")
    one = forest.with_bootstraps(cells.coalesce(1), ["c"], "n", 200, 42).collect()
    two = forest.with_bootstraps(cells.repartition(3), ["c"], "n", 200, 42).collect()
    assert sorted(one) == sorted(two)
    for r in one:
        mean = sum(r["__draws"]) / 200
        spread = sum((d - mean) ** 2 for d in r["__draws"]) / 199
        assert abs(mean - r["n"]) < 5 * (r["n"] / 200) ** 0.5 and 0.6 * r["n"] < spread < 1.6 * r["n"]
