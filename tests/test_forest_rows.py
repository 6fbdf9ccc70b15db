"""Forests grown over rows against Spark ML's (M5, M8)."""

import random

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from prepflow.operators import forest_rows as fr
from prepflow.operators import models as mdl
from prepflow.operators import split as sp


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        x, z, c = rng.randint(0, 20), rng.randint(0, 9), rng.choice("abcdef")
        rows.append((i, float(x), float(z), c, rng.random() < (0.2 + 0.5 * (x > 12) + 0.25 * (c in "ace") * (z < 5))))
    return spark.createDataFrame(rows, "id int, x double, z double, c string, y boolean").cache()


def _parts(data, **params):
    preset = mdl.Preset("f", "rf", {"seed": 7, **params})
    rows = mdl.balanced_for_training(mdl._training_columns(data, preset, ["x", "z"], ["c"], "y", "id"))
    return rows, mdl.build_pipeline(preset, ["x", "z"], ["c"], "label", mdl.data_shape(rows, ["c"]))


@pytest.mark.parametrize("per_node,chunk", [(20_000, 4096), (200, 500)])
def test_a_tree_without_draws_is_that_of_spark(data, monkeypatch, per_node, chunk):
    """Same splits, leaves and probabilities, whether nodes are split by sums or in one task."""
    monkeypatch.setattr(fr, "ROWS_PER_NODE", per_node)
    monkeypatch.setattr(fr, "ROWS_PER_CHUNK", chunk)

    rows, pipe = _parts(data, numTrees=1, maxDepth=6, minInstancesPerNode=3)
    clf = pipe.getStages()[-1]
    stages, train, bins = fr._prepared(pipe, rows)
    chunks = fr.chunked(train, clf.getFeaturesCol(), "label", bins, chunk)
    growth = fr.Growth(bins, 3, 6, 7, bootstrap=False)
    trees = fr.grown_trees(chunks, growth, [3], 1, rows.count())
    mine = fr.spark_model(clf, train, trees, growth)
    theirs = RandomForestClassifier(featuresCol=clf.getFeaturesCol(), labelCol="label", numTrees=1, bootstrap=False, maxDepth=6,
                                    minInstancesPerNode=3, featureSubsetStrategy="all").fit(train)
    assert mine.totalNumNodes == theirs.totalNumNodes
    p = vector_to_array("probability")[1]
    a, b = ([r[0] for r in m.transform(train).select(p).collect()] for m in (mine, theirs))
    assert a == pytest.approx(b, abs=1e-12)



def _accuracy(model, rows):
    return model.transform(rows).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


@pytest.mark.parametrize("per_node", [20_000, 300])
def test_shared_trees_are_those_of_own_fits(data, monkeypatch, per_node):
    """One forest a fold gives each combination the accuracy of its own forest."""
    monkeypatch.setattr(fr, "ROWS_PER_NODE", per_node)
    preset = mdl.Preset("f", "rf", {"seed": 7})
    rows = sp.kfold(data, "id", 2, 1, col="__fold")
    rows = mdl.balanced_for_training(mdl._training_columns(rows, preset, ["x", "z"], ["c"], "y", "id", "__fold"))
    pipe = mdl.build_pipeline(preset, ["x", "z"], ["c"], "label", mdl.data_shape(rows, ["c"]))
    combos = [{"numTrees": n, "maxDepth": d, "minInstancesPerNode": m} for n, d, m in ((5, 3, 1), (23, 7, 1), (5, 7, 40), (1, 4, 2))]
    grown, grow = [], fr.grown_trees
    monkeypatch.setattr(fr, "grown_trees", lambda *a: grown.append(a) or grow(*a))
    got = fr.fold_accuracies(rows, pipe, combos, "__fold", 2)
    assert len(grown) == 4  # a fold's forest, and its single tree
    for c, accuracy in list(zip(combos, got))[:: 2 if per_node < 20_000 else 1]:
        own = [_accuracy(fr.fit_forest(pipe, rows.where(F.col("__fold") != i), c), rows.where(F.col("__fold") == i)) for i in range(2)]
        assert accuracy == pytest.approx(sum(own) / 2, abs=1e-12)


def test_forests_do_not_come_from_cross_validation(data, monkeypatch):
    """Spark grows no forest for the folds of a search; the model is saved and loaded like any other."""
    seen, fit = [], RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, d: seen.append((self.getNumTrees(), self.getMaxDepth())) or fit(self, d))
    found, best = mdl.random_search(data, "random_forest", ["x", "z"], ["c"], "y", "id",
                                    space={"numTrees": [4, 8], "maxDepth": [2, 5], "minInstancesPerNode": [1, 3]}, n_iter=4, folds=2)
    top = dict(eval(found.where("rank = 1").first()["params"]))
    assert set(seen) == {(1, 0)}  # the form of the saved model
    assert best.stages[-1].getNumTrees == top["numTrees"] and max(t.depth for t in best.stages[-1].trees) <= top["maxDepth"]


def test_search_leaves_the_forest_in_the_shared_folder(data, monkeypatch, tmp_path):
    """The best forest is grown and saved whole; the driver loads it once, when it is used."""
    from pyspark.ml.classification import RandomForestClassificationModel
    loaded, load = [], RandomForestClassificationModel.load
    monkeypatch.setattr(RandomForestClassificationModel, "load", lambda path: loaded.append(path) or load(path))
    found, best = mdl.random_search(data, "random_forest", ["x", "z"], ["c"], "y", "id",
                                    space={"numTrees": [5], "maxDepth": [4], "minInstancesPerNode": [1]}, n_iter=1, folds=2)
    assert found.count() == 1 and loaded == []
    scored = best.transform(data).select("id", "prediction").collect()
    assert len(scored) == 3000 and len(loaded) == 1 and best.stages[-1].getNumTrees == 5
    mdl.save_model(best, str(tmp_path / "m"))
    again = mdl.load_model(str(tmp_path / "m")).transform(data).select("id", "prediction").collect()
    assert sorted(again) == sorted(scored)


def test_forest_is_as_good_as_that_of_spark(data):
    """Bootstraps and tried features are drawn otherwise: equal in distribution."""
    rows, pipe = _parts(data, numTrees=40, maxDepth=6, minInstancesPerNode=2)
    mine, theirs = fr.fit_forest(pipe, rows), pipe.fit(rows)
    p = vector_to_array("probability")[1]
    a, b = ([r[0] for r in m.transform(rows).select(p).collect()] for m in (mine, theirs))
    assert sum(abs(x - y) for x, y in zip(a, b)) / len(a) < 0.03
    assert abs(_accuracy(mine, rows) - _accuracy(theirs, rows)) < 0.02
    again = [r[0] for r in fr.fit_forest(pipe, rows).transform(rows).select(p).collect()]
    assert a == again


def test_many_classes_stay_with_spark(data):
    rows, pipe = _parts(data, numTrees=2)
    assert fr.grows(pipe.getStages()[-1], rows)
    assert not fr.grows(pipe.getStages()[-1], rows.withColumn("label", F.col("label") + F.col("x") % 2))
