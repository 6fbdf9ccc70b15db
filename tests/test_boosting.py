"""Prefixes of one boosted fit against fits of their own."""

import random

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from prepflow.operators import boosting as bo
from prepflow.operators import models as mdl


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(400):
        x, y = rng.gauss(0, 1), rng.gauss(0, 1)
        data.append((i, Vectors.dense([x, y]), float(x * y + rng.gauss(0, 0.4) > 0), x, y, rng.choice("abc")))
    return spark.createDataFrame(data, ["id", "features", "label", "x", "y", "c"]).cache()


def _gbt(rounds):
    return GBTClassifier(maxIter=rounds, maxDepth=3, stepSize=0.2, subsamplingRate=0.8, seed=9)


def test_prefixes_are_the_shorter_fits(rows):
    longest = _gbt(12).fit(rows)
    scored = bo.with_margins(longest, rows, [3, 7, 12]).select("id", *[f"__margin{n}" for n in (3, 7, 12)])
    for n in (3, 7, 12):
        own = _gbt(n).fit(rows).transform(rows).select("id", vector_to_array("rawPrediction")[1].alias("m"), "prediction", "label")
        both = own.join(scored, "id").select(F.max(F.abs(F.col("m") - F.col(f"__margin{n}"))),
                                             F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()
        assert both[0] < 1e-9
        assert bo.accuracy_by_rounds(longest, rows, [3, 7, 12])[n] == pytest.approx(both[1], abs=1e-12)


def test_segments_are_checked(rows):
    model = _gbt(3).fit(rows)
    for start, end in ((0, 4), (2, 2), (-1, 2)):
        with pytest.raises(ValueError):
            bo.segment(model, start, end)
    none = bo.accuracy_by_rounds(model, rows.limit(0), [1, 3])
    assert set(none) == {1, 3} and all(v != v for v in none.values())


def test_groups_and_every_rounds():
    a, b = {"maxIter": 5, "maxDepth": 3}, {"maxIter": 9, "maxDepth": 3}
    c = {"maxIter": 5, "maxDepth": 4}
    assert list(bo.by_longest_fit([a, b, c])) == [({"maxDepth": 3}, {0: 5, 1: 9}), ({"maxDepth": 4}, {2: 5})]
    found = bo.every_rounds([a, c], [5, 9])
    assert found[:2] == [a, c] and len(found) == 4 and b in found and {"maxIter": 9, "maxDepth": 4} in found


def test_search_agrees_with_cross_validation(spark, rows):
    data = rows.select("id", (F.col("label") > 0).alias("target"), "x", "y", "c")
    preset = mdl.Preset("boosted", "gbt", dict(maxIter=4, maxDepth=3, stepSize=0.3, subsamplingRate=0.8, seed=3))
    space = {"maxIter": [2, 4, 8], "maxDepth": [2, 3]}
    found, best = mdl.random_search(data, preset, ["x", "y"], ["c"], "target", "id", space, n_iter=2, folds=3,
                                    include_base=True, all_rounds=True)
    found = found.collect()
    assert len(found) == 6 or len({r.params for r in found}) == len(found) == 3
    prepared = mdl.sp.stratified_kfold(mdl._with_label(data, "target"), "id", "label", 3, 42, col="__fold")
    prepared = mdl.balanced_for_training(mdl._training_columns(prepared, preset, ["x", "y"], ["c"], "target", "id", "__fold"))
    pipe = mdl.build_pipeline(preset, ["x", "y"], ["c"], "label", mdl.data_shape(prepared, ["c"]))
    clf = pipe.getStages()[-1]
    maps = [{clf.getParam(k): v for k, v in eval(r.params)} for r in found]
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps, foldCol="__fold", numFolds=3,
                        evaluator=MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy")).fit(prepared)
    assert [r.accuracy for r in found] == pytest.approx(cv.avgMetrics, abs=1e-12)
    top = dict(eval(next(r.params for r in found if r["rank"] == 1)))
    assert best.stages[-1].getNumTrees == top["maxIter"]
    prepared.unpersist()


def test_passenger_model_trains_all_rounds_of_the_preset(spark, monkeypatch):
    """Neither fewer rounds nor another rate: what reaches the learner is the preset."""
    from prepflow.plans import pipeline as pl
    from prepflow.plans import q_models
    tree = spark.createDataFrame([(str(i), i % 5 and "train" or "test", float(i), "ab"[i % 2], i % 3 == 0) for i in range(40)],
                                 "PassengerId string, split string, Age double, Deck string, Transported boolean")
    seen = []

    class Trained(Exception):
        pass

    def fit(self, data):
        seen.append((self.getMaxIter(), self.getStepSize(), self.getMaxDepth(), data.count()))
        raise Trained

    monkeypatch.setattr(pl, "prepare", lambda *a, **k: pl.Prepared(tree, tree))
    monkeypatch.setattr(GBTClassifier, "_fit", fit)
    with pytest.raises(Trained):
        q_models.q_passenger_model(spark, "/root/testdata/sf0.001")
    assert seen == [(1500, 0.01, 5, 32)]
