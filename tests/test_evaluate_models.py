"""Evaluation (E1-E6) and models."""

import math
import random

import pytest
from pyspark.sql import functions as F

from prepflow.operators import evaluate as ev
from prepflow.operators import models as mdl


def _scored(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.random() < 0.4
        s = round(min(1.0, max(0.0, rng.gauss(0.6 if y else 0.4, 0.2))), 2)  # ties on purpose
        rows.append((i, y, s, s > 0.5))
    return spark.createDataFrame(rows, "k long, actual boolean, score double, pred boolean"), rows


def test_auc_matches_spark_exact_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    df, _ = _scored(spark)
    ours = ev.roc_auc(df, "actual", "score").first()["roc_auc"]
    ref = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y", numBins=0) \
        .evaluate(df.withColumn("y", F.col("actual").cast("double")))
    assert abs(ours - ref) < 1e-12


def test_auc_brute_force_pairs(spark):
    df, rows = _scored(spark, 120)
    pos = [s for _, y, s, _ in rows if y]
    neg = [s for _, y, s, _ in rows if not y]
    brute = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg) / (len(pos) * len(neg))
    assert abs(ev.roc_auc(df, "actual", "score", limit=4).first()["roc_auc"] - brute) < 1e-12


def test_metrics_and_confusion(spark):
    df, rows = _scored(spark)
    tp = sum(1 for _, y, _, p in rows if y and p)
    fp = sum(1 for _, y, _, p in rows if not y and p)
    fn = sum(1 for _, y, _, p in rows if y and not p)
    m = ev.metrics(df, "actual", "pred", "score", model="m").first()
    assert m["tp"] == tp and m["fp"] == fp and m["fn"] == fn
    assert abs(m["precision"] - tp / (tp + fp)) < 1e-12
    cells = {(r["actual"], r["predicted"]): r["n"] for r in ev.confusion_matrix(df, "actual", "pred").collect()}
    assert len(cells) == 4 and cells[(True, True)] == tp
    rep = {r["class"]: r["support"] for r in ev.class_report(df, "actual", "pred").collect()}
    assert rep[True] == tp + fn


def test_zero_division_gives_zero(spark):
    df = spark.createDataFrame([(False, False), (False, False)], "a boolean, p boolean")
    m = ev.metrics(df, "a", "p").first()
    assert m["precision"] == 0.0 and m["recall"] == 0.0 and m["f1"] == 0.0 and m["roc_auc"] is None


def _t6(spark):
    rng = random.Random(42)
    train = spark.createDataFrame(
        [(str(1000 - i), rng.randint(0, 9), rng.randint(0, 1), rng.random() < 0.5) for i in range(20)],
        "PassengerId string, Feature1 int, Feature2 int, Transported boolean")
    test = spark.createDataFrame([("1001", 5, 1), ("1002", 6, 0), ("1003", 7, 1)],
                                 "PassengerId string, Feature1 int, Feature2 int")
    return train, test


def test_t6_model_full_run(spark, tmp_path):
    train, test = _t6(spark)
    r = mdl.run_model(train, "random_forest", ["PassengerId", "Feature1", "Feature2"], [],
                      target="Transported", key="PassengerId", mode="full", test=test)
    assert r.scored.count() == 3
    feats = [st for st in r.models[0].stages if hasattr(st, "getStatement")][0].getStatement()
    assert "PassengerId" not in feats
    probs = [x["probability"] for x in r.scored.collect()]
    assert all(0.0 <= p <= 1.0 for p in probs)
    from prepflow.sources import io
    out = str(tmp_path / "sub")
    io.write_submission(r.scored, out)
    sub = spark.read.option("header", True).csv(out)
    assert sub.columns == ["PassengerId", "Transported"] and sub.count() == 3
    path = str(tmp_path / "model")
    mdl.save_model(r.models[0], path)
    again = mdl.score(mdl.load_model(path), test, "PassengerId")
    assert sorted(again.collect()) == sorted(r.scored.collect())


def test_t6_cv_score_in_unit_interval(spark):
    train, _ = _t6(spark)
    res, best = mdl.random_search(train, "random_forest", ["Feature1", "Feature2"], [], "Transported",
                                  "PassengerId", space={"numTrees": [5, 10], "maxDepth": [2, 3]}, n_iter=3,
                                  folds=3)
    accs = [r["accuracy"] for r in res.collect()]
    assert len(accs) == 3 and all(0.0 <= a <= 1.0 for a in accs)
    assert best is not None


def test_same_seed_same_predictions(spark):
    train, test = _t6(spark)
    a = mdl.score(mdl.train(train, "xgboost", ["Feature1", "Feature2"], params={"maxIter": 5}), test, "PassengerId")
    b = mdl.score(mdl.train(train, "xgboost", ["Feature1", "Feature2"], params={"maxIter": 5}), test, "PassengerId")
    assert sorted(a.collect()) == sorted(b.collect())


def test_score_requires_model(spark):
    _, test = _t6(spark)
    with pytest.raises(ValueError):
        mdl.score(None, test, "PassengerId")


def test_fitted_trees_equal_the_parameters(spark):
    """Nothing bounds the rounds, and no rows are withheld."""
    train, _ = _t6(spark)
    assert mdl.PRESETS["xgboost"].params["maxIter"] == 1500 and mdl.PRESETS["catboost"].early_stop_fraction is None
    m = mdl.train(train, "catboost", ["Feature1", "Feature2"], params={"maxIter": 60})
    assert len(m.stages[-1].trees) == 60


def test_catboost_search_reports_what_it_trains(spark):
    train, _ = _t6(spark)
    space = {"maxIter": [2, 3], "maxDepth": [2]}
    res, best = mdl.random_search(train, "catboost", ["Feature1", "Feature2"], [], "Transported", "PassengerId",
                                  space=space, n_iter=2, folds=2)
    top = res.where("rank = 1").first()["params"]
    assert str(("maxIter", len(best.stages[-1].trees))) in top


def test_many_categories(spark):
    rows = [(i, f"c{i % 50}", float(i % 7), i % 50 < 25) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, c string, x double, y boolean")
    for preset, params in (("random_forest", {"numTrees": 3}), ("svc", {"maxIter": 5}), ("mlp", {"maxIter": 5})):
        m = mdl.train(df, preset, ["x"], ["c"], "y", "id", params=params)
        unseen = spark.createDataFrame([(1, "new", None)], "id int, c string, x double")
        out = mdl.score(m, unseen if preset != "random_forest" else df, "id").collect()
        assert out and all(0 <= r["probability"] <= 1 for r in out)


def test_svc_weighs_the_mean_loss(spark):
    train, _ = _t6(spark)
    m = mdl.train(train, "svc", ["Feature1"], params={"C": 10.0, "maxIter": 3})
    assert abs(m.stages[-1].getOrDefault("regParam") - 1 / (10.0 * train.count())) < 1e-12


def test_rows_without_score_count_in_the_cells(spark):
    rows = [(True, True, 0.9), (False, True, 0.8), (True, True, 0.7), (True, False, None)]
    df = spark.createDataFrame(rows, "y boolean, p boolean, s double")
    with_score, without = ev.metrics(df, "y", "p", "s").first(), ev.metrics(df, "y", "p").first()
    assert with_score["accuracy"] == without["accuracy"] == 0.5 and with_score["fn"] == 1


def test_margins_are_calibrated(spark, tmp_path):
    """A fitted probability beats the logistic of the margin, is saved with the model, and one class does no harm."""
    import random
    rng = random.Random(5)
    rows = []
    for i in range(600):
        x = rng.gauss(0, 1)
        rows.append((i, x, rng.choice("ab"), int(rng.random() < 1 / (1 + math.exp(-3 * x)))))
    df = spark.createDataFrame(rows, "id int, x double, c string, y int")
    model = mdl.train(df.where("id < 400"), "svc", ["x"], ["c"], target="y", key="id")
    test = df.where("id >= 400")
    scored = mdl.score(model, test, "id", "y").collect()
    raw = model.transform(test).select("id", "y", "rawPrediction").collect()

    def log_loss(pairs):
        return -sum(math.log(max(1e-12, p if y else 1 - p)) for p, y in pairs) / len(pairs)

    fitted = log_loss([(r["probability"], r["actual"]) for r in scored])
    fixed = log_loss([(1 / (1 + math.exp(-r["rawPrediction"][1])), r["y"]) for r in raw])
    assert fitted < fixed
    mdl.save_model(model, str(tmp_path / "m"))
    again = {r["id"]: r["probability"] for r in mdl.score(mdl.load_model(str(tmp_path / "m")), test, "id").collect()}
    assert again == {r["id"]: r["probability"] for r in scored}


def test_pooled_metrics_are_not_means_of_folds(spark):
    rows = [(0, True, True, 0.9), (0, False, True, 0.8), (1, True, False, 0.1), (1, False, False, 0.2), (1, True, True, 0.7), (1, True, True, 0.6)]
    df = spark.createDataFrame(rows, "fold int, actual boolean, predicted boolean, score double")
    got = {r["of"]: r for r in ev.pooled_metrics(df, "fold", "actual", "predicted", "score").collect()}
    assert got["pooled"]["accuracy"] == pytest.approx(4 / 6) and got["mean of folds"]["accuracy"] == pytest.approx((0.5 + 0.75) / 2)


def test_loss_history_of_boosted_trees_falls(spark):
    df = spark.range(200).select("id", (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 10 > 4).cast("int").alias("y"))
    m = mdl.train(df, "xgboost", ["x"], target="y", key="id", params={"maxIter": 5, "stepSize": 0.3})
    loss = [r["loss"] for r in mdl.loss_history(m, df, "y").orderBy("iteration").collect()]
    assert len(loss) == 5 and loss == sorted(loss, reverse=True)
    with pytest.raises(ValueError):
        mdl.loss_history(m)
