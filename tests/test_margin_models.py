"""Margin models iterate over few tasks, and their calibration fits run side by side (M6)."""

import threading

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from prepflow.operators import models as mdl


def test_few_tasks_and_fits_side_by_side(spark, monkeypatch):
    tasks, running, most, lock = [], [0], [0], threading.Lock()
    together = threading.Barrier(4)
    balanced, fit = mdl.balanced_for_training, Pipeline._fit

    def seen(*args):
        out = balanced(*args)
        tasks.append(out.rdd.getNumPartitions())
        return out

    def counted(self, dataset):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        try:
            together.wait(20)
        except threading.BrokenBarrierError:
            pass
        try:
            return fit(self, dataset)
        finally:
            with lock:
                running[0] -= 1
    monkeypatch.setattr(mdl, "balanced_for_training", seen)
    monkeypatch.setattr(Pipeline, "_fit", counted)
    df = spark.range(45_000).select("id", (F.col("id") % 101).cast("double").alias("x"), (F.hash("id") % 100 + F.col("id") % 101 > 40).alias("y"))
    m = mdl.train(df, "svc", ["x"], target="y", key="id", params={"maxIter": 3})
    assert tasks == [1] and most[0] == 4
    assert [type(s).__name__ for s in m.stages[-3:]] == ["LinearSVCModel", "VectorSlicer", "LogisticRegressionModel"]
