"""Bagged forests over counted combinations of categories (C11).

Rows with the same categories and label are the same training row.  A bootstrap draws
each row Poisson(1) times, so the n rows of a combination together are drawn Poisson(n)
times: every tree is grown by Spark ML on the combinations, weighted by its own draws.
The rows are counted once, and the trees cost what the combinations do.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q

CELLS_PER_TASK = 20_000
PARALLELISM = 8


def with_bootstraps(cells: DataFrame, keys: Sequence[str], count: str, trees: int, seed: int, out: str = "__draws") -> DataFrame:
    """``cells`` with an array of ``trees`` bootstrap counts: Poisson draws seeded by the combination's values."""
    cells = cells.withColumn("__cell", F.xxhash64(*[q(k) for k in keys]))
    schema = cells.drop("__cell").select("*", F.array().cast("array<double>").alias(out)).schema

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[out] = [np.random.default_rng([seed, int(c) & (2**64 - 1)]).poisson(n, trees).astype(float)
                      for c, n in zip(b.pop("__cell"), b[count])]
            yield b
    return cells.mapInPandas(draw, schema)


def fit_counted_forest(cells: DataFrame, prepare: Sequence, keys: Sequence[str], count: str, n_cells: int, features: str,
                       label: str, prediction: str, num_trees: int, max_depth: int, max_bins: int, seed: int,
                       max_memory_mb: int = 256) -> PipelineModel:
    """Random forest of ``cells``, one row per combination of ``keys`` that stands for ``count`` rows.

    The stages ``prepare`` give ``features`` and ``label``.  Spark allows no more bins
    than rows, so few combinations are cut into equal pieces, whose draws add up to theirs.
    """
    pieces = -(-max_bins // n_cells)
    drawn = with_bootstraps(cells, keys, count, num_trees, seed)
    prepared = Pipeline(stages=list(prepare)).fit(cells)
    train = prepared.transform(drawn).select(features, label, "__draws")
    if pieces > 1:
        train = train.withColumn("__piece", F.explode(F.sequence(F.lit(1), F.lit(pieces)))).drop("__piece")
    train = train.repartition(max(1, -(-n_cells * pieces // CELLS_PER_TASK))).persist()
    try:
        train.count()

        def tree(i: int):
            weight = F.col("__draws")[i] / F.lit(pieces)
            # the forest's share of features per split, also for one tree
            learner = RandomForestClassifier(featuresCol=features, labelCol=label, weightCol="__weight", numTrees=1, bootstrap=False,
                                             featureSubsetStrategy="sqrt" if num_trees > 1 else "all", maxDepth=max_depth,
                                             maxBins=max_bins, seed=seed + i, maxMemoryInMB=max_memory_mb)
            return learner.fit(train.select(features, label, weight.alias("__weight")))

        with ThreadPoolExecutor(max_workers=min(PARALLELISM, num_trees)) as pool:
            forest = joined_forest(list(pool.map(tree, range(num_trees))))
    finally:
        train.unpersist()
    return PipelineModel([*prepared.stages, forest.setFeaturesCol(features).setPredictionCol(prediction)])


def joined_forest(models: Sequence[RandomForestClassificationModel]) -> RandomForestClassificationModel:
    """One forest of the trees of ``models``."""
    context = SparkContext.getOrCreate()
    gateway, jvm = context._gateway, context._jvm
    trees = [t for m in models for t in m._java_obj.trees()]
    array = gateway.new_array(jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel, len(trees))
    for i, t in enumerate(trees):
        array[i] = t
    first = models[0]
    java = jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(
        f"{first.uid}_{len(trees)}", array, first.numFeatures, first.numClasses)
    return RandomForestClassificationModel(java.set(java.getParam("numTrees"), len(trees)))
