"""Every number of rounds from one fit.

Boosting adds its trees one after another, so the first n trees of a long fit are the
model of n rounds: candidates of a search that differ in rounds alone share the longest
fit.  The trees between two wanted numbers form a segment, each segment is scored
once, and running sums of the segments' margins are the margins of the prefixes.  So all
of them cost one pass over the rows and each tree once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import SparkContext
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = "maxIter"


def segment(model: GBTClassificationModel, start: int, end: int) -> GBTClassificationModel:
    """Rounds ``start`` to ``end`` (from 0, end exclusive) as a model; segments' margins add up to the whole one's."""
    if not 0 <= start < end <= model.getNumTrees:
        raise ValueError(f"rounds {start} to {end} of {model.getNumTrees}")
    java, trees, weights = model._java_obj, model._java_obj.trees(), model.treeWeights
    context = SparkContext.getOrCreate()
    gateway, jvm = context._gateway, context._jvm
    some = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, end - start)
    shares = gateway.new_array(jvm.double, end - start)
    for i in range(start, end):
        some[i - start], shares[i - start] = trees[i], float(weights[i])
    part = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        f"{java.uid()}_{start}_{end}", some, shares))
    return part.setFeaturesCol(model.getFeaturesCol())


def with_margins(model: GBTClassificationModel, rows: DataFrame, rounds: Sequence[int], prefix: str = "__margin") -> DataFrame:
    """``rows`` with one column ``<prefix><n>`` for each n of ``rounds``: the margin after n rounds."""
    cuts, last = sorted(set(rounds)), None
    for start, end in zip([0, *cuts], cuts):
        raw = f"__raw{end}"
        part = segment(model, start, end).setRawPredictionCol(raw).setProbabilityCol("").setPredictionCol("")
        own = vector_to_array(F.col(raw))[1]
        rows = part.transform(rows).withColumn(f"{prefix}{end}", own if last is None else F.col(last) + own).drop(raw)
        last = f"{prefix}{end}"
    return rows


def accuracy_by_rounds(model: GBTClassificationModel, rows: DataFrame, rounds: Sequence[int], label: str = "label") -> dict[int, float]:
    """Share of right decisions after each of ``rounds``, in one pass; nan without rows."""
    cuts = sorted(set(rounds))
    right = [F.avg(((F.col(f"__margin{n}") > 0).cast("double") == F.col(label)).cast("double")) for n in cuts]
    values = with_margins(model, rows, cuts).agg(*[r.alias(f"a{n}") for r, n in zip(right, cuts)]).first()
    return {n: float("nan") if v is None else float(v) for n, v in zip(cuts, values)}


def by_longest_fit(combinations: Sequence[dict]) -> Iterator[tuple[dict, dict[int, int]]]:
    """(parameters without rounds, {index of combination: its rounds}) of combinations that differ in rounds alone."""
    groups: dict[tuple, dict[int, int]] = defaultdict(dict)
    for i, c in enumerate(combinations):
        groups[tuple(sorted((k, v) for k, v in c.items() if k != ROUNDS))][i] = c[ROUNDS]
    for key, members in groups.items():
        yield dict(key), members


def every_rounds(combinations: Sequence[dict], rounds: Sequence[int]) -> list[dict]:
    """The combinations, then each of them with the other numbers of rounds: these cost no fit of their own."""
    out = list(combinations)
    out += [{**c, ROUNDS: n} for c in combinations for n in rounds]
    return list({tuple(sorted(c.items())): c for c in out}.values())


def fold_accuracies(data: DataFrame, pipeline: Pipeline, combinations: Sequence[dict], fold: str, folds: int,
                    label: str = "label", parallelism: int = 4) -> list[float]:
    """Mean accuracy of each combination over the folds of column ``fold``.

    ``pipeline`` ends with a boosted classifier; its other stages are fitted once a fold, and of
    combinations that differ in rounds only the longest is trained.
    """
    *prepare, classifier = pipeline.getStages()
    groups = list(by_longest_fit(combinations))
    totals = [0.0] * len(combinations)

    def fit(train: DataFrame, test: DataFrame, own: dict, members: dict[int, int]) -> dict[int, float]:
        params = {**own, ROUNDS: max(members.values())}
        model = classifier.fit(train, {classifier.getParam(k): v for k, v in params.items()})
        found = accuracy_by_rounds(model, test, list(members.values()), label)
        return {i: found[n] for i, n in members.items()}

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        for i in range(folds):
            rows = data.where(F.col(fold) != i)
            prepared = Pipeline(stages=prepare).fit(rows)
            train, test = (prepared.transform(d).select(classifier.getFeaturesCol(), label)
                           for d in (rows, data.where(F.col(fold) == i)))
            train = train.persist()
            try:
                for found in pool.map(lambda g: fit(train, test, *g), groups):
                    for j, accuracy in found.items():
                        totals[j] += accuracy / folds
            finally:
                train.unpersist()
    return totals
