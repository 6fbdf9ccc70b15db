"""Model training, tuning and scoring on Spark ML.

The reference trains six single-machine libraries.  Here every model is a
``pyspark.ml`` ``Pipeline``: categorical columns go through ``StringIndexer``
(alphabetical, unseen -> extra index), numbers and indices are assembled
into one vector, and one distributed classifier is fitted; linear and network
presets get their categories one-hot encoded and all inputs standardised.
Presets carry the reference's hyper-parameters where Spark has a counterpart,
and nothing bounds them: a caller who wants fewer boosting rounds says so in
``params``.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import q
from . import boosting
from . import evaluate as ev
from . import forest_rows
from . import split as sp
from .encode import ordinal_indexers
from .state import ROWS_PER_SUMMING_TASK, ROWS_PER_TASK, balanced_for_training, freeze


@dataclass(frozen=True)
class Preset:
    name: str
    kind: str                      # gbt | rf | svc | mlp | lr
    params: dict = field(default_factory=dict)
    scale: bool = False            # one-hot categories, then standardise (svc, mlp)
    early_stop_fraction: float | None = None  # rows withheld to stop early; off unless a caller asks for it


# Hyper-parameters of the reference's models, mapped to Spark ML names.
PRESETS: dict[str, Preset] = {
    # boosted trees, first configuration: 1500 trees, lr 0.01, depth 5, rows 0.8, columns 0.7, gamma 0.05
    "xgboost": Preset("xgboost", "gbt", dict(maxIter=1500, stepSize=0.01, maxDepth=5, subsamplingRate=0.8,
                                              featureSubsetStrategy="0.7", minInfoGain=0.05, seed=42)),
    # boosted trees, search base: 3500 trees, lr 0.02, depth 5, rows 0.9, columns 0.85, gamma 0.05
    "xgboost_search": Preset("xgboost_search", "gbt", dict(maxIter=3500, stepSize=0.02, maxDepth=5,
                                                            subsamplingRate=0.9, featureSubsetStrategy="0.85",
                                                            minInfoGain=0.05, seed=42)),
    # ordered boosting preset: 1400 iterations, lr 0.035, depth 5, Bernoulli 0.8, rsm 0.85
    "catboost": Preset("catboost", "gbt", dict(maxIter=1400, stepSize=0.035, maxDepth=5, subsamplingRate=0.8,
                                                featureSubsetStrategy="0.85", seed=42)),
    # leaf-wise boosting preset: 300 trees, lr 0.05, depth 7
    "lightgbm": Preset("lightgbm", "gbt", dict(maxIter=300, stepSize=0.05, maxDepth=7, seed=42)),
    # random forest: 300 trees, depth 10, min leaf 2.  Many trees grow together:
    # 1 GiB of node histograms per pass means fewer passes over the data, and
    # cached node ids avoid shipping the whole forest to executors per level
    # (the cache is checkpointed into the shared checkpoint folder).
    "random_forest": Preset("random_forest", "rf", dict(numTrees=300, maxDepth=10, minInstancesPerNode=2,
                                                         seed=42, maxMemoryInMB=1024, cacheNodeIds=True)),
    # support-vector classifier (linear kernel on standardised features), C = 10; Spark averages
    # the hinge loss where C weighs its sum, so regParam is 1 / (C * rows), set when rows are known
    "svc": Preset("svc", "svc", dict(C=10.0, maxIter=100), scale=True),
    # multilayer network 128-64-32 with two outputs, early stop by tolerance; L-BFGS has no learning rate
    "mlp": Preset("mlp", "mlp", dict(hidden=(128, 64, 32), maxIter=200, tol=1e-3, seed=42), scale=True),
    "logistic": Preset("logistic", "lr", dict(maxIter=100, regParam=0.0)),
}

# Search spaces of the reference (names mapped to Spark ML).  Without a counterpart in
# Spark: leaf counts, minimum rows to split, unlimited depth, L1 / L2 leaf penalties, kernels and their widths.
SEARCH_SPACES: dict[str, dict[str, list]] = {
    "lightgbm": {"maxDepth": [5, 7], "stepSize": [0.01, 0.05, 0.1], "maxIter": [100, 300, 500]},
    "random_forest": {"numTrees": [100, 300, 500], "maxDepth": [10, 20],
                      "minInstancesPerNode": [1, 2, 4]},
    "svc": {"C": [0.1, 1.0, 10.0, 100.0]},
    "xgboost_search": {"maxIter": [1500, 2500, 3500, 4500], "stepSize": [0.01, 0.02, 0.05, 0.1],
                       "maxDepth": [3, 4, 5, 7], "minInstancesPerNode": [1, 3, 5],
                       "minInfoGain": [0.0, 0.05, 0.1, 0.2], "subsamplingRate": [0.7, 0.8, 0.9, 1.0],
                       "featureSubsetStrategy": ["0.7", "0.85", "0.9", "1.0"]},
}


@dataclass(frozen=True)
class Shape:
    """What a classifier must know of its training rows: their number and the categories of each column."""

    rows: int
    categories: tuple[int, ...] = ()


def data_shape(df: DataFrame, categorical: Sequence[str]) -> Shape:
    """Counted in one pass; one row reaches the driver."""
    r = df.agg(F.count(F.lit(1)), *[F.count_distinct(q(c).cast(T.StringType())) for c in categorical]).first()
    return Shape(r[0], tuple(r[1:]))


def _svc_regularisation(c: float, shape: Shape) -> float:
    return 1.0 / (c * max(1, shape.rows))


def _classifier(preset: Preset, n_features: int, shape: Shape, label: str, features: str,
                params: dict | None = None):
    from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                           MultilayerPerceptronClassifier, RandomForestClassifier)
    p = dict(preset.params)
    p.update(params or {})
    common = dict(featuresCol=features, labelCol=label)
    if preset.kind in ("gbt", "rf"):  # a split sees each category and the slot for unseen ones
        p.setdefault("maxBins", max(32, *(n + 1 for n in shape.categories)) if shape.categories else 32)
    if preset.kind == "gbt":
        if preset.early_stop_fraction:
            p["validationIndicatorCol"] = "__is_val"
        return GBTClassifier(**common, **p)
    if preset.kind == "rf":
        return RandomForestClassifier(**common, **p)
    if preset.kind == "svc":
        p["regParam"] = _svc_regularisation(p.pop("C"), shape)
        return LinearSVC(**common, **p)
    if preset.kind == "mlp":
        hidden = list(p.pop("hidden", (128, 64, 32)))
        return MultilayerPerceptronClassifier(**common, layers=[n_features, *hidden, 2], **p)
    if preset.kind == "lr":
        return LogisticRegression(**common, **p)
    raise ValueError(f"unknown model kind {preset.kind}")


def build_pipeline(preset: Preset, numeric: Sequence[str], categorical: Sequence[str] = (),
                   label: str = "label", shape: Shape = Shape(2),
                   params: dict | None = None) -> Pipeline:
    """P3 + C17 + C14 / C16 + C18 + classifier, as one Spark ML pipeline."""
    from pyspark.ml.feature import (ElementwiseProduct, Imputer, OneHotEncoder, SQLTransformer, StandardScaler,
                                    VectorAssembler)
    from pyspark.ml.linalg import Vectors
    # first stage: safe internal names for every feature (ML stages do not
    # accept names with dots, which one-hot outputs can carry); being a stage,
    # it is saved with the model and applied again at scoring time
    num_alias = [f"__n{i}" for i in range(len(numeric))]
    cat_alias = [f"__c{i}" for i in range(len(categorical))]

    def quoted(c: str) -> str:
        return "`" + c.replace("`", "``") + "`"
    renames = ", ".join(f"{quoted(c)} AS {a}" for c, a in zip([*numeric, *categorical], [*num_alias, *cat_alias]))
    stages = [SQLTransformer(statement=f"SELECT *{', ' + renames if renames else ''} FROM __THIS__")]
    stages += list(ordinal_indexers(cat_alias, "__idx"))
    inputs = num_alias + [f"{c}__idx" for c in cat_alias]
    n_features = len(inputs)
    if preset.scale:
        # linear and network models: no number for a category, no gap for a missing number
        if num_alias:
            stages.append(Imputer(inputCols=num_alias, outputCols=[f"{c}__full" for c in num_alias]))
        if cat_alias:
            stages.append(OneHotEncoder(inputCols=inputs[len(num_alias):], outputCols=[f"{c}__hot" for c in cat_alias],
                                        dropLast=False))
        inputs = [f"{c}__full" for c in num_alias] + [f"{c}__hot" for c in cat_alias]
        n_features = len(num_alias) + sum(n + 1 for n in shape.categories)
    stages.append(VectorAssembler(inputCols=inputs, outputCol="__features_raw", handleInvalid="keep"))
    feats = "__features_raw"
    if preset.scale:
        # Spark divides by the sample deviation; the factor makes it the population's
        stages.append(StandardScaler(inputCol=feats, outputCol="__features_std", withMean=True, withStd=True))
        factor = (shape.rows / max(1, shape.rows - 1)) ** 0.5
        stages.append(ElementwiseProduct(inputCol="__features_std", outputCol="__features",
                                         scalingVec=Vectors.dense([factor] * n_features)))
        feats = "__features"
    stages.append(_classifier(preset, n_features, shape, label, feats, params))
    return Pipeline(stages=stages)


def _with_label(df: DataFrame, target: str, label: str = "label") -> DataFrame:
    dtype = df.schema[target].dataType
    y = q(target).cast(T.DoubleType()) if not isinstance(dtype, T.StringType) \
        else (F.lower(q(target)) == "true").cast(T.DoubleType())
    return df.withColumn(label, y)


def train(df: DataFrame, preset: Preset | str, numeric: Sequence[str], categorical: Sequence[str] = (),
          target: str = "Transported", key: str | None = None, params: dict | None = None) -> PipelineModel:
    """M1-M7: fit a preset on ``df`` (the id column is never a feature)."""
    preset = PRESETS[preset] if isinstance(preset, str) else preset
    numeric = [c for c in numeric if c != key and c != target]
    categorical = [c for c in categorical if c != key and c != target]
    # the pipeline makes several passes (one per indexer, then the model):
    # keep only the used columns, cached for the duration of the fit
    data = balanced_for_training(_training_columns(df, preset, numeric, categorical, target, key), _rows_per_task(preset))
    try:
        pipeline = build_pipeline(preset, numeric, categorical, "label", data_shape(data, categorical), params)
        return _calibrated(pipeline, data) if preset.kind == "svc" else pipeline.fit(data)
    finally:
        data.unpersist()


def _rows_per_task(preset: Preset) -> int:
    """Linear margin models iterate hundreds of times over sums of all rows; trees and networks do much per row."""
    return ROWS_PER_SUMMING_TASK if preset.kind in ("svc", "lr") else ROWS_PER_TASK


CALIBRATION_FOLDS = 3


def _calibrated(pipeline: Pipeline, data: DataFrame) -> PipelineModel:
    """M6: a margin model with a fitted probability, as further stages of the model (saved and loaded with it).

    The logistic is fitted on out-of-fold margins: each row's margin comes from a model
    that did not train on it.  Rows are dealt to folds by a hash of their values.  Where
    some fold's training rows have one class only, margins are those of the model itself.
    The fits are independent and run side by side.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorSlicer
    fold = F.pmod(F.xxhash64(*[q(c) for c in data.columns if c != "label"]), F.lit(CALIBRATION_FOLDS))
    counts = {(r["fold"], r["label"]): r["count"] for r in data.groupBy(fold.alias("fold"), "label").count().collect()}
    labels = {label for _, label in counts}
    whole = all(any((f, x) in counts for f in range(CALIBRATION_FOLDS) if f != i) for i in range(CALIBRATION_FOLDS) for x in labels)
    slicer = VectorSlicer(inputCol="rawPrediction", outputCol="__margin", indices=[1])
    folds = range(CALIBRATION_FOLDS) if whole and len(labels) == 2 else ()
    with ThreadPoolExecutor(max_workers=1 + CALIBRATION_FOLDS) as pool:
        model, *others = pool.map(pipeline.fit, [data, *[data.where(fold != i) for i in folds]])
    if folds:
        parts = [slicer.transform(other.transform(data.where(fold == i))).select("__margin", "label") for i, other in zip(folds, others)]
        margins = parts[0]
        for p in parts[1:]:
            margins = margins.unionByName(p)
    else:
        margins = slicer.transform(model.transform(data)).select("__margin", "label")
    logistic = LogisticRegression(featuresCol="__margin", labelCol="label", probabilityCol="probability",
                                  rawPredictionCol="__calibrated", predictionCol="__calibrated_label").fit(margins)
    return PipelineModel([*model.stages, slicer, logistic])


def _training_columns(df: DataFrame, preset: Preset, numeric: Sequence[str], categorical: Sequence[str], target: str,
                      key: str | None, *more: str) -> DataFrame:
    data = _with_label(df, target)
    cols = [*numeric, *categorical, "label", *more]
    if preset.early_stop_fraction:
        draw = sp._u([key], "early-stop:42") if key is not None else F.rand(42)
        data = data.withColumn("__is_val", draw < F.lit(preset.early_stop_fraction))
        cols.append("__is_val")
    return data.select(*[q(c) for c in dict.fromkeys(cols)])


def positive_probability(scored: DataFrame, model: PipelineModel) -> F.Column:
    """Probability of the positive class; for margin models without a fitted one the logistic of the margin."""
    if "probability" in scored.columns:
        return vector_to_array(F.col("probability"))[1]
    margin = vector_to_array(F.col("rawPrediction"))[1]
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def score(model: PipelineModel, df: DataFrame, key: str | Sequence[str], target: str | None = None,
          threshold: float = 0.5) -> DataFrame:
    """``key, prediction (bool, p > threshold), probability[, actual]``."""
    if model is None:
        raise ValueError("model not trained")
    keys = [key] if isinstance(key, str) else list(key)
    out = model.transform(df)
    prob = positive_probability(out, model)
    cols = [*[q(k) for k in keys], (prob > threshold).alias("prediction"), prob.alias("probability")]
    if target is not None and target in df.columns:
        cols.append(_actual(df, target).alias("actual"))
    return out.select(*cols)


def _actual(df: DataFrame, target: str) -> F.Column:
    """The label as a boolean (P12 coercion for text labels)."""
    if isinstance(df.schema[target].dataType, T.StringType):
        return F.lower(q(target)) == "true"
    return q(target).cast(T.DoubleType()) > 0.5


@dataclass
class RunResult:
    scored: DataFrame              # key, prediction, probability, actual[, fold]
    metrics: DataFrame             # one row (pooled over folds in k-fold mode)
    fold_summary: DataFrame | None = None
    models: list = field(default_factory=list)


def run_model(df: DataFrame, preset: Preset | str, numeric: Sequence[str], categorical: Sequence[str] = (),
              target: str = "Transported", key: str = "PassengerId", mode: str = "holdout",
              test: DataFrame | None = None, test_size: float = 0.2, k: int = 5, seed: int = 42,
              params: dict | None = None, parallelism: int = 4, model_name: str | None = None) -> RunResult:
    """Holdout, k-fold (folds trained concurrently from a small thread
    pool, out-of-fold rows unioned: U2/S11) or full (train on ``df``, score
    ``test``: S9)."""
    preset = PRESETS[preset] if isinstance(preset, str) else preset
    name = model_name or preset.name
    if mode == "full":
        if test is None:
            raise ValueError("full mode needs a test table")
        m = train(df, preset, numeric, categorical, target, key, params)
        s = score(m, test, key, target if target in test.columns else None)
        met = ev.metrics(s, "actual", "prediction", "probability", model=name) if "actual" in s.columns \
            else None
        return RunResult(s, met, None, [m])
    if mode == "holdout":
        d = sp.holdout_split(df, key, test_size, seed)
        tr, te = d.where(F.col("split") == sp.TRAIN), d.where(F.col("split") == sp.TEST)
        m = train(tr, preset, numeric, categorical, target, key, params)
        s = score(m, te, key, target)
        return RunResult(s, ev.metrics(s, "actual", "prediction", "probability", model=name), None, [m])
    if mode == "kfold":
        d = freeze(sp.kfold(df, key, k, seed)).df

        def one(i: int):
            tr, te = sp.fold_frames(d, i)
            m = train(tr, preset, numeric, categorical, target, key, params)
            return m, score(m, te, key, target).withColumn("fold", F.lit(i))

        with ThreadPoolExecutor(max_workers=max(1, min(parallelism, k))) as pool:
            results = list(pool.map(one, range(k)))
        scored = results[0][1]
        for _, s in results[1:]:
            scored = scored.unionByName(s)
        pooled = ev.metrics(scored, "actual", "prediction", "probability", model=name)
        summary = ev.kfold_summary(scored, "fold", "actual", "prediction", "probability")
        return RunResult(scored, pooled, summary, [m for m, _ in results])
    raise ValueError(f"unknown mode {mode}")


# ---------------------------------------------------------------------- M8 / M9
def sample_combinations(space: dict[str, list], n: int, seed: int = 42,
                        first: dict | None = None) -> list[dict]:
    """Distinct random draws from a grid (all of it when smaller than ``n``);
    ``first`` is put in front (the manual configuration)."""
    grid = [dict(zip(space, vals)) for vals in product(*space.values())]
    rng = random.Random(seed)
    chosen = [first] if first else []
    pool = [g for g in grid if g != first]
    rng.shuffle(pool)
    for g in pool:
        if len(chosen) >= n:
            break
        chosen.append(g)
    return chosen


def random_search(df: DataFrame, preset: Preset | str, numeric: Sequence[str], categorical: Sequence[str],
                  target: str, key: str, space: dict[str, list] | None = None, n_iter: int = 10,
                  folds: int = 5, seed: int = 42, parallelism: int = 4, include_base: bool = False,
                  all_rounds: bool = False):
    """M8/M9: accuracy of sampled combinations over stratified folds (X3); returns ``(results, best_model)``.

    Boosted trees without early stop are trained once for all combinations that differ
    in rounds alone, and ``all_rounds`` adds to each combination the other rounds of the
    space (see ``boosting``).  Forests of two classes share trees among combinations that differ
    in depth or number of trees (see ``forest_rows``); other models go through ``CrossValidator(foldCol=...)``.

    ``results``: ``combination, params, accuracy, is_original, rank`` sorted by
    accuracy (ties to the lower index); with ``include_base`` the preset's
    own parameters are combination 0 and the verdict column tells whether a
    random draw beat it.
    """
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    preset = PRESETS[preset] if isinstance(preset, str) else preset
    space = space or SEARCH_SPACES.get(preset.name, {})
    base = {k: preset.params[k] for k in space if k in preset.params} if include_base else None
    combos = sample_combinations(space, n_iter, seed, base)
    prefixes = preset.kind == "gbt" and boosting.ROUNDS in space and not preset.early_stop_fraction
    if prefixes and all_rounds:
        combos = boosting.every_rounds(combos, space[boosting.ROUNDS])
    numeric = [c for c in numeric if c not in (key, target)]
    data = sp.stratified_kfold(_with_label(df, target), key, "label", folds, seed, col="__fold")
    data = balanced_for_training(_training_columns(data, preset, numeric, categorical, target, key, "__fold"), _rows_per_task(preset))
    try:
        shape = data_shape(data, categorical)
        pipe = build_pipeline(preset, numeric, categorical, "label", shape)
        clf = pipe.getStages()[-1]
        maps = []
        for c in combos:
            own = dict(c)
            if preset.kind == "svc" and "C" in own:
                own["regParam"] = _svc_regularisation(own.pop("C"), shape)
            maps.append({clf.getParam(k): v for k, v in own.items()})
        if prefixes:
            accuracies = boosting.fold_accuracies(data, pipe, combos, "__fold", folds, parallelism=parallelism)
            best = pipe.fit(data, maps[max(range(len(combos)), key=accuracies.__getitem__)])
        elif preset.kind == "rf" and forest_rows.grows(clf, data, combos, folds):
            accuracies = forest_rows.fold_accuracies(data, pipe, combos, "__fold", folds, parallelism)
            best = forest_rows.fit_forest(pipe, data, combos[max(range(len(combos)), key=accuracies.__getitem__)])
        else:
            cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps or ParamGridBuilder().build(), foldCol="__fold",
                                numFolds=folds, parallelism=parallelism, seed=seed,
                                evaluator=MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy"))
            model = cv.fit(data)
            accuracies, best = model.avgMetrics, model.bestModel
    finally:
        data.unpersist()
    spark = df.sparkSession
    rows = [(i, repr(sorted(c.items())), float(a), bool(include_base and i == 0))
            for i, (c, a) in enumerate(zip(combos, accuracies))]
    res = spark.createDataFrame(rows, "combination int, params string, accuracy double, is_original boolean")
    from pyspark.sql import Window
    ranked = res.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("accuracy"), "combination")))
    if include_base:
        best_is_base = ranked.where(F.col("rank") == 1).select((F.col("combination") == 0).alias("b"))
        ranked = ranked.withColumn("verdict", F.when(best_is_base.scalar(), F.lit("manual is best"))
                                   .otherwise(F.lit("random is better")))
    return ranked, best


# ---------------------------------------------------------------------- E9 / M12
def loss_history(model: PipelineModel, df: DataFrame | None = None, target: str | None = None) -> DataFrame | None:
    """``(iteration, loss)`` of the last stage.

    Networks and regressions record it while training.  Boosted trees are evaluated on
    ``df`` (training rows or others, with ``target``) after each round, in one pass.
    """
    last = model.stages[-1]
    if hasattr(last, "evaluateEachIteration"):
        if df is None or target is None:
            raise ValueError("the loss of boosted trees is that of given rows: pass df and target")
        rows = PipelineModel(model.stages[:-1]).transform(_with_label(df, target))
        hist = last.evaluateEachIteration(rows)
        return df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(hist)], "iteration int, loss double")
    summ = getattr(last, "summary", None) if getattr(last, "hasSummary", False) else None
    summ = summ() if callable(summ) else summ
    hist = getattr(summ, "objectiveHistory", None) if summ is not None else None
    if hist is None:
        return None
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(hist)], "iteration int, loss double")


def save_model(model: PipelineModel, path: str) -> None:
    """Persist a fitted pipeline (shared storage on a cluster)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def with_params(preset: Preset | str, **overrides) -> Preset:
    """M2: a preset with some parameters replaced."""
    preset = PRESETS[preset] if isinstance(preset, str) else preset
    return replace(preset, params={**preset.params, **overrides})
