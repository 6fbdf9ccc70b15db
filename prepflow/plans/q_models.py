"""Model queries (M1-M12, C11, E9, S9, S11, U2): not SQL-expressible, so they
have no oracle; the driver checks rows and schema, pytest checks invariants.

Training data: ``labels`` joined to ``documents`` with features computed from
the whole text (word, line, upper-case and digit counts), language and
source; the target is ``quality``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import impute as imp
from ..operators import models as mdl
from ..operators import split as sp
from .q_impute import ORDERS_IMPUTE
from . import sqlgen
from .registry import register
from .tables import load, orders_with_nulls

DOC_NUMERIC = ["n_chars", "n_words", "n_lines", "upper_share", "digit_share"]
DOC_CATEGORICAL = ["lang", "source"]


def doc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    lab = load(spark, sf_dir, "labels").select("doc_id", "quality")
    j = lab.join(d, "doc_id")
    length = F.length("text")
    n = F.greatest(length, F.lit(1)).cast(T.DoubleType())

    def count_of(chars: str):
        # characters of ``chars`` in the whole text: one translate, no regex
        return (length - F.length(F.translate("text", chars, ""))).cast(T.DoubleType())

    return j.select(
        "doc_id", "quality", "lang", "source",
        F.col("n_chars").cast(T.DoubleType()).alias("n_chars"),
        (count_of(" \t\n") + 1).alias("n_words"),
        (count_of("\n") + 1).alias("n_lines"),
        (count_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n).alias("upper_share"),
        (count_of("0123456789") / n).alias("digit_share"))


# The queries' own parameters: the presets' rounds at their rates take hours on small tables, as Spark
# grows boosted trees one after another.  Fewer rounds go with a rate in proportion.  ``passenger_model`` trains all.
FEW_ROUNDS = {"maxIter": 25, "stepSize": 0.3}


def _holdout(preset: str, params: dict | None = None):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = mdl.run_model(doc_features(spark, sf_dir), preset, DOC_NUMERIC, DOC_CATEGORICAL,
                          target="quality", key="doc_id", mode="holdout", params=params)
        return r.scored
    return q


register("model_gbt", "M1 M10 M11 F9 P3 C17")(_holdout("xgboost", FEW_ROUNDS))
register("model_catboost", "M3 M10 M11")(_holdout("catboost", FEW_ROUNDS))
register("model_lightgbm", "M4 M10 M11")(_holdout("lightgbm", FEW_ROUNDS))
register("model_forest", "M5 M10 M11")(_holdout("random_forest"))
register("model_svc", "M6 C14 C18 M10 M11")(_holdout("svc"))
register("model_mlp", "M7 C14 C18 M10 M11")(_holdout("mlp"))


@register("kfold_run", "M11 U2 O2 X2")
def q_kfold_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = mdl.run_model(doc_features(spark, sf_dir), "random_forest", DOC_NUMERIC, DOC_CATEGORICAL,
                      target="quality", key="doc_id", mode="kfold", k=5)
    return r.scored.orderBy("doc_id")


@register("full_submission", "M11")
def q_full_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sp.holdout_split(doc_features(spark, sf_dir), "doc_id", 0.2, seed=42)
    train = d.where(F.col("split") == sp.TRAIN).drop("split")
    test = d.where(F.col("split") == sp.TEST).drop("split", "quality")
    r = mdl.run_model(train, "logistic", DOC_NUMERIC, DOC_CATEGORICAL, target="quality", key="doc_id",
                      mode="full", test=test)
    return r.scored.select("doc_id", F.col("prediction").alias("quality_pred"))


@register("tune_search", "M8 X3 O3 O4")
def q_tune_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    res, _ = mdl.random_search(doc_features(spark, sf_dir), "random_forest", DOC_NUMERIC, DOC_CATEGORICAL,
                               target="quality", key="doc_id", n_iter=10, folds=5)
    return res


# The query's own space: the preset's, with rounds that small tables can pay for and rates in proportion.
# One fit serves all rounds of a combination.
FEW_ROUNDS_SPACE = {**mdl.SEARCH_SPACES["xgboost_search"], "maxIter": [5, 10, 15, 25], "stepSize": [0.1, 0.3]}


@register("kfold_search", "M9 M2 O3 O4")
def q_kfold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = mdl.with_params("xgboost_search", maxIter=10, stepSize=0.3)
    res, _ = mdl.random_search(doc_features(spark, sf_dir), base, DOC_NUMERIC, DOC_CATEGORICAL, target="quality",
                               key="doc_id", space=FEW_ROUNDS_SPACE, n_iter=5, folds=5, include_base=True, all_rounds=True)
    return res


@register("loss_history", "E9 M7")
def q_loss_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mdl.train(doc_features(spark, sf_dir), "mlp", DOC_NUMERIC, DOC_CATEGORICAL,
                  target="quality", key="doc_id", params={"maxIter": 60})
    return mdl.loss_history(m)


@register("loss_history_boosted", "E9 M1")
def q_loss_history_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = doc_features(spark, sf_dir)
    m = mdl.train(d, "xgboost", DOC_NUMERIC, DOC_CATEGORICAL, target="quality", key="doc_id", params=FEW_ROUNDS)
    return mdl.loss_history(m, d, "quality")


# ---------------------------------------------------------------------- what SQL can say of the models
_TEST_DOCS = f"""SELECT doc_id, quality = 1 AS actual FROM labels JOIN documents USING (doc_id)
WHERE {sqlgen.u('doc_id', sp.split_seed(42))} < 0.2"""
_CHECKED = ("random_forest", "svc", "mlp", "xgboost")
MODEL_INVARIANTS_SQL = f"WITH t AS ({_TEST_DOCS}) " + " UNION ALL ".join(
    f"SELECT '{m}' AS model, doc_id, actual, true AS in_range, true AS decided_at_half FROM t" for m in _CHECKED)


@register("model_invariants", "M1 M5 M6 M7 M10 M11 P3 F9", MODEL_INVARIANTS_SQL)
def q_model_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdout runs: every test row once, its true label, a probability, and a decision that follows from it."""
    d, out = doc_features(spark, sf_dir), None
    for name in _CHECKED:
        run = mdl.run_model(d, name, DOC_NUMERIC, DOC_CATEGORICAL, target="quality", key="doc_id", mode="holdout",
                            params=FEW_ROUNDS if name == "xgboost" else None)
        rows = run.scored.select(F.lit(name).alias("model"), "doc_id", "actual", F.col("probability").between(0.0, 1.0).alias("in_range"),
                                 (F.col("prediction") == (F.col("probability") > 0.5)).alias("decided_at_half"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("model_reuse", "M12 M10", f"SELECT doc_id, true AS same FROM ({_TEST_DOCS})")
def q_model_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved model, loaded again, gives every row the same probability (calibrated, so its stages are saved too)."""
    from ..sources import io
    d = sp.holdout_split(doc_features(spark, sf_dir), "doc_id", 0.2, seed=42)
    train, test = d.where(F.col("split") == sp.TRAIN), d.where(F.col("split") == sp.TEST)
    model = mdl.train(train, "svc", DOC_NUMERIC, DOC_CATEGORICAL, target="quality", key="doc_id")
    path = io.scratch_path(spark, "model")
    mdl.save_model(model, path)
    one = mdl.score(model, test, "doc_id").select("doc_id", F.col("probability").alias("p"))
    two = mdl.score(mdl.load_model(path), test, "doc_id").select(F.col("doc_id").alias("id"), F.col("probability").alias("r"))
    return one.join(two, F.col("doc_id") == F.col("id"), "left").select("doc_id", F.col("p").eqNullSafe(F.col("r")).alias("same"))


TUNE_RANKS_SQL = "SELECT CAST(range + 1 AS INTEGER) AS rank, CAST(1 AS BIGINT) AS n FROM range(4)"


@register("tune_ranks", "M8 X3 O3", TUNE_RANKS_SQL)
def q_tune_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search gives every combination one rank: the whole grid of the vector classifier."""
    res, _ = mdl.random_search(doc_features(spark, sf_dir), "svc", DOC_NUMERIC, DOC_CATEGORICAL, target="quality", key="doc_id",
                               n_iter=10, folds=3)
    return res.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


@register("random_forest_fill", "C11 C12 A6")
def q_random_forest_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = imp.ImputeConfig(**{**ORDERS_IMPUTE.__dict__,
                              "zone_model": imp.ZoneModelConfig(
                                  predictors=("o_orderstatus", "o_orderpriority", "c_mktsegment"))})
    v = sp.holdout_split(orders_with_nulls(spark, sf_dir), "o_orderkey", 0.2, seed=42)
    tr, te, _ = imp.fit_apply(v.where(F.col("split") == sp.TRAIN), v.where(F.col("split") == sp.TEST), cfg)
    return tr.unionByName(te).select("split", "o_orderkey", "order_month", "o_orderstatus",
                                     "o_orderpriority", "c_mktsegment")


# ------------------------------------------------------------------ end to end (3.1 + 3.2)
from . import pipeline as pl  # noqa: E402
from .tables import passengers, passengers_sql  # noqa: E402


@register("passenger_prepare", "C1 C2 C3 C4 C5 C6 C7 C8 C9 C10 C11 C12 C13 C14 C15 X1 P11")
def q_passenger_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's preparation flow (holdout mode) on the passenger view:
    composite split, rules, fit-on-train imputation with the zone forest,
    derived features, one-hot branch."""
    return pl.prepare(passengers(spark, sf_dir), mode="holdout").nn


_SPLIT = f"CASE WHEN {sqlgen.u('PassengerId', sp.split_seed(42))} < 0.2 THEN 'test' ELSE 'train' END"
_DOMAINS = {"HomePlanet": ("Earth", "Europa", "Mars"), "CryoSleep": ("False", "True"), "VIP": ("False", "True"), "Side": ("P", "S")}


def _prepared_facts(tree: DataFrame, *more: str) -> DataFrame:
    """Per row: NULLs among the filled columns, and whether the categories are known ones."""
    filled = [c for c in ("Age", "NumZone", *pl.CATEGORICAL) if c in tree.columns]
    known = F.lit(True)
    for c, values in _DOMAINS.items():
        known = known & F.col(c).isin(*values)
    return tree.select("PassengerId", "split", *more, sum((F.col(c).isNull().cast("int") for c in filled), F.lit(0)).alias("n_null"),
                       known.alias("in_domain"))


@register("passenger_facts", "C1 C11 C12 C13 C15 X1",
          f"SELECT PassengerId, {_SPLIT} AS split, 0 AS n_null, true AS in_domain FROM ({passengers_sql()})")
def q_passenger_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preparation with the forest, as far as SQL can say: every passenger once, nothing NULL, known categories."""
    return _prepared_facts(pl.prepare(passengers(spark, sf_dir), mode="holdout").tree)


@register("passenger_full_facts", "X4 C11 C12",
          f"SELECT PassengerId, {_SPLIT} AS split, 0 AS n_null, true AS in_domain FROM ({passengers_sql()})")
def q_passenger_full_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared_facts(q_passenger_full(spark, sf_dir))


@register("passenger_full", "X4 C1 C7 C8 C9 C10 C11 C12 C13 C14 C15 P11")
def q_passenger_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preparation in full mode, with the zone forest: fitted on one table, applied to another without labels."""
    d = sp.holdout_split(passengers(spark, sf_dir), "PassengerId", 0.2, seed=42)
    train = d.where(F.col("split") == sp.TRAIN).drop("split")
    test = d.where(F.col("split") == sp.TEST).drop("split", "Transported")
    return pl.prepare(train, test, mode="full").tree


@register("passenger_kfold", "X2 C1 C7 C8 C9 C10 C11 C12 C13 C14 C15 P11")
def q_passenger_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preparation in k-fold mode, with the zone forest, fitted anew on the training rows of each of three folds."""
    return pl.prepare(passengers(spark, sf_dir), mode="kfold", k=3).tree


@register("passenger_model", "M1 M11 E1 E3 E8 S12")
def q_passenger_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared tree branch -> boosted trees on the train split, all rounds of the preset at its
    rate -> metrics row on the test split (the reference's holdout model run)."""
    tree = pl.prepare(passengers(spark, sf_dir), mode="holdout").tree
    num, cat = pl.model_frame(tree)
    train = tree.where(F.col("split") == sp.TRAIN)
    test = tree.where(F.col("split") == sp.TEST)
    m = mdl.train(train, "xgboost", num, cat, target="Transported", key="PassengerId")
    scored = mdl.score(m, test, "PassengerId", "Transported")
    from ..operators import evaluate as ev
    return ev.metrics(scored, "actual", "prediction", "probability", model="xgboost").select(
        *ev.LEADERBOARD_COLUMNS)
