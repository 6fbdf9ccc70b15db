"""Evaluation queries (E1-E8, A14, A15, S12/S13 rows) on a deterministic scored view.

The scored view stands in for a model's output so the oracles stay exact:
``actual`` is ``l_returnflag = 'R'``; ``score`` mixes a hash draw with the
label (an informative model, scores on a 0.001 grid so ties occur);
``score_b`` is a pure draw on a 0.01 grid (an uninformative model).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import hash_uniform
from ..operators import evaluate as ev
from ..operators import split as sp
from . import sqlgen
from .registry import register
from .tables import load

KEYS = ["l_orderkey", "l_linenumber"]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").select(*KEYS, "l_returnflag")
    actual = F.col("l_returnflag") == "R"
    u = hash_uniform(KEYS, "score")
    ub = hash_uniform(KEYS, "score_b")
    score = F.floor((F.lit(0.7) * u + F.when(actual, F.lit(0.3)).otherwise(F.lit(0.0))) * 1000) / 1000.0
    score_b = F.floor(ub * 100) / 100.0
    return li.select(*KEYS, actual.alias("actual"), score.alias("score"), score_b.alias("score_b")) \
             .withColumn("predicted", F.col("score") > 0.5) \
             .withColumn("predicted_b", F.col("score_b") > 0.5)


SCORED_SQL = f"""s AS (
  SELECT l_orderkey, l_linenumber, (l_returnflag = 'R') AS actual,
    floor((0.7 * {sqlgen.u(KEYS, 'score')} + CASE WHEN l_returnflag = 'R' THEN 0.3 ELSE 0.0 END) * 1000) / 1000.0
      AS score,
    floor({sqlgen.u(KEYS, 'score_b')} * 100) / 100.0 AS score_b
  FROM lineitem),
s2 AS (SELECT *, score > 0.5 AS predicted, score_b > 0.5 AS predicted_b FROM s)"""


def _cells_sql(pred: str) -> str:
    return (f"count_if(actual AND {pred}) AS tp, count_if(NOT actual AND {pred}) AS fp, "
            f"count_if(actual AND NOT {pred}) AS fn, count_if(NOT actual AND NOT {pred}) AS tn")


def _ratios_sql() -> str:
    return ("COALESCE(CAST(tp + tn AS DOUBLE) / nullif(tp + fp + fn + tn, 0), 0.0) AS accuracy, "
            "COALESCE(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS precision, "
            "COALESCE(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS recall, "
            "COALESCE(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0.0) AS f1")


def _auc_sql(score: str, keys: str = "") -> str:
    """Subquery: (keys..., roc_auc) by the tie-averaged rank sum."""
    kcomma = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    grp = f"GROUP BY {keys}" if keys else ""
    return f"""(SELECT {kcomma} SUM(pos * (COALESCE(neg_below, 0) + 0.5 * neg)) /
                  (CAST(SUM(pos) AS DOUBLE) * SUM(neg)) AS roc_auc FROM (
        SELECT {kcomma} {score}, pos, neg,
               SUM(neg) OVER ({part}ORDER BY {score} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS neg_below
        FROM (SELECT {kcomma} {score}, count_if(actual) AS pos, count_if(NOT actual) AS neg FROM s2
              GROUP BY {kcomma} {score})) {grp})"""


# ---------------------------------------------------------------------- E2
@register("confusion", "E2 P12",
          f"WITH {SCORED_SQL}, c AS (SELECT {_cells_sql('predicted')} FROM s2) "
          "SELECT false AS actual, false AS predicted, tn AS n FROM c UNION ALL "
          "SELECT false, true, fp FROM c UNION ALL SELECT true, false, fn FROM c UNION ALL "
          "SELECT true, true, tp FROM c")
def q_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion_matrix(scored(spark, sf_dir), "actual", "predicted")


# ---------------------------------------------------------------------- E1 + E3 + E7
METRICS_SQL = f"""WITH {SCORED_SQL}, c AS (SELECT {_cells_sql('predicted')} FROM s2)
SELECT 'score_model' AS Model, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1, round((SELECT roc_auc FROM {_auc_sql('score')}), 6) AS roc_auc
FROM (SELECT {_ratios_sql()} FROM c)"""

_ROUND6 = ("accuracy", "precision", "recall", "f1", "roc_auc")


def _rounded(df: DataFrame, cols=_ROUND6) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@register("metrics", "E1 E3", METRICS_SQL)
def q_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ev.metrics(scored(spark, sf_dir), "actual", "predicted", "score", model="score_model")
    return _rounded(m.select("Model", *_ROUND6))


# ---------------------------------------------------------------------- E4
ROC_POINTS_SQL = f"""WITH {SCORED_SQL},
g AS (SELECT score, count_if(actual) AS pos, count_if(NOT actual) AS neg FROM s2 GROUP BY score),
r AS (SELECT score, pos, neg,
             COALESCE(SUM(pos) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb,
             COALESCE(SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
      FROM g),
t AS (SELECT SUM(pos) AS P, SUM(neg) AS N FROM g)
SELECT CAST(score AS DOUBLE) AS threshold, round(CAST(N - nb AS DOUBLE) / N, 9) AS fpr,
       round(CAST(P - pb AS DOUBLE) / P, 9) AS tpr FROM r, t
UNION ALL SELECT CAST(NULL AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE"""


@register("roc_points", "E4", ROC_POINTS_SQL)
def q_roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ev.roc_points(scored(spark, sf_dir), "actual", "score")
    return r.withColumns({"fpr": F.round("fpr", 9), "tpr": F.round("tpr", 9)})


# ---------------------------------------------------------------------- E5
CLASS_REPORT_SQL = f"""WITH {SCORED_SQL}, c AS (SELECT {_cells_sql('predicted')} FROM s2)
SELECT false AS class, round(COALESCE(CAST(tn AS DOUBLE) / nullif(tn + fn, 0), 0.0), 6) AS precision,
       round(COALESCE(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0.0), 6) AS recall,
       round(COALESCE(CAST(2 * tn AS DOUBLE) / nullif(2 * tn + fn + fp, 0), 0.0), 6) AS f1, tn + fp AS support
FROM c UNION ALL
SELECT true, round(COALESCE(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0), 6),
       round(COALESCE(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0), 6),
       round(COALESCE(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0.0), 6), tp + fn
FROM c"""


@register("class_report", "E5", CLASS_REPORT_SQL)
def q_class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ev.class_report(scored(spark, sf_dir), "actual", "predicted")
    return _rounded(r, ("precision", "recall", "f1"))


# ---------------------------------------------------------------------- E6 / A14 / A15
_FOLD_U = sqlgen.u(KEYS, sp.split_seed(42))
KFOLD_SUMMARY_SQL = f"""WITH {SCORED_SQL.replace('FROM s)', f', CAST(least(floor({_FOLD_U} * 5), 4) AS INTEGER) AS fold FROM s)')},
per AS (SELECT fold, tp, fp, fn, tn, {_ratios_sql()} FROM (SELECT fold, {_cells_sql('predicted')} FROM s2 GROUP BY fold)),
auc AS {_auc_sql('score', 'fold')}
SELECT count(*) AS n_folds, round(avg(accuracy), 6) AS accuracy_mean, round(stddev_pop(accuracy), 6) AS accuracy_std,
       round(avg(precision), 6) AS precision_mean, round(avg(recall), 6) AS recall_mean,
       round(avg(f1), 6) AS f1_mean, round(avg(roc_auc), 6) AS roc_auc_mean,
       CAST(sum(tp) AS BIGINT) AS tp_sum, CAST(sum(fp) AS BIGINT) AS fp_sum,
       CAST(sum(fn) AS BIGINT) AS fn_sum, CAST(sum(tn) AS BIGINT) AS tn_sum,
       round(avg(tp), 6) AS tp_mean, round(avg(fp), 6) AS fp_mean, round(avg(fn), 6) AS fn_mean, round(avg(tn), 6) AS tn_mean
FROM per JOIN auc USING (fold)"""


@register("kfold_summary", "E6 A14 A15 X2", KFOLD_SUMMARY_SQL)
def q_kfold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sp.kfold(scored(spark, sf_dir), KEYS, 5, seed=42)
    out = ev.kfold_summary(s, "fold", "actual", "predicted", "score")
    return out.withColumns({c: F.round(c, 6) for c in out.columns
                            if c.endswith("_mean") or c.endswith("_std")})


POOLED_SQL = f"""WITH {SCORED_SQL.replace('FROM s)', f', CAST(least(floor({_FOLD_U} * 5), 4) AS INTEGER) AS fold FROM s)')},
c AS (SELECT {_ratios_sql()} FROM (SELECT {_cells_sql('predicted')} FROM s2)),
per AS (SELECT fold, {_ratios_sql()} FROM (SELECT fold, {_cells_sql('predicted')} FROM s2 GROUP BY fold)),
auc AS {_auc_sql('score', 'fold')}
SELECT 'pooled' AS of, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, round((SELECT roc_auc FROM {_auc_sql('score')}), 6) AS roc_auc FROM c
UNION ALL
SELECT 'mean of folds', round(avg(accuracy), 6), round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       round(avg(roc_auc), 6) FROM per JOIN auc USING (fold)"""


@register("pooled_metrics", "E7 X2", POOLED_SQL)
def q_pooled_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sp.kfold(scored(spark, sf_dir), KEYS, 5, seed=42)
    return _rounded(ev.pooled_metrics(s, "fold", "actual", "predicted", "score"))


# ---------------------------------------------------------------------- E8 / S13
LEADERBOARD_SQL = f"""WITH {SCORED_SQL},
a AS (SELECT {_ratios_sql()} FROM (SELECT {_cells_sql('predicted')} FROM s2)),
b AS (SELECT {_ratios_sql()} FROM (SELECT {_cells_sql('predicted_b')} FROM s2))
SELECT 'score_model' AS Model, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1, round((SELECT roc_auc FROM {_auc_sql('score')}), 6) AS roc_auc,
       0 AS run FROM a
UNION ALL
SELECT 'random_model', round(accuracy, 6), round(precision, 6), round(recall, 6), round(f1, 6),
       round((SELECT roc_auc FROM {_auc_sql('score_b')}), 6), 1 FROM b"""


@register("leaderboard", "E8", LEADERBOARD_SQL)
def q_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    a = ev.metrics(s, "actual", "predicted", "score", model="score_model")
    b = ev.metrics(s, "actual", "predicted_b", "score_b", model="random_model")
    return _rounded(ev.leaderboard([a, b]))
