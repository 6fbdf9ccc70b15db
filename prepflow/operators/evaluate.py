"""Classification evaluation.

* Counting metrics: one aggregation of ``count_if`` over the scored rows
  (map-side partial), optionally per fold / per model key.
* ROC-AUC, exact with ties averaged (Mann-Whitney): rows are first reduced to
  one row per distinct score (``groupBy`` with partial aggregation, so a
  score shared by a third of the rows costs nothing extra); the running
  count of negatives below each score comes from radix cells of the scores
  (``radix.py``), none of which holds more than a fixed number of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import q, safe_ratio
from ..session import ensure_checkpoint_dir
from . import radix


def _cells(actual: Column, predicted: Column) -> list[Column]:
    return [F.count_if(actual & predicted).alias("tp"), F.count_if(~actual & predicted).alias("fp"),
            F.count_if(actual & ~predicted).alias("fn"), F.count_if(~actual & ~predicted).alias("tn")]


def _bool(df: DataFrame, c: str | Column) -> Column:
    if isinstance(c, Column):
        return c
    dtype = df.schema[c].dataType
    if isinstance(dtype, T.BooleanType):
        return q(c)
    if isinstance(dtype, T.StringType):
        return F.lower(q(c)) == F.lit("true")
    return q(c).cast(T.DoubleType()) > 0.5 if isinstance(dtype, (T.FloatType, T.DoubleType)) \
        else q(c) != 0


def _ratios() -> list[Column]:
    tp, fp, fn, tn = (q(x) for x in ("tp", "fp", "fn", "tn"))
    precision = safe_ratio(tp, tp + fp)
    recall = safe_ratio(tp, tp + fn)
    return [safe_ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), precision.alias("precision"),
            recall.alias("recall"), safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def confusion_cells(df: DataFrame, actual: str | Column, predicted: str | Column,
                    keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn (per ``keys``)."""
    a, p = _bool(df, actual), _bool(df, predicted)
    return df.groupBy(*keys).agg(*_cells(a, p))


def confusion_matrix(df: DataFrame, actual: str | Column, predicted: str | Column) -> DataFrame:
    """The four cells ``(actual, predicted, n)``, zeros included."""
    c = confusion_cells(df, actual, predicted)
    return c.select(F.explode(F.array(
        F.struct(F.lit(False).alias("actual"), F.lit(False).alias("predicted"), F.col("tn").alias("n")),
        F.struct(F.lit(False).alias("actual"), F.lit(True).alias("predicted"), F.col("fp").alias("n")),
        F.struct(F.lit(True).alias("actual"), F.lit(False).alias("predicted"), F.col("fn").alias("n")),
        F.struct(F.lit(True).alias("actual"), F.lit(True).alias("predicted"), F.col("tp").alias("n")),
    )).alias("s")).select("s.*")


def per_score_counts(df: DataFrame, actual: str | Column, score: str, keys: Sequence[str] = (),
                     predicted: str | Column | None = None) -> DataFrame:
    """Rows reduced to one per (keys, distinct score[, predicted]) with ``pos`` / ``neg`` counts.

    Materialised with a reliable ``checkpoint()`` (shared checkpoint folder):
    the confusion cells, quantile, offset and window passes all read this
    small table instead of recomputing the scored rows, and it survives lost
    executors.  Rows without a score are kept as a group of their own: they count
    in the confusion cells; :func:`roc_table` leaves them out.
    """
    a = _bool(df, actual)
    extra = [_bool(df, predicted).alias("__pred")] if predicted is not None else []
    per = (df.groupBy(*keys, q(score).cast(T.DoubleType()).alias(score), *extra)
           .agg(F.count_if(a).alias("pos"), F.count_if(~a).alias("neg")))
    ensure_checkpoint_dir(df.sparkSession)
    return per.checkpoint(eager=True)


def roc_table(df: DataFrame, actual: str | Column, score: str, keys: Sequence[str] = (),
              per: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Per (keys, distinct score): pos, neg, and the running counts up to and below it.

    ``limit`` is the number of scores that one window orders at most (``radix.py``).
    """
    per = per if per is not None else per_score_counts(df, actual, score, keys)
    counts = radix.counted(per, keys, score, {"pos": F.sum("pos"), "neg": F.sum("neg")}, checkpoint=False)
    cum = radix.running(counts, limit)
    return cum.select(*counts.named(), F.col("__value").alias(score), "pos", "neg", "cum_pos", "cum_neg",
                      (F.col("cum_pos") - F.col("pos")).alias("pos_below"),
                      (F.col("cum_neg") - F.col("neg")).alias("neg_below"))


def roc_auc(df: DataFrame, actual: str | Column, score: str, keys: Sequence[str] = (),
            per: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Exact ROC-AUC with ties counted half (per ``keys``); NULL when a
    class is absent."""
    t = roc_table(df, actual, score, keys, per, limit)
    contrib = F.col("pos").cast(T.DoubleType()) * (F.col("neg_below") + F.col("neg") * F.lit(0.5))
    g = t.groupBy(*keys).agg(F.sum(contrib).alias("__u"), F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    return g.select(*keys, F.try_divide(F.col("__u"), F.col("__p").cast(T.DoubleType()) * F.col("__n"))
                    .alias("roc_auc"))


def roc_points(df: DataFrame, actual: str | Column, score: str, limit: int | None = None) -> DataFrame:
    """One point per distinct score used as threshold (``score >= t`` is
    positive): ``threshold, fpr, tpr``; the curve starts at (0, 0), where no row
    is positive and the threshold is NULL."""
    t = roc_table(df, actual, score, limit=limit)
    tot = t.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    tot_p = tot.select("p").scalar()
    tot_n = tot.select("n").scalar()
    points = t.select(q(score).cast(T.DoubleType()).alias("threshold"),
                      F.try_divide((tot_n - F.col("neg_below")).cast(T.DoubleType()), tot_n).alias("fpr"),
                      F.try_divide((tot_p - F.col("pos_below")).cast(T.DoubleType()), tot_p).alias("tpr"))
    start = df.sparkSession.range(1).select(F.lit(None).cast(T.DoubleType()).alias("threshold"),
                                            F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def metrics(df: DataFrame, actual: str | Column, predicted: str | Column, score: str | None = None,
            model: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """E1 + E3: accuracy, precision, recall, F1 (0 on zero division) and ROC-AUC
    (NULL without scores), per ``keys``; ``model`` adds a ``Model`` column."""
    if score is None:
        cells = confusion_cells(df, actual, predicted, keys)
    else:
        # one pass over the rows: counts per (keys, score, predicted), then
        # the cells and the AUC both come from that small table
        per = per_score_counts(df, actual, score, keys, predicted)
        p = F.col("__pred")
        cells = per.groupBy(*keys).agg(
            F.coalesce(F.sum(F.when(p, F.col("pos"))), F.lit(0)).alias("tp"),
            F.coalesce(F.sum(F.when(p, F.col("neg"))), F.lit(0)).alias("fp"),
            F.coalesce(F.sum(F.when(~p, F.col("pos"))), F.lit(0)).alias("fn"),
            F.coalesce(F.sum(F.when(~p, F.col("neg"))), F.lit(0)).alias("tn"))
    out = cells.select(*keys, *_ratios(), "tp", "fp", "fn", "tn")
    if score is not None:
        auc = roc_auc(df, actual, score, keys, per=per)
        out = out.join(auc, list(keys), "left") if keys else out.withColumn("roc_auc", auc.scalar())
    else:
        out = out.withColumn("roc_auc", F.lit(None).cast(T.DoubleType()))
    if model is not None:
        out = out.withColumn("Model", F.lit(model))
    return out


def pooled_metrics(df: DataFrame, fold: str, actual: str | Column, predicted: str | Column, score: str) -> DataFrame:
    """Metrics of all out-of-fold rows together, beside the means of the folds' own.

    ``of`` is ``pooled`` or ``mean of folds``; the two differ wherever folds differ.
    """
    cols = ["accuracy", "precision", "recall", "f1", "roc_auc"]
    pooled = metrics(df, actual, predicted, score).select(F.lit("pooled").alias("of"), *cols)
    folds = metrics(df, actual, predicted, score, keys=[fold]).agg(*[F.avg(c).alias(c) for c in cols])
    return pooled.unionByName(folds.select(F.lit("mean of folds").alias("of"), *cols))


def class_report(df: DataFrame, actual: str | Column, predicted: str | Column) -> DataFrame:
    """E5: per class ``precision, recall, f1, support``."""
    c = confusion_cells(df, actual, predicted)
    tp, fp, fn, tn = (q(x) for x in ("tp", "fp", "fn", "tn"))

    def row(label: bool, t, f_pos, f_neg):
        p, r = safe_ratio(t, t + f_pos), safe_ratio(t, t + f_neg)
        return F.struct(F.lit(label).alias("class"), p.alias("precision"), r.alias("recall"),
                        safe_ratio(2 * t, 2 * t + f_pos + f_neg).alias("f1"), (t + f_neg).alias("support"))

    return c.select(F.explode(F.array(row(False, tn, fn, fp), row(True, tp, fp, fn))).alias("s")).select("s.*")


def kfold_summary(df: DataFrame, fold: str, actual: str | Column, predicted: str | Column,
                  score: str | None = None) -> DataFrame:
    """E6 + A14 + A15: mean of each fold metric, population std of accuracy,
    summed and mean confusion cells, number of folds; one row."""
    per = metrics(df, actual, predicted, score, keys=[fold])
    return per.agg(F.count(F.lit(1)).alias("n_folds"),
                   F.avg("accuracy").alias("accuracy_mean"), F.stddev_pop("accuracy").alias("accuracy_std"),
                   F.avg("precision").alias("precision_mean"), F.avg("recall").alias("recall_mean"),
                   F.avg("f1").alias("f1_mean"), F.avg("roc_auc").alias("roc_auc_mean"),
                   F.sum("tp").alias("tp_sum"), F.sum("fp").alias("fp_sum"),
                   F.sum("fn").alias("fn_sum"), F.sum("tn").alias("tn_sum"),
                   *[F.avg(c).alias(f"{c}_mean") for c in ("tp", "fp", "fn", "tn")])


LEADERBOARD_COLUMNS = ("Model", "accuracy", "precision", "recall", "f1", "roc_auc")


def leaderboard(records: Sequence[DataFrame], sort: bool = False) -> DataFrame:
    """Metric rows of a session in run order (``run``), the fixed columns
    first; ``sort=True`` gives the view sorted by accuracy."""
    out = None
    for i, r in enumerate(records):
        row = r.select(*[c for c in LEADERBOARD_COLUMNS if c in r.columns]).withColumn("run", F.lit(i))
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    if out is None:
        raise ValueError("no records")
    return out.orderBy(F.desc("accuracy"), "run") if sort else out
