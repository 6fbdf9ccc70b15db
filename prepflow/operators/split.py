"""Train/test and k-fold assignment.

The reference shuffles with a seeded generator over row positions; here a
row's side is a pure function of its key and the seed (``hash_uniform``), so
assignment is reproducible, independent of partitioning and survives lost
executors.  The result is *one* DataFrame with a ``split`` / ``fold`` column,
never a list of copies.

``exact=True`` reproduces the reference's sizes exactly (``ceil(n * t)`` test
rows; fold sizes differing by at most one) with a bucketed global rank of
``u`` (see ``prefix.py``): two aggregation passes, no single-task sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_uniform, q
from .prefix import DEFAULT_BUCKETS, global_rank

TRAIN, TEST = "train", "test"


def _u(keys: Sequence[str], seed: int | str):
    return hash_uniform(list(keys), seed)


def split_seed(seed: int) -> str:
    """Seed namespace of the split draws (independent of other draws)."""
    return f"split:{seed}"


def _rank_by_u(df: DataFrame, keys: Sequence[str], seed: int, partition_by: Sequence[str] = (),
               buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    u = _u(keys, split_seed(seed))
    with_u = df.withColumn("__u", u)
    order = [F.col("__u")] + [q(k) for k in keys]
    return global_rank(with_u, F.floor(F.col("__u") * buckets).cast("long"), order, "__rank",
                       partition_by=partition_by, buckets=buckets)


def holdout_split(df: DataFrame, row_key: Sequence[str] | str, test_size: float = 0.2, seed: int = 42,
                  exact: bool = False, group_key: str | None = None, col: str = "split") -> DataFrame:
    """Label each row ``train`` or ``test``; ``0 < test_size < 1``.

    ``group_key`` draws per group instead of per row, keeping groups whole.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must be in (0, 1)")
    keys = [row_key] if isinstance(row_key, str) else list(row_key)
    draw_keys = [group_key] if group_key else keys
    if exact and group_key:
        raise ValueError("exact sizes are counted in rows; they cannot be kept with whole groups")
    if not exact:
        side = F.when(_u(draw_keys, split_seed(seed)) < F.lit(test_size), F.lit(TEST)).otherwise(F.lit(TRAIN))
        return df.withColumn(col, side)
    n = df.agg(F.count(F.lit(1))).scalar()
    ranked = _rank_by_u(df, keys, seed)
    n_test = F.ceil(n * F.lit(test_size))
    return ranked.withColumn(col, F.when(F.col("__rank") < n_test, F.lit(TEST)).otherwise(F.lit(TRAIN))) \
                 .drop("__u", "__rank")


def kfold(df: DataFrame, row_key: Sequence[str] | str, k: int = 5, seed: int = 42, exact: bool = False,
          group_key: str | None = None, col: str = "fold") -> DataFrame:
    """Fold number ``0..k-1`` per row; each row is test in exactly one fold."""
    if k < 2:
        raise ValueError("k must be > 1")
    keys = [row_key] if isinstance(row_key, str) else list(row_key)
    draw_keys = [group_key] if group_key else keys
    if exact and group_key:
        raise ValueError("exact sizes are counted in rows; they cannot be kept with whole groups")
    if not exact:
        return df.withColumn(col, F.least(F.floor(_u(draw_keys, split_seed(seed)) * k), F.lit(k - 1)).cast("int"))
    ranked = _rank_by_u(df, keys, seed)
    return ranked.withColumn(col, (F.col("__rank") % k).cast("int")).drop("__u", "__rank")


def stratified_kfold(df: DataFrame, row_key: Sequence[str] | str, label: str, k: int = 5, seed: int = 42,
                     col: str = "fold") -> DataFrame:
    """Folds balanced inside each label value (rank within label, modulo k)."""
    keys = [row_key] if isinstance(row_key, str) else list(row_key)
    ranked = _rank_by_u(df, keys, seed, partition_by=[label])
    return ranked.withColumn(col, (F.col("__rank") % k).cast("int")).drop("__u", "__rank")


def fold_frames(df: DataFrame, fold: int, col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, test) views of one fold; filters, no copies."""
    return df.where(q(col) != fold), df.where(q(col) == fold)
