"""Fitted state tables.

A fitted operator keeps its state (dictionaries, medians by key, category
lists) as a small DataFrame.  ``freeze`` cuts its lineage with a reliable
``checkpoint()`` into the folder the cluster names in ``spark.checkpoint.dir``
(so applying the state never re-runs the training plan, and a lost executor
re-reads it from shared storage) and records its exact row count.  Joins with
the state broadcast it only when that count is within ``max_broadcast_rows``;
otherwise they stay ordinary shuffle joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q
from ..session import ensure_checkpoint_dir

DEFAULT_MAX_BROADCAST_ROWS = 1_000_000


@dataclass
class StateTable:
    df: DataFrame
    n_rows: int

    def for_join(self, max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
        return F.broadcast(self.df) if self.n_rows <= max_broadcast_rows else self.df


def freeze(df: DataFrame, checkpoint: bool = True) -> StateTable:
    """Materialise a small fitted table and count it."""
    if checkpoint:
        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
    return StateTable(df, df.count())


ROWS_PER_TASK = 20_000
# sums over all rows, once an iteration and without row samples: few rows per task make the tasks the cost
ROWS_PER_SUMMING_TASK = 200_000
MAX_TASKS = 4096


def balanced_for_training(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Persist a training frame, spread over one task per ``rows_per_task`` rows.

    Learners draw their row samples per partition, so rows are dealt by a hash of
    their values to a number of partitions that follows from the row count alone:
    the fitted model does not depend on the cluster or the files.  The caller
    unpersists the result.
    """
    df = df.persist()
    try:
        tasks = min(MAX_TASKS, max(1, -(-df.count() // rows_per_task)))
        key = F.xxhash64(*[q(c) for c in df.columns])
        spread = df.repartition(tasks, key).sortWithinPartitions(key).persist()
        spread.count()
    finally:
        df.unpersist()
    return spread
