"""Global ranks and running sums without a single-partition window.

``Window.orderBy`` without ``partitionBy`` moves every row into one task.
Instead rows are cut into ordered buckets, each bucket's total is computed
by a grouped aggregation (at most ``buckets`` rows, a proven bound), turned
into offsets, and the rank / running sum inside each bucket is a window
partitioned by bucket.  Buckets are deterministic functions of the row, so
the two passes agree without persisting anything in between.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import q
from .state import freeze

ROW_BITS = 33  # of monotonically_increasing_id, below the partition
DEFAULT_BUCKETS = 1 << 18  # ~4M rows per window task at 10^12 rows; offsets table of a few MB


def _offsets(df: DataFrame, bucket: str, values: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Per (partition, bucket): the sums of ``values`` over all earlier buckets."""
    aggs = [F.count(F.lit(1)).alias("__cnt")] + [F.sum(v).alias(f"__s_{v}") for v in values]
    totals = df.groupBy(*partition_by, bucket).agg(*aggs)
    # the totals table has at most ``partitions x buckets`` rows
    w = Window.partitionBy(*partition_by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum("__cnt").over(w), F.lit(0)).alias("__off_cnt")]
    cols += [F.coalesce(F.sum(f"__s_{v}").over(w), F.lit(0)).alias(f"__off_{v}") for v in values]
    return totals.select(*partition_by, bucket, *cols)


def global_rank(df: DataFrame, bucket: Column, order: Sequence[Column], name: str = "rank",
                partition_by: Sequence[str] = (), buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """0-based rank of each row in the total order (``bucket``, then ``order``),
    counted separately inside each ``partition_by`` group.

    ``bucket`` must be a non-decreasing function of the order with values in
    ``[0, buckets)`` (e.g. ``floor(u * buckets)`` for a hash uniform ``u``).
    The order must be total (break ties with a unique key).  The offsets
    table, of one row per (partition key, bucket), joins on the keys of the
    window, so the rows are not moved again; small ones Spark broadcasts.
    """
    b = "__bucket"
    with_b = df.withColumn(b, F.least(F.greatest(bucket, F.lit(0)), F.lit(buckets - 1)))
    off = _offsets(with_b, b, [], partition_by)
    w = Window.partitionBy(*partition_by, b).orderBy(*order)
    ranked = with_b.join(off, [*partition_by, b], "left").withColumn(
        name, F.col("__off_cnt") + F.row_number().over(w) - 1)
    return ranked.drop(b, "__off_cnt")


def running_sums(df: DataFrame, bucket: Column, order: Sequence[Column], values: Sequence[str],
                 prefix: str = "cum_", partition_by: Sequence[str] = (),
                 buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Inclusive running sums of ``values`` along the total order, restarted
    inside each ``partition_by`` group.

    Rows must be unique in the order (aggregate duplicates first, as the ROC
    operator does per distinct score).  ``bucket`` as in :func:`global_rank`.
    """
    b = "__bucket"
    with_b = df.withColumn(b, F.least(F.greatest(bucket, F.lit(0)), F.lit(buckets - 1)))
    off = _offsets(with_b, b, values, partition_by)
    w = Window.partitionBy(*partition_by, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = with_b.join(off, [*partition_by, b], "left")
    out = out.withColumns({f"{prefix}{v}": q(f"__off_{v}") + F.sum(v).over(w) for v in values})
    return out.drop(b, "__off_cnt", *[f"__off_{v}" for v in values])


def ranks_by_range(df: DataFrame, partition_by: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """0-based rank of each row inside its ``partition_by`` group, for orders without buckets (such as strings).

    Rows are dealt to range partitions in the order of (``partition_by``, ``order``) and
    written there with their place; the counts per (partition, group) - a row each - give
    the offsets.  A group of any size is ranked by many tasks.
    """
    by = [*partition_by, *order]
    at = F.monotonically_increasing_id()
    rows = freeze(df.repartitionByRange(*map(q, by)).sortWithinPartitions(*map(q, by))
                  .withColumn("__part", F.shiftright(at, ROW_BITS))
                  .withColumn("__row", at.bitwiseAND(F.lit((1 << ROW_BITS) - 1)))).df
    names = [f"__g{i}" for i in range(len(partition_by))]
    counts = rows.groupBy(*[q(c).alias(n) for c, n in zip(partition_by, names)], F.col("__part").alias("__of")).agg(
        F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    earlier = Window.partitionBy(*names).orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    shift = freeze(counts.select(*names, "__of", (F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift")))
    same = F.col("__part") == F.col("__of")
    for c, n in zip(partition_by, names):
        same = same & q(c).eqNullSafe(F.col(n))
    ranked = rows.join(shift.for_join(), same).withColumn(name, F.col("__row") + F.col("__shift"))
    return ranked.select(*map(q, df.columns), q(name))
