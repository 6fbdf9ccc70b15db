"""Rule mining between columns.

* R1 exclusion rules: value pairs of two categorical columns never seen
  together, within the values seen where both are non-null.  No cross join of
  rows: for each left value the missing right values are
  ``array_except(domain_right, seen_right)`` by bounded chunks of the domain,
  attached by an equi-join on the pair id.
* R2 cohesion: share of multi-row groups whose target is constant; purity is
  ``min = max`` so every statistic is a partial (map-side) aggregate, and all
  targets of one group key share one aggregation.
* R3 spending checks: filtered means, in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import q, row_sum, safe_ratio
from .prefix import ranks_by_range
from .reshape import drop_null_rows, require_columns
from .state import freeze

CHUNK = 1000  # values of a right domain in one row


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of each observed ``(a, b)`` pair, both non-null."""
    return df.where(q(a).isNotNull() & q(b).isNotNull()).groupBy(a, b).count()


def exclusion_rules(df: DataFrame, cols: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """``(column_a, value_a, column_b, value_b)`` never observed together.

    All column pairs are handled in one pass: rows are unpivoted to the distinct
    observed ``(pair, value_a, value_b)`` triples (de-duplicated map-side).  The right
    domain of a pair is numbered and cut into chunks; each left value is set against
    each chunk, and what it was not seen with in the chunk comes out.  So rows hold at
    most ``chunk`` values, and domains may have any number of them; the work is that
    of the rules found plus the seen pairs.
    """
    pairs = list(combinations(cols, 2))
    if not pairs:
        return df.sparkSession.createDataFrame(
            [], "column_a string, value_a string, column_b string, value_b string")
    seen = freeze(df.select(F.explode(F.array(*[
        F.when(q(a).isNotNull() & q(b).isNotNull(),
               F.struct(F.lit(i).alias("pair"), q(a).cast(T.StringType()).alias("va"),
                        q(b).cast(T.StringType()).alias("vb")))
        for i, (a, b) in enumerate(pairs)])).alias("s")).where(F.col("s").isNotNull()).select("s.*").distinct()).df
    right = ranks_by_range(seen.select("pair", "vb").distinct(), ["pair"], ["vb"], "place")
    right = freeze(right.withColumn("chunk", F.floor(F.col("place") / chunk)))
    chunks = right.df.groupBy("pair", "chunk").agg(F.collect_list("vb").alias("domain"))
    # (pair, left value, chunk): what was seen there
    left = seen.select("pair", "va").distinct().join(chunks, "pair")
    here = (seen.join(right.for_join(), ["pair", "vb"]).groupBy("pair", "va", "chunk")
            .agg(F.collect_list("vb").alias("known")))
    missing = left.join(here, ["pair", "va", "chunk"], "left").select(
        "pair", "va", F.explode(F.array_except("domain", F.coalesce("known", F.array().cast("array<string>")))).alias("vb"))
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    return missing.select(F.element_at(names, F.col("pair") + 1)["a"].alias("column_a"),
                          F.col("va").alias("value_a"),
                          F.element_at(names, F.col("pair") + 1)["b"].alias("column_b"),
                          F.col("vb").alias("value_b"))


def cohesion(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """R2: for each (group column, target column): among groups with more than
    one row having both non-null, the number and percentage whose target is
    constant.  ``group_col, target_col, n_groups, n_pure, pct_pure``.
    """
    require_columns(df, [c for pair in pairs for c in pair], "cohesion")
    by_group: dict[str, list[str]] = {}
    for g, t in pairs:
        by_group.setdefault(g, []).append(t)
    parts = []
    for g, targets in by_group.items():
        stats = []
        for i, t in enumerate(targets):
            x = q(t).cast(T.StringType())
            stats += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        per_group = drop_null_rows(df, [g]).groupBy(q(g)).agg(*stats)
        summary = per_group.agg(*[e for i in range(len(targets)) for e in (
            F.count_if(q(f"n{i}") > 1).alias(f"g{i}"),
            F.count_if((q(f"n{i}") > 1) & (q(f"lo{i}") == q(f"hi{i}"))).alias(f"p{i}"))])
        parts.append(summary.select(F.explode(F.array(*[
            F.struct(F.lit(g).alias("group_col"), F.lit(t).alias("target_col"),
                     q(f"g{i}").alias("n_groups"), q(f"p{i}").alias("n_pure"))
            for i, t in enumerate(targets)])).alias("s")).select("s.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("pct_pure", safe_ratio(F.col("n_pure") * F.lit(100.0), F.col("n_groups"), 0.0))


def multi_member_rows(df: DataFrame, group: str) -> DataFrame:
    """Rows whose group has more than one member (semi-join on the
    pre-aggregated group sizes)."""
    big = df.where(q(group).isNotNull()).groupBy(group).count().where(F.col("count") > 1).select(group)
    return df.join(big, group, "left_semi")


def spending_checks(df: DataFrame, cost_cols: Sequence[str], flag_cond, child_cond) -> DataFrame:
    """Mean total spend where ``flag_cond`` holds (and whether it is > 0),
    and mean total spend where ``child_cond`` holds; one aggregation."""
    total = row_sum(cost_cols)
    row = df.agg(F.avg(F.when(flag_cond, total)).alias("mean_spend_flagged"),
                 F.avg(F.when(child_cond, total)).alias("mean_spend_children"))
    return row.withColumn("flagged_spend_violation", F.coalesce(F.col("mean_spend_flagged") > 0, F.lit(False)))
