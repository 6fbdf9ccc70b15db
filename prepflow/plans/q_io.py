"""Source / sink queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from ..operators import impute as imp
from ..operators import profile as prof
from ..operators import split as sp
from ..sources import io
from . import sqlgen
from .q_eval import LEADERBOARD_SQL, _rounded, scored
from ..operators.groups import with_group_stats
from .registry import register
from .tables import load, orders_with_nulls, orders_with_nulls_sql


@register("file_round_trip", "S1 S2 S3 S4 S5", "SELECT * FROM orders")
def q_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> CSV -> JSON -> Parquet, each read back natively with the declared schema."""
    o = load(spark, sf_dir, "orders")
    base = io.scratch_path(spark, "round-trip")
    io.write_table(o, f"{base}/orders.csv")
    back = io.read_table(spark, f"{base}/orders.csv", schema=o.schema)
    io.write_table(back, f"{base}/orders.JSON")
    back = io.read_table(spark, f"{base}/orders.JSON", schema=o.schema)
    io.write_table(back, f"{base}/orders.parquet")
    return io.read_table(spark, f"{base}/orders.parquet", schema=o.schema)


FOLD_DISCOVERY_SQL = f"""WITH f AS (
  SELECT CAST(least(floor({sqlgen.u('o_orderkey', sp.split_seed(42))} * 5), 4) AS INTEGER) AS fold
  FROM orders)
SELECT fold, count(*) AS n_test FROM f GROUP BY fold"""


@register("fold_discovery", "S6 S8 X2", FOLD_DISCOVERY_SQL)
def q_fold_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write k-fold splits partitioned by fold/split, rediscover the folds with test rows."""
    o = sp.kfold(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 5, seed=42)
    rows = o.withColumn("split", F.lit("test")).unionByName(
        o.withColumn("split", F.lit("train")).withColumn("fold", (F.col("fold") + 1) % 5))
    path = io.scratch_path(spark, "folds")
    io.write_splits(rows, path, by=("fold", "split"))
    return io.discover_folds(spark, path)


@register("fold_listing", "S6 S8 X2", FOLD_DISCOVERY_SQL.replace("fold, count(*) AS n_test", "fold"))
def q_fold_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same folds from the partition folders alone."""
    o = sp.kfold(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 5, seed=42)
    path = io.scratch_path(spark, "folds")
    io.write_splits(o.withColumn("split", F.lit("test")), path, by=("fold", "split"))
    return io.list_folds(spark, path)


BUCKETED_SQL = """SELECT o_orderkey, o_custkey, count(*) OVER g AS group_size, round(sum(o_totalprice) OVER g, 2) AS group_total,
       o_totalprice = max(o_totalprice) OVER g AS is_largest
FROM orders WINDOW g AS (PARTITION BY o_custkey)"""


@register("bucketed_groups", "S6 W1 A8 C8", BUCKETED_SQL)
def q_bucketed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group statistics over a bucketed table: neither they nor their join back shuffle."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    path = io.scratch_path(spark, "bucketed")
    table = io.write_bucketed(o, "prepflow_" + path.rsplit("-", 1)[-1], "o_custkey", 16, path)
    out = with_group_stats(table, "o_custkey", {"group_size": F.count(F.lit(1)), "group_total": F.sum("o_totalprice"),
                                                "largest": F.max("o_totalprice")})
    return out.select("o_orderkey", "o_custkey", "group_size", F.round("group_total", 2).alias("group_total"),
                      (F.col("o_totalprice") == F.col("largest")).alias("is_largest"))


# ------------------------------------------------------------------ sinks, each written and read back
@register("submission_sink", "S9 F9", "SELECT o_orderkey, o_totalprice > 150000 AS \"Transported\" FROM orders")
def q_submission_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") > 150000).alias("prediction"))
    path = io.scratch_path(spark, "submission")
    io.write_submission(o, path, key="o_orderkey")
    return spark.read.schema("o_orderkey bigint, Transported boolean").option("header", True).csv(path)


PREDICTIONS_SINK_SQL = f"""SELECT o_orderkey, CAST(least(floor({sqlgen.u('o_orderkey', sp.split_seed(42))} * 5), 4) AS INTEGER) AS fold,
       o_totalprice > 150000 AS prediction, o_totalprice AS probability FROM orders"""


@register("predictions_sink", "S10 S11 U2 O2", PREDICTIONS_SINK_SQL)
def q_predictions_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold rows of all folds, united, with the real id as row key."""
    o = io.with_row_key(load(spark, sf_dir, "orders"), "row_key", "o_orderkey").select(
        F.col("row_key").alias("o_orderkey"), (F.col("o_totalprice") > 150000).alias("prediction"),
        F.col("o_totalprice").alias("probability"))
    folds = sp.kfold(o, "o_orderkey", 5, seed=42)
    united = None
    for i in range(5):
        part = sp.fold_frames(folds, i)[1]
        united = part if united is None else united.unionByName(part)
    path = io.scratch_path(spark, "predictions")
    io.write_predictions(united, path, key="o_orderkey")
    return spark.read.parquet(path)


DICTIONARY_SINK_SQL = f"""WITH v AS ({orders_with_nulls_sql()})
SELECT 'o_orderstatus' AS feature, o_orderstatus AS value, count(*) AS n FROM v WHERE o_orderstatus IS NOT NULL GROUP BY 2
UNION ALL
SELECT 'c_mktsegment', c_mktsegment, count(*) FROM v WHERE c_mktsegment IS NOT NULL GROUP BY 2"""


@register("dictionary_sink", "S7 A4", DICTIONARY_SINK_SQL)
def q_dictionary_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = imp.frequency_dictionary(orders_with_nulls(spark, sf_dir), ["o_orderstatus", "c_mktsegment"])
    path = io.scratch_path(spark, "dictionaries")
    io.write_dictionaries(d, path)
    return spark.read.schema("feature string, value string, n bigint").json(path)


@register("leaderboard_sink", "S12 S13 E8", f"SELECT * EXCLUDE (run) FROM ({LEADERBOARD_SQL})")
def q_leaderboard_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs appended to the metrics table out of order; the board lists them in the session's order."""
    s = scored(spark, sf_dir)
    path, board = io.scratch_path(spark, "metrics"), io.scratch_path(spark, "board")
    io.append_metrics(ev.metrics(s, "actual", "predicted_b", "score_b", model="random_model"), path, 1)
    io.append_metrics(ev.metrics(s, "actual", "predicted", "score", model="score_model"), path, 0)
    io.write_leaderboard(spark, path, board)
    types = "Model string, accuracy double, precision double, recall double, f1 double, roc_auc double"
    return _rounded(spark.read.schema(types).option("header", True).csv(board))


_COLS = ("o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "c_mktsegment", "order_month")
_COMBO = "concat_ws(' | ', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in _COLS) + ")"
_MISSING = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in _COLS)
SUMMARY_SQL = f"""WITH v AS ({orders_with_nulls_sql()})
SELECT 'rows' AS section, '' AS item, count(*) AS n FROM v
""" + "".join(f"UNION ALL SELECT 'missing in column', '{c}', count_if({c} IS NULL) FROM v\n" for c in _COLS) + f"""
UNION ALL SELECT 'fields missing', CAST({_MISSING} AS VARCHAR), count(*) FROM v GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'combination', CASE WHEN {_COMBO} = '' THEN '{prof.NO_MISSING_LABEL}' ELSE {_COMBO} END AS item,
                                count(*) AS n FROM v GROUP BY 2 ORDER BY n DESC, item LIMIT 20)
""" + "".join(f"""UNION ALL SELECT 'missing together', '{a} | {b}', bool_or({a} IS NULL AND {b} IS NULL)::BIGINT FROM v
""" for a in _COLS for b in _COLS)


@register("missing_summary", "Q6 A3 Q1 Q2 Q3 Q4", SUMMARY_SQL)
def q_missing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text summary as lines: rows, missing fields per column, rows per number of missing fields, the
    most frequent combinations, and which columns are missing together."""
    parts = prof.summary(orders_with_nulls(spark, sf_dir), list(_COLS))

    def lines(section: str, df: DataFrame, item: str | None, n: str) -> DataFrame:
        return df.select(F.lit(section).alias("section"), (F.col(item).cast("string") if item else F.lit("")).alias("item"),
                         F.col(n).alias("n"))

    return (lines("rows", parts["shape"], None, "n_rows")
            .unionByName(lines("missing in column", parts["missing_per_column"], "column", "n_missing"))
            .unionByName(lines("fields missing", parts["missing_per_row"], "n_missing", "n_rows"))
            .unionByName(lines("combination", parts["top_combinations"], "missing_columns", "n_rows"))
            .unionByName(lines("missing together", parts["missing_together"].select(
                F.concat_ws(" | ", "column_a", "column_b").alias("pair"), F.col("both_missing").cast("long").alias("n")),
                "pair", "n")))


# ------------------------------------------------------------------ the passenger rules themselves
from ..functions.columns import normalise_bool, split_part  # noqa: E402
from ..operators.rules import PASSENGER_COSTS, apply_rules, homeplanet_rules, passenger_pre_rules  # noqa: E402
from .tables import passengers, passengers_sql  # noqa: E402

PASSENGER_RULES_SQL = f"""WITH p AS ({passengers_sql()}),
d AS (SELECT *, string_split(Cabin, '/')[1] AS Deck,
             {' + '.join(f'COALESCE({c}, 0)' for c in PASSENGER_COSTS)} AS total,
             CASE WHEN CryoSleep THEN 'True' WHEN NOT CryoSleep THEN 'False' END AS cryo,
             CASE WHEN VIP THEN 'True' WHEN NOT VIP THEN 'False' END AS vip_text FROM p),
r AS (SELECT *,
        COALESCE(cryo, CASE WHEN total = 0 THEN 'True' WHEN Deck IN ('T', 'G') THEN 'False'
                            WHEN total > 0 THEN 'False' END) AS cryo_out,
        COALESCE(vip_text, CASE WHEN Age < 18 THEN 'False' WHEN Deck IN ('G', 'T') THEN 'False'
                                WHEN HomePlanet = 'Earth' THEN 'False' END) AS vip_out FROM d)
SELECT PassengerId, cryo_out AS "CryoSleep", vip_out AS "VIP",
       COALESCE(HomePlanet, CASE WHEN Deck IN ('A', 'B', 'C', 'T') THEN 'Europa' WHEN Deck = 'G' THEN 'Earth'
                                 WHEN Deck = 'D' AND vip_out = 'True' THEN 'Europa' END) AS "HomePlanet",
       {', '.join(f"CASE WHEN {c} IS NULL AND Age < 13 THEN 0 WHEN {c} > 0 THEN 1 WHEN {c} = 0 THEN 0 END AS {c}" for c in PASSENGER_COSTS)}
FROM r"""


@register("passenger_rules", "C2 C3 C4 C5 C6 P11", PASSENGER_RULES_SQL)
def q_passenger_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passenger rule set on the passenger view; costs as 0 (none) and 1 (some)."""
    p = passengers(spark, sf_dir).withColumn("Deck", split_part("Cabin", "/", 0))
    p = p.withColumns({c: normalise_bool(p, c) for c in ("CryoSleep", "VIP")})
    p = apply_rules(p, passenger_pre_rules(p))
    p = apply_rules(p, homeplanet_rules())
    return p.select("PassengerId", "CryoSleep", "VIP", "HomePlanet",
                    *[F.when(F.col(c) > 0, 1).when(F.col(c) == 0, 0).alias(c) for c in PASSENGER_COSTS])
