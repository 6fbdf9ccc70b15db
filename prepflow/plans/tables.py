"""Loading of the driver tables and the shared derived views.

Views are written twice: as DataFrame code (used by the queries) and as SQL
text (used by the DuckDB oracles).  They read whole tables; nulls are
injected by a deterministic rule on the row key, which keeps every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ------------------------------------------------------------------ orders with nulls
# Null-injection rule (fixed): a field is NULL when o_orderkey is divisible by
# its modulus.  Rows are never removed.
ORDER_NULL_MODULI = {
    "o_orderstatus": 7,
    "o_orderpriority": 11,
    "o_totalprice": 5,
    "c_mktsegment": 13,
    "o_custkey": 17,
    "order_month": 19,
}


def orders_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders joined to its customer, with NULLs injected in five fields.

    Columns: o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
    o_totalprice, c_mktsegment, c_nationkey, n_regionkey, order_month.
    The customer/nation lookups are plain joins: Catalyst and AQE choose
    broadcast or sort-merge from the measured sizes.
    """
    o = load(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    j = (o.join(c, o.o_custkey == c.c_custkey, "left")
          .join(n, F.col("c_nationkey") == n.n_nationkey, "left"))
    k = F.col("o_orderkey")

    def nulled(name: str) -> F.Column:
        m = ORDER_NULL_MODULI[name]
        return F.when(k % m == 0, F.lit(None)).otherwise(F.col(name)).alias(name)

    return j.select(
        k,
        nulled("o_custkey"),
        nulled("o_orderstatus"),
        nulled("o_orderpriority"),
        nulled("o_totalprice"),
        nulled("c_mktsegment"),
        F.col("c_nationkey"),
        F.col("n_regionkey"),
        F.when(k % ORDER_NULL_MODULI["order_month"] == 0, F.lit(None))
         .otherwise(F.month("o_orderdate")).cast(T.IntegerType()).alias("order_month"),
    )


def orders_with_nulls_sql() -> str:
    def nulled(name: str) -> str:
        m = ORDER_NULL_MODULI[name]
        return f"CASE WHEN o_orderkey % {m} = 0 THEN NULL ELSE {name} END AS {name}"

    return f"""
    SELECT o_orderkey, {nulled('o_custkey')}, {nulled('o_orderstatus')}, {nulled('o_orderpriority')},
           {nulled('o_totalprice')}, {nulled('c_mktsegment')}, c_nationkey, n_regionkey,
           CAST(CASE WHEN o_orderkey % {ORDER_NULL_MODULI['order_month']} = 0 THEN NULL
                     ELSE month(o_orderdate) END AS INTEGER) AS order_month
    FROM orders
    LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey
    """


# ---------------------------------------------------------------- events spend view
EVENT_TYPES = ("view", "click", "purchase", "signup", "error")


def event_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event with the value moved into a per-type cost column
    (``cost_view`` ... ``cost_error``), NULL for the other four types."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return e.select("event_id", "user_id", "event_type",
                    *[F.when(F.col("event_type") == t, F.col("value")).alias(f"cost_{t}")
                      for t in EVENT_TYPES])


def event_costs_sql() -> str:
    cols = ", ".join(f"CASE WHEN event_type = '{t}' THEN value END AS cost_{t}" for t in EVENT_TYPES)
    return f"SELECT event_id, user_id, event_type, {cols} FROM events"


# ------------------------------------------------------------ passenger-shaped view
# Fixed mapping of driver values onto the passenger schema's domains.
SEGMENT_TO_PLANET = {"AUTOMOBILE": "Earth", "BUILDING": "Earth", "FURNITURE": "Europa",
                     "HOUSEHOLD": "Mars", "MACHINERY": "Mars"}
PRIORITY_TO_DESTINATION = {"1-URGENT": "55 Cancri e", "2-HIGH": "PSO J318.5-22", "3-MEDIUM": "TRAPPIST-1e",
                           "4-NOT SPECIFIED": "TRAPPIST-1e", "5-LOW": "TRAPPIST-1e"}
DECKS = "ABCDEFGT"


def passengers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw passenger schema derived from orders, customer, nation and the
    order's line items (costs), one passenger per order, grouped by customer.

    Every field is a deterministic function of the source rows; each field
    but the id and the label is NULL when the order key is divisible by its
    own modulus.  The label, four lines or more, is no function of any feature.  The five costs come from one ``groupBy(l_orderkey)`` of
    lineitem (map-side partial sums) joined to orders.
    """
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                             "o_orderpriority")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal",
                                               "c_mktsegment")
    li = load(spark, sf_dir, "lineitem")
    rev = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    costs = li.groupBy("l_orderkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "R", rev).otherwise(0.0)).alias("RoomService"),
        F.sum(F.when(F.col("l_returnflag") == "A", rev).otherwise(0.0)).alias("FoodCourt"),
        F.sum(F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), rev)
              .otherwise(0.0)).alias("ShoppingMall"),
        F.sum(F.when(F.col("l_quantity") > 40, rev).otherwise(0.0)).alias("Spa"),
        F.sum(F.when(F.col("l_discount") >= 0.09, rev).otherwise(0.0)).alias("VRDeck"),
        F.count(F.lit(1)).alias("n_lines"))
    j = (o.join(c, o.o_custkey == c.c_custkey, "left")
          .join(costs, o.o_orderkey == costs.l_orderkey, "left"))
    k = F.col("o_orderkey")

    def nulled(expr, m: int):
        return F.when(k % m == 0, F.lit(None)).otherwise(expr)

    planet = F.create_map(*[F.lit(x) for kv in SEGMENT_TO_PLANET.items() for x in kv])
    dest = F.create_map(*[F.lit(x) for kv in PRIORITY_TO_DESTINATION.items() for x in kv])
    deck = F.substring(F.lit(DECKS), (F.col("c_nationkey") % len(DECKS) + 1).cast("int"), 1)
    cabin = F.concat_ws("/", deck, (k % 1900).cast("string"), F.when(k % 2 == 0, "P").otherwise("S"))
    return j.select(
        F.concat_ws("_", F.lpad(F.col("o_custkey").cast("string"), 6, "0"),
                    F.lpad(k.cast("string"), 8, "0")).alias("PassengerId"),
        nulled(F.element_at(planet, F.col("c_mktsegment")), 41).alias("HomePlanet"),
        nulled(F.col("o_orderstatus") == "F", 37).cast("boolean").alias("CryoSleep"),
        nulled(cabin, 43).alias("Cabin"),
        nulled(F.element_at(dest, F.col("o_orderpriority")), 47).alias("Destination"),
        nulled(F.abs(F.col("c_acctbal")) % 79 + 1, 53).cast("double").alias("Age"),
        nulled(F.col("o_totalprice") > 400000, 59).cast("boolean").alias("VIP"),
        *[nulled(F.col(cn), m).alias(cn) for cn, m in
          (("RoomService", 61), ("FoodCourt", 67), ("ShoppingMall", 71), ("Spa", 73), ("VRDeck", 79))],
        nulled(F.concat_ws(" ", F.concat(F.lit("N"), k.cast("string")),
                           F.regexp_replace("c_name", "#", "")), 83).alias("Name"),
        (F.coalesce("n_lines", F.lit(0)) >= 4).alias("Transported"))


def passengers_sql() -> str:
    """The columns of :func:`passengers` that rules read, as SQL text."""
    planet = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENT_TO_PLANET.items())
    rev = "l_extendedprice * (1 - l_discount)"
    costs = (("RoomService", "l_returnflag = 'R'", 61), ("FoodCourt", "l_returnflag = 'A'", 67),
             ("ShoppingMall", "l_returnflag = 'N' AND l_linestatus = 'O'", 71), ("Spa", "l_quantity > 40", 73),
             ("VRDeck", "l_discount >= 0.09", 79))
    sums = ", ".join(f"sum(CASE WHEN {cond} THEN {rev} ELSE 0.0 END) AS {name}" for name, cond, _ in costs)
    return f"""
SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') || '_' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS PassengerId,
       CASE WHEN o_orderkey % 41 <> 0 THEN CASE c_mktsegment {planet} END END AS HomePlanet,
       CASE WHEN o_orderkey % 37 <> 0 THEN o_orderstatus = 'F' END AS CryoSleep,
       CASE WHEN o_orderkey % 43 <> 0 THEN substr('{DECKS}', CAST(c_nationkey % {len(DECKS)} + 1 AS INTEGER), 1)
            || '/' || CAST(o_orderkey % 1900 AS VARCHAR) || '/' || CASE WHEN o_orderkey % 2 = 0 THEN 'P' ELSE 'S' END END AS Cabin,
       CASE WHEN o_orderkey % 53 <> 0 THEN CAST(abs(c_acctbal) % 79 + 1 AS DOUBLE) END AS Age,
       CASE WHEN o_orderkey % 59 <> 0 THEN o_totalprice > 400000 END AS VIP,
       {", ".join(f"CASE WHEN o_orderkey % {m} <> 0 THEN {name} END AS {name}" for name, _, m in costs)}
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN (SELECT l_orderkey, {sums} FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey"""
