"""Radix selection, counted modes and alias tables against brute force."""

import math
import random
import statistics
import struct
from collections import Counter
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from prepflow.operators import alias, radix
from prepflow.operators import impute as imp
from prepflow.operators.groups import counted_modes

EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 2.0, math.nextafter(2.0, 0.0),
         math.nextafter(2.0, 3.0), 0.1, 1e300, 1.7976931348623157e308, float("inf"), float("-inf"), -1.5, 1 / 3, 2.0 ** 52 + 1]


def bits(x):
    n = struct.unpack(">q", struct.pack(">d", abs(x)))[0]
    return -n if x < 0 else n


def test_image_is_the_bits(spark):
    rng = random.Random(4)
    values = EDGES + [rng.uniform(-1, 1) * 10.0 ** rng.randint(-320, 308) for _ in range(3000)]
    values += [math.nextafter(2.0 ** e, d) for e in range(-1074, 1024, 7) for d in (0.0, math.inf)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r["i"]: r["x"] for r in df.select("i", radix.double_image(F.col("v")).alias("x")).collect()}
    assert all(got[i] == bits(v) for i, v in enumerate(values))
    odd = spark.sql("SELECT double('NaN') AS v UNION ALL SELECT NULL").select(radix.double_image(F.col("v")).alias("x"))
    assert sorted((r["x"] for r in odd.collect()), key=lambda x: x is None) == [radix.NOT_A_NUMBER, None]


def awkward(n=4000):
    """A hot key with values in a narrow range, one with few values, a NULL key, small keys."""
    rng = random.Random(9)
    rows = [("hot", 1.0 + rng.randint(0, 900) * 2.0 ** -52) for _ in range(n)]
    rows += [("wide", rng.choice(EDGES[:13])) for _ in range(300)]
    rows += [(None, rng.gauss(0, 1e6)) for _ in range(300)]
    rows += [(f"k{i}", rng.choice([None, float(i), -0.5])) for i in range(50)]
    return rows


@pytest.mark.parametrize("limit", [5, 64, 20_000])
def test_running_sums_at_any_depth(spark, limit):
    rows = awkward()
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    per = radix.counted(df, ["k"], "v", {"n": F.count(F.lit(1)), "w": F.sum(F.lit(3))})
    got = {(r["__k0"], r["__value"]): (r["n"], r["cum_n"], r["cum_w"], r["__all"]) for r in radix.running(per, limit).collect()}
    want = {}
    for k in {k for k, _ in rows}:
        counts = Counter(v + 0.0 for x, v in rows if x == k and v is not None)
        for v, upto in zip(sorted(counts), accumulate(counts[v] for v in sorted(counts))):
            want[k, v] = (counts[v], upto, 3 * upto, sum(counts.values()))
    assert got == want
    for level, cells in radix._leaves(per, limit):  # no window is larger than the limit
        sizes = per.joined(cells, level, []).groupBy("__k0", "__in").count()
        assert (sizes.agg(F.max("count")).first()[0] or 0) <= limit


@pytest.mark.parametrize("limit", [3, 20_000])
def test_medians_at_any_depth(spark, limit):
    rows = awkward(1501)
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    out = radix.exact_medians(df, ["k"], "v", limit=limit)
    want = {}
    for k in {k for k, _ in rows}:
        values = [v for x, v in rows if x == k and v is not None]
        if values:
            want[k] = statistics.median(values)
    assert {r["k"]: r["median"] for r in out.collect()} == want
    everything = radix.exact_medians(df, [], "v", limit=limit).collect()
    assert [r["median"] for r in everything] == [statistics.median(v for _, v in rows if v is not None)]
    assert radix.exact_medians(df.limit(0), ["k"], "v", limit=limit).collect() == []


def test_median_windows_stay_small_on_many_values(spark):
    """A million distinct values of one key: selection leaves one cell to order, of a bounded size."""
    df = spark.range(1_000_001).select(F.lit(1).alias("k"), (F.col("id") / 7.0).alias("v"))
    out = radix.exact_medians(df, ["k"], "v")
    assert out.first()["median"] == 500_000 / 7.0
    plan = out._jdf.queryExecution().toString()
    assert "approx" not in plan and "median(" not in plan and "percentile" not in plan


def test_modes_of_a_hot_group(spark):
    """A third of the rows in one group, a million values: counts are spread by value, no mode aggregate."""
    n = 1_000_000
    hot = spark.range(n).select(F.lit("hot").alias("g"), (F.col("id") % (n - 1)).alias("v"), F.lit("x").alias("s"))
    rest = spark.range(2 * n).select((F.col("id") % 1000).cast("string").alias("g"), F.pmod(F.hash("id"), F.lit(5)).cast("long").alias("v"),
                                     F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("s"))
    modes = counted_modes(hot.unionByName(rest), ["g"], ["v", "s"])
    plan = modes._jdf.queryExecution().toString()
    spread = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "__v0" in line]
    assert spread, plan
    assert modes.where("g = 'hot'").first().asDict() == {"g": "hot", "v": 0, "s": "x"}
    assert modes.count() == 1001


def test_modes_types_ties_and_nulls(spark):
    rows = [("a", 10.0, "y", True), ("a", 9.0, "x", None), ("a", None, None, False), (None, 1.0, "z", True), ("b", None, None, None)]
    df = spark.createDataFrame(rows, "g string, n double, s string, f boolean")
    got = {r["g"]: (r["n"], r["s"], r["f"]) for r in counted_modes(df, ["g"], ["n", "s", "f"]).collect()}
    assert got == {"a": (9.0, "x", False), None: (1.0, "z", True)}
    assert tuple(imp.global_mode(df, "n", "s").first()) == (1.0, "x")
    assert tuple(imp.global_mode(df.limit(0), "n").first()) == (None,)


@pytest.mark.parametrize("frequencies", [[5], [3, 3, 3], [1, 1, 7], [1] * 50 + [1000], [100, 90, 1, 1, 1, 1, 60],
                                         [random.Random(i).randint(1, 40) ** 3 for i in range(300)]])
def test_alias_tables_keep_every_weight(spark, frequencies):
    """What the slots keep and give away is, per category, exactly its count."""
    counts = spark.createDataFrame([("f", f"v{i}", n) for i, n in enumerate(frequencies)] + [("g", "only", 4)],
                                   "feature string, value string, n long")
    rows = [r for r in alias.alias_tables(counts).collect() if r["feature"] == "f"]
    k, total = len(frequencies), sum(frequencies)
    assert sorted(r["slot"] for r in rows) == list(range(k)) and all(r["k"] == k and r["total"] == total for r in rows)
    weight = Counter()
    for r in rows:
        assert 0 < r["keep"] <= total and (r["alias"] is None) == (r["keep"] == total)
        weight[r["value"]] += r["keep"]
        if r["alias"] is not None:
            weight[r["alias"]] += total - r["keep"]
    assert weight == Counter({f"v{i}": n * k for i, n in enumerate(frequencies)})


def test_alias_fill_shares_and_one_join(spark):
    n = 30_000
    df = spark.range(n).select(F.col("id").alias("k"),
                               F.when(F.col("id") % 3 > 0, F.when(F.col("id") % 5 == 0, "x").otherwise("y")).alias("v"),
                               F.when(F.col("id") % 2 == 0, (F.col("id") % 8).cast("int")).alias("w"), F.lit(None).cast("string").alias("e"))
    state = alias.fit_alias(imp.frequency_dictionary(df, ["v", "w", "e"]))
    out = alias.alias_fill(df, {"v": 42, "w": 43, "e": 44}, state, ["k"])
    assert out.columns == df.columns and out.schema["w"].dataType == df.schema["w"].dataType
    rows = out.collect()
    assert len(rows) == n and all(r["e"] is None for r in rows)  # no category: unchanged
    drawn = [r["v"] for r in rows if r["k"] % 3 == 0]
    assert abs(drawn.count("x") / len(drawn) - 0.2) < 0.02 and None not in drawn
    assert Counter(r["w"] for r in rows if r["k"] % 2).keys() == {0, 2, 4, 6}
    again = alias.alias_fill(df.repartition(7), {"v": 42, "w": 43, "e": 44}, state, ["k"]).collect()
    assert sorted(map(tuple, again), key=lambda r: r[0]) == sorted(map(tuple, rows), key=lambda r: r[0])
    joins = out._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins == 2  # with the tables of all features, and by row key


def test_complete_rows_are_not_joined(spark):
    """In the driver only rows with a NULL to fill meet a join; the statistics are of all rows."""
    cfg = imp.ImputeConfig(row_key=("id",), group_col="g", id_col=None, bool_cols=(), pre_rules=None, zero_fill=(),
                           cascade_target="x", cascade_keys=(), post_rules=None, zone_col=None, zone_model=None,
                           sample_features=("d",), no_group_mode=())
    rows = [(i, f"g{i % 3}", None if i == 4 else "AB"[i % 2], None if i == 7 else float(i)) for i in range(20)]
    out, _, _ = imp.fit_apply(spark.createDataFrame(rows, "id int, g string, d string, x double"), None, cfg)
    got = {r["id"]: (r["d"], r["x"]) for r in out.collect()}
    assert len(got) == 20 and got[4][0] == "B"
    assert got[7][1] == statistics.median([x for x in range(1, 20, 3) if x != 7])
    assert all(got[i] == ("AB"[i % 2], float(i)) for i in range(20) if i not in (4, 7))
