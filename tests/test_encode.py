"""Encodings (T4) and their invariants."""

import pytest
from pyspark.sql import functions as F

from prepflow.operators import encode as enc

T4_SCHEMA = ("Group string, Surnames string, HomePlanet string, CryoSleep string, Destination string, "
             "VIP string, Deck string, Side string, Age double")
CATS = ["HomePlanet", "CryoSleep", "Destination", "VIP", "Deck", "Side"]


def _t4(spark):
    train = spark.createDataFrame([
        ("0001", "Rossi", "Earth", "True", "TRAPPIST-1e", "False", "A", "P", 25.0),
        ("0002", "Bianchi", "Mars", "False", "PSO J318.5-22", "True", "B", "S", 30.0)], T4_SCHEMA)
    test = spark.createDataFrame([
        ("0003", "Verdi", "Plutone", "False", "TRAPPIST-1e", "False", "C", "P", 40.0)], T4_SCHEMA)
    return train, test


def test_t4_onehot_train_test(spark):
    train, test = _t4(spark)
    tr, te = enc.passthrough_encode(train), enc.passthrough_encode(test)
    state = enc.onehot_fit(tr, CATS)
    a, b = enc.onehot_apply(tr, state), enc.onehot_apply(te, state)
    assert "Group" not in a.columns and "Surnames" not in a.columns
    assert a.columns == b.columns
    row = b.first().asDict()
    assert all(row[c] == 0.0 for c in row if c.startswith("HomePlanet_") or c.startswith("Deck_"))
    assert row["Side_P"] == 1.0


def test_t4_drop_columns(spark):
    train, _ = _t4(spark)
    state = enc.onehot_fit(train, CATS)
    out = enc.onehot_apply(train, state, drop_columns=["CryoSleep_False", "VIP_False", "Side_S"])
    assert not {"CryoSleep_False", "VIP_False", "Side_S"} & set(out.columns)


def test_null_category_and_guard(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "c string")
    state = enc.onehot_fit(df, ["c"])
    assert state.categories["c"] == ["a", "b", enc.NULL_LABEL]
    state2 = enc.onehot_fit(df, ["c"], null_label=None)
    assert state2.categories["c"] == ["a", "b"]
    import pytest
    with pytest.raises(ValueError):
        enc.onehot_fit(spark.range(50).select(F.col("id").cast("string").alias("c")), ["c"], max_categories=10)


def test_dummy_drop_first_union(spark):
    train, test = _t4(spark)
    tr, te, state = enc.dummy_encode(train.select("HomePlanet", "Age"), test.select("HomePlanet", "Age"),
                                     ["HomePlanet"])
    assert state.categories["HomePlanet"] == ["Earth", "Mars", "Plutone"]
    assert tr.columns == ["Age", "HomePlanet_Mars", "HomePlanet_Plutone"] == te.columns
    assert te.first()["HomePlanet_Plutone"] == 1.0


def test_ordinal_unseen_and_null(spark):
    df = spark.createDataFrame([("b",), ("a",)], "c string")
    st = enc.ordinal_fit(df, ["c"])
    out = enc.ordinal_apply(spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string"), st, "_code")
    assert [r["c_code"] for r in out.collect()] == [0.0, 1.0, 2.0, 2.0]


def test_standardise_population_std_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    st = enc.standard_fit(df, ["x", "k"])
    out = enc.standard_apply(df, st).collect()
    assert [r["x"] for r in out] == [-1.0, 1.0]
    assert [r["k"] for r in out] == [0.0, 0.0]


def test_dotted_category_names_flow_downstream(spark):
    from prepflow.operators import correlate as cor, models as mdl
    df = spark.createDataFrame([(i, "PSO J318.5-22" if i % 3 else "Earth", float(i % 2 == 0), i % 2 == 0)
                                for i in range(40)], "k long, dest string, x double, y boolean")
    st = enc.onehot_fit(df, ["dest"])
    out = enc.onehot_apply(df, st)
    assert "dest_PSO J318.5-22" in out.columns
    corr = cor.target_correlation(out.withColumn("t", F.col("y").cast("int")), "t",
                                  ["x", "dest_PSO J318.5-22"], top=None)
    assert corr.count() == 2
    m = mdl.train(out, "logistic", ["x", "dest_PSO J318.5-22", "dest_Earth"], target="y", key="k")
    assert mdl.score(m, out, "k").count() == 40


def test_a_million_categories(spark):
    """No limit: codes by a join, sparse output; the wide form says what to use."""
    n = 1_000_000
    df = spark.range(n).select((F.col("id") * 7919 % n).cast("string").alias("c"), (F.col("id") % 3).cast("string").alias("d"))
    state = enc.fit_category_table(df, ["c", "d"])
    assert state.sizes == {"c": n, "d": 3}
    some = spark.createDataFrame([("0", "2"), ("999999", "1"), ("x", None), (None, "0"), ("500000", "9")], "c string, d string")
    order = {v: i for i, v in enumerate(sorted(map(str, range(n))))}
    codes = enc.ordinal_apply(some, state, suffix="_k", max_broadcast_rows=100)
    assert "BroadcastHashJoin" not in codes._jdf.queryExecution().sparkPlan().toString()
    assert {(r["c"], r["c_k"], r["d_k"]) for r in codes.collect()} == {
        ("0", 0.0, 2.0), ("999999", float(n - 1), 1.0), ("x", float(n), 3.0), (None, float(n), 0.0), ("500000", float(order["500000"]), 3.0)}
    active = {(r["c"], r["d"]): r["active"] for r in enc.sparse_indices(some, state).collect()}
    assert active == {("0", "2"): [0, n + 2], ("999999", "1"): [n - 1, n + 1], ("x", None): [], (None, "0"): [n], ("500000", "9"): [order["500000"]]}
    vectors = {(r["c"], r["d"]): r["features"] for r in enc.sparse_vector(some, state).collect()}
    assert all(v.size == n + 3 and list(v.toArray().nonzero()[0]) == active[k] for k, v in vectors.items())
    dropped = {(r["c"], r["d"]): r["active"] for r in enc.sparse_indices(some, state, drop_first=True).collect()}
    assert dropped[("0", "2")] == [n - 1 + 1] and dropped[("999999", "1")] == [n - 2, n - 1]
    with pytest.raises(ValueError, match="sparse"):
        enc.onehot_fit(df, ["c"])


def test_sparse_of_empty_and_constant_columns(spark):
    df = spark.createDataFrame([(None, "a", 1), (None, "a", 2)], "e string, k string, x int")
    state = enc.fit_category_table(df, ["e", "k", "absent"])
    assert state.sizes == {"e": 0, "k": 1}
    assert [r["active"] for r in enc.sparse_indices(df, state).collect()] == [[0], [0]]
    assert [r["active"] for r in enc.sparse_indices(df, state, drop_first=True).collect()] == [[], []]
    assert enc.sparse_vector(df, state).first()["features"].size == 1
    assert enc.ordinal_apply(df, state).first()["e"] == 0.0
