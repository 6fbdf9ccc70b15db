"""Composite split (T1) and derived features (T5)."""

from pyspark.sql import types as T

from prepflow.operators.features import split_composite, spend_features


def test_t1_composite_split(spark):
    df = spark.createDataFrame(
        [("0001_01", "B/1/S", "Mario Rossi", True),
         ("0002_01", "F/2/P", "Luigi Verdi", False),
         ("0002_02", "F/2/P", "Peach Rosa", True)],
        "PassengerId string, Cabin string, Name string, Transported boolean")
    out = split_composite(df, is_train=True, keep=["Num", "PassengerId"])
    assert "Cabin" not in out.columns
    assert out.columns[:2] == ["Group", "GroupSize"] and out.columns[-1] == "Transported"
    rows = {r["PassengerId"]: r for r in out.collect()}
    r1 = rows["0001_01"]
    assert (r1["Deck"], r1["Num"], r1["Side"], r1["GroupSize"]) == ("B", 1.0, "S", 1)
    assert rows["0002_01"]["GroupSize"] == 2 and rows["0002_02"]["GroupSize"] == 2
    assert r1["NumZone"] == 1.0 and r1["Names"] == "Mario"


def test_t1_default_drops(spark):
    df = spark.createDataFrame([("0001_01", "B/1/S", "Mario Rossi", True)],
                               "PassengerId string, Cabin string, Name string, Transported boolean")
    train = split_composite(df, is_train=True)
    test = split_composite(df.drop("Transported"), is_train=False)
    assert not {"PassengerId", "Cabin", "Name", "Num", "Surnames"} & set(train.columns)
    assert "PassengerId" in test.columns and "Transported" not in test.columns


def test_bins_left_closed_and_outside_null(spark):
    df = spark.createDataFrame([("0001_01", f"A/{n}/P", "A B") for n in (0, 199, 200, 1999, 2000)],
                               "PassengerId string, Cabin string, Name string")
    out = split_composite(df, is_train=False, keep=["Num"])
    got = {r["Num"]: r["NumZone"] for r in out.collect()}
    assert got == {0.0: 1.0, 199.0: 1.0, 200.0: 2.0, 1999.0: 10.0, 2000.0: None}


def test_t5_spend_features(spark):
    df = spark.createDataFrame(
        [("0001_01", "Mario", "Rossi", 100.0, 50.0, 0.0, 200.0, 0.0),
         ("0002_01", "Luigi", "Verdi", 0.0, 20.0, 0.0, 10.0, 50.0)],
        "PassengerId string, Names string, Surnames string, RoomService double, FoodCourt double, "
        "ShoppingMall double, Spa double, VRDeck double")
    out = spend_features(df)
    assert "Names" not in out.columns and "Surnames" in out.columns
    totals = {r["PassengerId"]: r["TotalSpending"] for r in out.collect()}
    assert totals == {"0001_01": 350.0, "0002_01": 80.0}
    assert dict(out.dtypes)["SpendingZero"] == "int"


def test_spend_all_null_is_zero(spark):
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in
                           ("RoomService", "FoodCourt", "ShoppingMall", "Spa", "VRDeck")])
    out = spend_features(spark.createDataFrame([(None,) * 5], schema)).first()
    assert out["TotalSpending"] == 0.0 and out["SpendingZero"] == 1 and out["HasLuxurySpending"] == 0
