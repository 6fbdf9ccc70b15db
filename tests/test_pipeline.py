"""End-to-end passenger preparation (3.1 / 3.4) on a small generated fixture."""

import random

import pytest
from pyspark.sql import functions as F

from prepflow.operators import impute as imp
from prepflow.plans import pipeline as pl
from prepflow.sources.io import PASSENGER_SCHEMA

PLANETS, DESTS, DECKS = ["Earth", "Europa", "Mars"], ["TRAPPIST-1e", "PSO J318.5-22", "55 Cancri e"], "ABCDEFGT"


def passengers(spark, n=120, seed=1, with_target=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        grp, member = i // 2 + 1, i % 2 + 1

        def maybe(v):
            return None if rng.random() < 0.1 else v
        costs = [maybe(float(rng.choice([0, 0, 10, 250]))) for _ in range(5)]
        row = [f"{grp:04d}_{member:02d}", maybe(rng.choice(PLANETS)), maybe(rng.random() < 0.3),
               maybe(f"{rng.choice(DECKS)}/{rng.randint(0, 1800)}/{rng.choice('PS')}"), maybe(rng.choice(DESTS)),
               maybe(float(rng.randint(1, 70))), maybe(rng.random() < 0.05), *costs,
               maybe(f"N{i} S{grp}")]
        if with_target:
            row.append(rng.random() < 0.5)
        rows.append(tuple(row))
    schema = PASSENGER_SCHEMA if with_target else \
        type(PASSENGER_SCHEMA)(PASSENGER_SCHEMA.fields[:-1])
    return spark.createDataFrame(rows, schema)


IMPUTED = ["HomePlanet", "CryoSleep", "Destination", "VIP", "Deck", "Side", "Age", "NumZone",
           "RoomService", "FoodCourt", "ShoppingMall", "Spa", "VRDeck"]


def test_holdout_prepare_no_nulls(spark):
    p = pl.prepare(passengers(spark), mode="holdout")
    tree = p.tree
    for c in IMPUTED:
        assert tree.where(F.col(c).isNull()).count() == 0, c
    assert {r["split"] for r in tree.select("split").distinct().collect()} == {"train", "test"}
    assert "Group" not in tree.columns and "TotalSpending" in tree.columns
    nn_cols = set(p.nn.columns)
    assert any(c.startswith("HomePlanet_") for c in nn_cols) and "HomePlanet" not in nn_cols


def test_kfold_prepare_covers_each_row_once_as_test(spark):
    p = pl.prepare(passengers(spark, 60), mode="kfold", k=3)
    t = p.tree.where(F.col("split") == "test")
    assert t.count() == 60 and t.select("PassengerId").distinct().count() == 60


def test_full_prepare(spark):
    p = pl.prepare(passengers(spark, 80), passengers(spark, 30, seed=2, with_target=False), mode="full")
    test = p.tree.where(F.col("split") == "test")
    assert test.count() == 30
    for c in IMPUTED:
        assert test.where(F.col(c).isNull()).count() == 0, c


@pytest.mark.parametrize("name", ["passenger_full", "passenger_kfold"])
def test_queries_of_modes_train_the_zone_forest(spark, monkeypatch, name):
    from prepflow.plans import catalog  # noqa: F401
    from prepflow.plans.registry import REGISTRY
    configs = []

    def prepare(*args, impute_config=imp.ImputeConfig(), **kwargs):
        configs.append(impute_config)
        return pl.Prepared(args[0], args[0])

    monkeypatch.setattr(pl, "prepare", prepare)
    REGISTRY[name].fn(spark, "/root/testdata/sf0.001")
    assert configs == [imp.ImputeConfig()] and configs[0].zone_model is not None
