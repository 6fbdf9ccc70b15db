"""Ids that stay or go beyond what is broadcast: same rows, and texts stay where they are read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepflow.llm import common, membership, ngram_join
from prepflow.llm.membership import bitmap, may_hold, near, staying
from prepflow.llm.ngram_join import Similarity, keep_first, signatures


@pytest.mark.parametrize("spread", [1, 10 ** 14 + 7])
def test_bitmap_misses_no_id(spark, spread):
    ids = spark.range(0, 20_000, 2).select((F.col("id") * spread - 5_000).alias("id"))
    marks = bitmap(ids, 10_000)
    rows = spark.range(20_000).select(F.when(F.col("id") != 7, F.col("id") * spread - 5_000).alias("x"), (F.col("id") % 2 == 0).alias("there"))
    found = {r["there"]: r["n"] for r in rows.where(may_hold(marks, F.col("x"))).groupBy("there").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert found[True] == 10_000 and found.get(False, 0) < 600
    assert near(rows, F.col("x"), ids, 10_000, 100).count() < 10_600


@pytest.mark.parametrize("bound", [0, 10 ** 6])
def test_staying_settles_every_row(spark, bound, monkeypatch):
    monkeypatch.setattr(membership, "BITS_PER_ID", 1)  # full bitmaps: many rows are left to the join
    monkeypatch.setattr(membership, "LEAST_BITS", 6)
    verdicts = spark.range(3_000).select("id", (F.xxhash64("id") % 3 != 0).alias("stays"))
    df = spark.range(3_000).select(F.col("id").alias("id_"), F.lit("t").alias("stays")).union(spark.sql("SELECT CAST(NULL AS bigint), 'none'"))
    wanted = {r["id"] for r in verdicts.where("stays").collect()} | {None}
    got = [r["id_"] for r in staying(df, F.col("id_"), verdicts, bound).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


@pytest.mark.parametrize("repeated", [False, True])
def test_texts_are_not_joined_whole(spark, monkeypatch, repeated):
    """Beyond the bound of broadcasts, only texts that may link or are in doubt enter a join."""
    for f in [common.small_side, *[getattr(membership, n) for n in ("near", "staying")]]:
        monkeypatch.setattr(f, "__defaults__", (3,))
    rng = random.Random(4)
    rows = [(i, " ".join(str(rng.random()) for _ in range(60))) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " x") for i in range(12)] + ([(1, rows[399][1])] if repeated else [])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    entered, join = [], type(docs).join

    def counted(self, *args, **kw):
        if {"text", "row"} & set(self.columns):
            entered.append(self.count())
        return join(self, *args, **kw)

    monkeypatch.setattr(type(docs), "join", counted)
    assert keep_first(docs, Similarity(5, 75)).count() == 400
    assert entered and max(entered) < 300  # of 412 texts, the candidates


def test_spared_signatures_lose_no_link():
    """Sets that just link share a signature, and a set sends one more than can differ for each size class."""
    rng = np.random.default_rng(2)
    none, similarity = np.zeros(1 << (ngram_join.HOT_BITS - 6), dtype=np.uint64), Similarity(5, 80)
    for n in (40, 90, 200, 700):
        for _ in range(60):
            a = rng.integers(0, 2 ** 64, n, dtype=np.uint64)
            drop = rng.integers(0, n // 5 + 1)
            gain = max(0, int((n - drop) / 0.8) - n)
            b = np.concatenate((a[drop:], rng.integers(0, 2 ** 64, rng.integers(0, gain + 1), dtype=np.uint64)))
            x, y = np.unique(a), np.unique(b)
            if similarity.linked(len(x), len(y), len(np.intersect1d(x, y))):
                assert len(np.intersect1d(signatures(x, similarity, none), signatures(y, similarity, none)))
        if n >= 200:
            assert len(signatures(x := np.unique(a), similarity, none)) <= sum(p - g + 1 for _, p, g in similarity.parts(len(x)))
