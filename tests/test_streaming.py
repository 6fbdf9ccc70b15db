"""Streaming application of fitted row-local state equals the batch result."""

from pyspark.sql import functions as F

from prepflow.operators import impute as imp
from prepflow.operators.state import freeze
from prepflow.plans.q_impute import ORDER_PRE_RULES
from prepflow.plans.tables import orders_with_nulls
from prepflow.sources import io
from prepflow.streaming import apply_row_state, write_stream

FEATS = ["o_orderstatus", "c_mktsegment"]


def test_stream_matches_batch(spark):
    v = orders_with_nulls(spark, "/root/testdata/sf0.001")
    src = io.scratch_path(spark, "stream-src")
    v.repartition(3).write.parquet(src)
    d = freeze(imp.frequency_dictionary(v, FEATS))
    batch = apply_row_state(spark.read.parquet(src), ORDER_PRE_RULES, ["o_totalprice"], d, FEATS, ["o_orderkey"])
    stream = spark.readStream.schema(v.schema).parquet(src)
    out = apply_row_state(stream, ORDER_PRE_RULES, ["o_totalprice"], d, FEATS, ["o_orderkey"])
    sink, ck = io.scratch_path(spark, "stream-out"), io.scratch_path(spark, "stream-ck")
    q = write_stream(out, sink, ck)
    q.awaitTermination(120)
    got = spark.read.parquet(sink)
    assert got.count() == batch.count()
    assert got.where(F.col("o_orderstatus").isNull()).count() == 0
    assert sorted(got.collect()) == sorted(batch.select(*got.columns).collect())
