"""Readers and writers.

Formats are dispatched on the file extension (case-insensitive); an
unsupported extension raises ``ValueError``.  Inputs are read with a declared
schema when one is given (``inferSchema`` costs an extra pass over the data
and is only the fallback).  There is no forced CSV round trip: every format
is read natively, keeping types.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import q
from ..session import ensure_checkpoint_dir

# Declared schema of the raw passenger table (column names and types are
# fixed by the data set).
PASSENGER_SCHEMA = T.StructType([
    T.StructField("PassengerId", T.StringType()),
    T.StructField("HomePlanet", T.StringType()),
    T.StructField("CryoSleep", T.BooleanType()),
    T.StructField("Cabin", T.StringType()),
    T.StructField("Destination", T.StringType()),
    T.StructField("Age", T.DoubleType()),
    T.StructField("VIP", T.BooleanType()),
    T.StructField("RoomService", T.DoubleType()),
    T.StructField("FoodCourt", T.DoubleType()),
    T.StructField("ShoppingMall", T.DoubleType()),
    T.StructField("Spa", T.DoubleType()),
    T.StructField("VRDeck", T.DoubleType()),
    T.StructField("Name", T.StringType()),
    T.StructField("Transported", T.BooleanType()),
])

SUPPORTED = {".csv": "csv", ".json": "json", ".parquet": "parquet", ".pq": "parquet"}


def format_of(path: str) -> str:
    """Format from the extension, case-insensitive."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in SUPPORTED:
        raise ValueError(f"unsupported file type {ext!r} for {path}; supported: {sorted(SUPPORTED)}")
    return SUPPORTED[ext]


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str | None = None, json_multiline: bool = False) -> DataFrame:
    """Read CSV (header), JSON or Parquet.

    JSON is read as JSON Lines (splittable, what Spark writes); a file holding
    one JSON document (an array of records) needs ``json_multiline=True`` and
    is then read whole by one task per file.
    """
    fmt = fmt or format_of(path)
    reader = spark.read
    if schema is not None and fmt != "parquet":
        reader = reader.schema(schema)
    if fmt == "csv":
        if schema is None:
            reader = reader.option("inferSchema", True)
        df = reader.option("header", True).csv(path)
    elif fmt == "json":
        df = reader.option("multiLine", json_multiline).json(path)
    elif fmt == "parquet":
        df = reader.parquet(path)
        if schema is not None:
            df = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields if f.name in df.columns])
    else:
        raise ValueError(f"unsupported format {fmt}")
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Float NaN -> NULL at ingest (Spark aggregates treat NaN as a value)."""
    fl = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not fl:
        return df
    return df.withColumns({c: F.when(F.isnan(q(c)), F.lit(None)).otherwise(q(c)) for c in fl})


def write_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> None:
    """Write in any supported format, optionally partitioned."""
    fmt = fmt or format_of(path)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never machine-local
    on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/prepflow-io/{name}-{uuid.uuid4().hex[:12]}"


def write_splits(df: DataFrame, path: str, by: Sequence[str] = ("split",), fmt: str = "parquet") -> None:
    """Prepared splits (holdout / k-fold / full), one partition folder per split/fold."""
    write_table(df, path, fmt, partition_by=by)


def write_dictionaries(dictionary: DataFrame, path: str) -> None:
    """Frequency dictionaries as JSON lines."""
    dictionary.write.mode("overwrite").json(path)


def discover_folds(spark: SparkSession, path: str, fold_col: str = "fold", split_col: str = "split") -> DataFrame:
    """The folds found under ``path`` that have test rows, and how many.

    Only partitions of test rows are opened, and of their files the row counts alone.
    """
    test = spark.read.parquet(path).where(F.col(split_col) == "test")
    return test.groupBy(fold_col).agg(F.count(F.lit(1)).alias("n_test")).orderBy(fold_col)


def list_folds(spark: SparkSession, path: str, fold_col: str = "fold", split_col: str = "split") -> DataFrame:
    """The folds that have files of test rows, from the partition folders alone: no file is opened.

    The reader of whole files gives their names, lengths and partition values; their
    content is not selected, so it is not read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.where((F.col(split_col) == "test") & (F.col("length") > 0)).select(fold_col).distinct().orderBy(fold_col)


def write_bucketed(df: DataFrame, name: str, group: str, buckets: int, path: str | None = None) -> DataFrame:
    """A prepared table ``name`` in buckets of its group, sorted by it; returns the table.

    Statistics of groups and their join back to the rows need no shuffle then, however
    often they are computed: both sides are read bucket by bucket.
    """
    w = df.write.mode("overwrite").bucketBy(buckets, group).sortBy(group).format("parquet")
    (w.option("path", path) if path else w).saveAsTable(name)
    return df.sparkSession.table(name)


def with_row_key(df: DataFrame, key: str = "row_key", source: str | None = None) -> DataFrame:
    """Carry a real id as the row key; ``monotonically_increasing_id`` only as
    fallback (unique, but not stable across re-reads of a changed input)."""
    if source and source in df.columns:
        return df.withColumn(key, F.col(source))
    return df.withColumn(key, F.monotonically_increasing_id())


def write_submission(scored: DataFrame, path: str, key: str = "PassengerId", pred: str = "prediction",
                     out_col: str = "Transported") -> None:
    """``(key, bool)`` CSV, ordered by key."""
    scored.select(key, F.col(pred).cast(T.BooleanType()).alias(out_col)).orderBy(key) \
          .write.mode("overwrite").option("header", True).csv(path)


def write_predictions(scored: DataFrame, path: str, key: str = "PassengerId") -> None:
    """Predictions and probabilities of all folds, ordered by key."""
    scored.orderBy(key).write.mode("overwrite").parquet(path)


def append_metrics(metrics: DataFrame, path: str, run: int) -> None:
    """Append one run's metric row(s) to the metrics table, with the run's number in the session."""
    metrics.withColumn("run", F.lit(run)).write.mode("append").parquet(path)


def write_leaderboard(spark: SparkSession, metrics_path: str, out_path: str,
                      columns: Sequence[str] = ("Model", "accuracy", "precision", "recall", "f1", "roc_auc")) -> None:
    """The session's metric rows in the order of the runs, with the fixed columns (a few rows: one file)."""
    m = spark.read.parquet(metrics_path)
    m.coalesce(1).sortWithinPartitions("run").select(*[c for c in columns if c in m.columns]) \
     .write.mode("overwrite").option("header", True).csv(out_path)
