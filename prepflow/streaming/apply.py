"""Fitted state on streaming DataFrames.

Everything the fit produces that is row-local - domain rules, constant fills,
dictionary draws (a stream-static equi-join with the frozen dictionary
index) and Spark ML models (``transform`` works on streams) - applies to a
``readStream`` DataFrame unchanged, so records arriving after training are
prepared exactly as the batch test rows would be.  Group statistics need
whole groups and stay in batch jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import impute as imp
from ..operators import models as mdl
from ..operators.rules import Rule, apply_rules, fill_constant
from ..operators.state import StateTable


def apply_row_state(stream: DataFrame, rules: Sequence[Rule] = (), zero_fill: Sequence[str] = (),
                    dictionaries: StateTable | None = None, features: Sequence[str] = (),
                    row_key: Sequence[str] = ("PassengerId",), seed: int = 42) -> DataFrame:
    """Rules, constant fills and dictionary sampling (feature ``i`` uses ``seed + i``)."""
    out = apply_rules(stream, rules)
    out = fill_constant(out, zero_fill, 0.0)
    if dictionaries is not None:
        for i, f in enumerate(features):
            if f in out.columns:
                out = imp.sample_fill(out, f, dictionaries, list(row_key), seed + i)
    return out


def score_stream(stream: DataFrame, model, key: str | Sequence[str], threshold: float = 0.5) -> DataFrame:
    """M10 on a stream: ``key, prediction, probability``."""
    return mdl.score(model, stream, key, None, threshold)


def write_stream(df: DataFrame, path: str, checkpoint_location: str, fmt: str = "parquet",
                 available_now: bool = True) -> StreamingQuery:
    """Append the prepared stream to files; the checkpoint location must be on
    shared storage so a restarted query resumes exactly once."""
    w = df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint_location) \
          .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
