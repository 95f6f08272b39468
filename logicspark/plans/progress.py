"""Counts of what a job has put out, taken while it runs and without a second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _metrics(df: DataFrame) -> list[Column]:
    out = [F.count(F.lit(1)).alias("rows")]
    time = next((c for c in ("t_ns", "start_time") if c in df.columns), None)
    if time is not None:
        out += [F.min(time).alias("first_ns"), F.max(time).alias("last_ns")]
    return out


def observe_progress(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Rows and time range of a batch result; read ``Observation.get`` after an action."""
    seen = Observation(name)
    return df.observe(seen, *_metrics(df)), seen


def observe_stream(df: DataFrame, name: str) -> DataFrame:
    """The same per micro-batch, delivered as ``observedMetrics`` of the query progress."""
    return df.observe(name, *_metrics(df))
