"""Skip samples whose outputs exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complete_samples(metrics: DataFrame, required: list[str]) -> DataFrame:
    """Samples that have rows of every required metric."""
    have = metrics.where(F.col("metric").isin(required)).select("sample_id", "metric").distinct()
    return have.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") == len(set(required))).select("sample_id")


def pending_samples(samples: DataFrame, metrics: DataFrame, required: list[str]) -> DataFrame:
    """Samples still to be quantified."""
    return samples.join(complete_samples(metrics, required), "sample_id", "left_anti")
