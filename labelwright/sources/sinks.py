"""Inspections and violations as Parquet, by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_inspections(inspections: DataFrame, path: str, created_at: str = "created_at", mode: str = "append") -> None:
    """Partitioned by the day of creation; rows of a day come together first, so a task opens few files."""
    day = F.to_date(created_at)
    inspections.withColumn("created_date", day).repartition("created_date", F.pmod(F.xxhash64("id"), F.lit(16))).write.mode(mode).partitionBy("created_date").parquet(path)


def write_violations(violations: DataFrame, path: str, mode: str = "append") -> None:
    """Seven rows per inspection."""
    violations.write.mode(mode).partitionBy("rule_code").parquet(path)
