"""Ours: labels as they arrive. Extraction and rules are stateless projections; counts by window need a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.functions.extract import extract_fields
from labelwright.functions.rules import evaluate, violations

LABEL = "product_id long, brand string, view string, text string, is_food boolean, ts timestamp"


def label_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files of labels in a folder, new ones as they come."""
    return spark.readStream.schema(LABEL).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def findings(labels: DataFrame) -> DataFrame:
    """A row per label and rule."""
    evaluated = evaluate(extract_fields(labels), is_food=F.col("is_food"))
    return violations(evaluated, "product_id", "brand", "ts")


def windowed(found: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Passed and failed results of each rule in tumbling windows; rows later than the watermark are dropped."""
    w = F.window("ts", window)
    counted = found.withWatermark("ts", late).groupBy(w, "rule_code").agg(F.count_if(F.col("status") == "Fail").alias("failed"), F.count_if(F.col("status") == "Pass").alias("passed"))
    return counted.select(F.col("window.start").alias("start"), "rule_code", "failed", "passed")


def write_findings(found: DataFrame, path: str, checkpoint: str):
    """A sink that appends to Parquet, exactly once by its checkpoint."""
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
