"""Inspections, violations, users and frames as projections of the relational tables, for dashboards at scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table


def inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inspection per order: its customer is the owner, its status F, O or P compliant, non-compliant or processing."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("inspector_id"), F.col("o_orderpriority").alias("product_name"), F.concat(F.lit("Brand#"), (k % 25).cast("string")).alias("brand"),
        F.round((k % 8) / 7 * 100.0, 1).alias("compliance_score"), F.when(k % 3 != 0, (k % 100).cast("double")).alias("quality_score"), F.when(k % 4 != 0, (k % 10) / 10.0).alias("ocr_confidence"),
        F.when(F.col("o_orderstatus") == "F", "Compliant").when(F.col("o_orderstatus") == "O", "Non-Compliant").otherwise("Processing").alias("overall_status"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "").otherwise(F.concat(F.lit("images/"), k.cast("string"), F.lit(".png"))).alias("image_path"), F.col("o_orderdate").alias("created_at"),
    )


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result per line item: the line number is the rule, a returned item a failure."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("inspection_id"), F.concat(F.lit("LM-0"), F.col("l_linenumber").cast("string")).alias("rule_code"), F.when(F.col("l_returnflag") == "R", "Fail").otherwise("Pass").alias("status"), F.when(F.col("l_suppkey") % 2 == 0, "Front").otherwise("Back Label").alias("source_view"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user per customer; the segment is the role."""
    role = F.when(F.col("c_mktsegment") == "BUILDING", "admin").when(F.col("c_mktsegment") == "MACHINERY", "viewer").otherwise("inspector")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("U"), F.col("c_custkey").cast("string"), F.lit("@Example.com")).alias("email"), role.alias("role"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame per event: the user is the video, the event the frame."""
    v, e = F.col("value"), F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), e.alias("frame_num"), v.alias("sharpness"), (e % 256).cast("double").alias("brightness"), (e % 60).cast("double").alias("contrast"), ((e % 11) / 100.0).alias("edge_density"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box per event, within a picture of 1000 by 800; the user is the picture."""
    e = F.col("event_id")
    x1, y1 = (e * 37 % 900).cast("int"), (e * 53 % 700).cast("int")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), e.alias("box_id"), "event_type", x1.alias("x1"), y1.alias("y1"), (x1 + (e % 97).cast("int") + 1).alias("x2"), (y1 + (e % 89).cast("int") + 1).alias("y2"), ((e % 1009) / 1009.0).alias("confidence"), F.lit(1000).alias("width"), F.lit(800).alias("height"))
