"""An inspection end to end: views -> fields -> merge -> rules -> profile, with one shuffle by product."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwright.functions.extract import extract_fields
from labelwright.functions.profile import profile
from labelwright.functions.rules import evaluate, violations
from labelwright.operators.merge import marked_text, merge_views, texts_in_order


@dataclass
class Inspection:
    """inspections: a row per product; findings: seven rows per product; profiles: a row per product.

    All three read ``merged``, a row per product; whoever asks for more than one persists or writes that first.
    """

    merged: DataFrame
    product: str
    threshold: float

    @property
    def evaluated(self) -> DataFrame:
        return evaluate(self.merged, is_food=F.col("is_food"), evidence=True, threshold=self.threshold)

    @property
    def inspections(self) -> DataFrame:
        return self.evaluated.select(self.product, "compliance_score", "overall_status", "ocr_confidence", "fields", "merge_metadata")

    @property
    def findings(self) -> DataFrame:
        return violations(self.evaluated, self.product)

    @property
    def profiles(self) -> DataFrame:
        return profile(self.merged.select(self.product, marked_text(F.col("texts")).alias("combined_text")), "combined_text")


def inspect(views: DataFrame, product: str = "product_id", threshold: float = 80.0) -> Inspection:
    """views: product, view_ord, view, image_path, confidence, text, is_food. One aggregation by product does it all."""
    also = (F.bool_and("is_food").alias("is_food"), F.max("confidence").alias("ocr_confidence"), texts_in_order().alias("texts"))
    return Inspection(merge_views(extract_fields(views), product, keep=("view", "confidence", "text", "is_food"), also=also), product, threshold)
