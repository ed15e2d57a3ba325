"""Box folds (I6, I8, I9) and the choice of regions (O5) inside the row. A box is a struct of x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cluster(boxes: Column, gap_x: int = 15, gap_y: int = 8) -> Column:
    """Boxes in reading order (y1, x1); one that touches the last cluster, within the gaps, joins it."""
    key = lambda b: F.struct(b["y1"].alias("y1"), b["x1"].alias("x1"), b["x2"].alias("x2"), b["y2"].alias("y2"))
    ordered = F.array_sort(F.transform(boxes, key))

    def step(done: Column, b: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        touches = (b["x1"] <= last["x2"] + gap_x) & (b["x2"] >= last["x1"] - gap_x) & (b["y1"] <= last["y2"] + gap_y) & (b["y2"] >= last["y1"] - gap_y)
        joined = F.struct(F.least(last["y1"], b["y1"]).alias("y1"), F.least(last["x1"], b["x1"]).alias("x1"), F.greatest(last["x2"], b["x2"]).alias("x2"), F.greatest(last["y2"], b["y2"]).alias("y2"))
        return F.when((F.size(done) > 0) & touches, F.array_append(F.slice(done, 1, F.size(done) - 1), joined)).otherwise(F.array_append(done, b))

    merged = F.aggregate(ordered, F.slice(ordered, 1, 0), step)
    return F.transform(merged, lambda b: F.struct(b["x1"].alias("x1"), b["y1"].alias("y1"), b["x2"].alias("x2"), b["y2"].alias("y2")))


def merge_close(boxes: Column, gap: int = 10) -> Column:
    """The same with one gap."""
    return cluster(boxes, gap, gap)


def top_regions(regions: DataFrame, picture: str, key: str, most: int = 8) -> DataFrame:
    """The most confident regions of each picture (of equals the smaller key), with their position in reading order.

    Rows, not arrays: Spark keeps the best of each task before the shuffle, so a picture with very many regions is cheap.
    """
    best = Window.partitionBy(picture).orderBy(F.desc("confidence"), key)
    kept = regions.withColumn("__best", F.row_number().over(best)).filter(F.col("__best") <= most).drop("__best")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(picture).orderBy("y1", "x1", key)) - 1)


def without_covered(boxes: Column, most: float = 0.6) -> Column:
    """I8: boxes in order, without those of which more than that share lies in one that is kept."""

    def step(kept: Column, b: Column) -> Column:
        area = F.greatest(F.lit(1), (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]))
        shared = lambda k: F.greatest(F.lit(0), F.least(b["x2"], k["x2"]) - F.greatest(b["x1"], k["x1"])) * F.greatest(F.lit(0), F.least(b["y2"], k["y2"]) - F.greatest(b["y1"], k["y1"]))
        return F.when(F.exists(kept, lambda k: shared(k) / area > most), kept).otherwise(F.array_append(kept, b))

    return F.aggregate(boxes, F.slice(boxes, 1, 0), step)
