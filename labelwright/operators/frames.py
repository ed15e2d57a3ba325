"""Keyframes of videos (F10, V1-V4, O6, A11-A13): frames in order within a video, aggregates across them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelwright.functions.metrics import frame_discard, frame_score, frame_view


def distinct_rows(frames: DataFrame, video: str, order: str, histogram: str = "histogram", most: float = 0.94) -> DataFrame:
    """V2 over rows: frames of each video in order, without those whose histogram correlates more than ``most`` with one
    that is kept.

    Frames are sorted by Spark and pass through in batches; a task holds the histograms that a video keeps, not its
    frames. What is flat correlates with all.
    """
    at, key = frames.columns.index(histogram), frames.columns.index(video)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, []
        for batch in batches:
            taken = []
            for i, (v, h) in enumerate(zip(batch.column(key).to_pylist(), batch.column(at).to_pylist(), strict=True)):
                if i == 0 and now is None or v != now:
                    now, kept = v, []
                x = np.array(h, dtype=np.float64)
                x -= x.mean()
                size = float(x @ x)
                if not any(size * other <= 0 or float(x @ y) / np.sqrt(size * other) > most for y, other in kept):
                    kept.append((x, size))
                    taken.append(i)
            yield batch.take(pa.array(taken, pa.int64()))

    sorted_ = frames.repartition(video).sortWithinPartitions(video, order)
    return sorted_.mapInArrow(run, frames.schema)


def strided_rows(frames: DataFrame, video: str, order: str, most: int = 8) -> DataFrame:
    """O6 over rows: those frames of each video, with their position."""
    w = Window.partitionBy(video)
    i, n = F.row_number().over(w.orderBy(order)) - 1, F.count(F.lit(1)).over(w)
    ranked = frames.withColumns({"__i": i, "__n": n}).withColumn("__j", F.ceil(F.col("__i") * most / F.col("__n")))
    taken = (F.col("__n") <= most) | (F.col("__j") < most) & (F.floor(F.col("__j") * F.col("__n") / most) == F.col("__i"))
    return ranked.filter(taken).withColumn("position", F.when(F.col("__n") <= most, F.col("__i")).otherwise(F.col("__j")).cast("int")).drop("__i", "__n", "__j")


def gated(frames: DataFrame, min_sharpness: float = 35.0) -> DataFrame:
    """Adds discard_reason and quality_score."""
    out = frames.withColumn("discard_reason", frame_discard(F.col("sharpness"), F.col("brightness"), F.col("contrast"), min_sharpness))
    return out.withColumn("quality_score", frame_score(F.col("sharpness"), F.col("contrast"), F.col("edge_density")))


def keyframes(frames: DataFrame, video: str = "video_id", most: int = 8, min_sharpness: float = 35.0) -> DataFrame:
    """A row per video: keyframes with views, and telemetry.

    frames: video, frame_num, sharpness, brightness, contrast, edge_density, histogram (and upper, lower, aspect for the
    view's confidence). A video all of whose frames are discarded keeps its first one with stated metrics (V4).
    """
    for name, value in (("upper", 0.0), ("lower", 0.0), ("aspect", 0.7)):
        if name not in frames.columns:
            frames = frames.withColumn(name, F.lit(value))
    own = ["frame_num", "sharpness", "brightness", "contrast", "edge_density", "quality_score", "upper", "lower", "aspect", "histogram"]
    g = gated(frames, min_sharpness).select(video, *own, "discard_reason")
    fallback = F.struct("frame_num", F.lit(40.0).alias("sharpness"), "brightness", F.lit(25.0).alias("contrast"), F.lit(0.05).alias("edge_density"), F.lit(60.0).alias("quality_score"), "upper", "lower", "aspect", "histogram")
    per = g.groupBy(video).agg(
        F.count(F.lit(1)).alias("frames_sampled"),
        F.count_if(F.col("discard_reason") == "motion_blur").alias("motion_blur"),
        F.count_if(F.col("discard_reason") == "poor_lighting").alias("poor_lighting"),
        F.count_if(F.col("discard_reason").isNull()).alias("kept"),
        F.min_by(fallback, "frame_num").alias("first"),
    )
    rows = g.filter(F.col("discard_reason").isNull()).drop("discard_reason").unionByName(per.filter("kept = 0").select(video, "first.*"))
    distinct = distinct_rows(rows, video, "frame_num").drop("histogram")
    chosen = strided_rows(distinct.withColumn("distinct", F.count(F.lit(1)).over(Window.partitionBy(video))), video, "frame_num", most)
    v = frame_view(F.col("position"), F.least(F.col("distinct"), F.lit(most)), F.col("upper"), F.col("lower"), F.col("aspect"))
    chosen = chosen.select(video, "distinct", F.struct("position", F.col("frame_num").alias("frame_index"), v.alias("v"), F.round("quality_score", 1).alias("quality_score"), F.round("sharpness", 1).alias("sharpness")).alias("k"))
    # No more than ``most`` rows a video.
    keys = chosen.groupBy(video).agg(F.max("distinct").alias("distinct"), F.array_sort(F.collect_list("k")).alias("keyframes"))
    out = per.drop("first").join(keys, video)
    duplicates = F.greatest(F.col("kept"), F.lit(1)) - F.col("distinct")
    return out.select(
        video, "frames_sampled", "motion_blur", "poor_lighting", duplicates.alias("duplicate_views"), (F.col("motion_blur") + F.col("poor_lighting") + duplicates).alias("frames_discarded"),
        F.transform("keyframes", lambda k: F.struct(k["frame_index"].alias("frame_index"), k["position"].alias("keyframe_order"), k["v"]["view"].alias("view"), k["v"]["confidence"].alias("view_confidence"), k["quality_score"].alias("quality_score"), k["sharpness"].alias("sharpness"))).alias("keyframes"),
    )


def view_coverage(rows: DataFrame, video: str = "video_id") -> DataFrame:
    """Count, best confidence and first keyframe of each view; rows: video, keyframe_order, view, view_confidence."""
    return rows.groupBy(video, "view").agg(F.count(F.lit(1)).alias("count"), F.max("view_confidence").alias("confidence"), F.min("keyframe_order").alias("first_keyframe"))


def missing_views(rows: DataFrame, video: str = "video_id") -> DataFrame:
    """Which of front and back a video lacks."""
    lacks = F.array_except(F.array(F.lit("Front"), F.lit("Back")), F.collect_set("view"))
    return rows.groupBy(video).agg(F.array_join(lacks, ", ").alias("missing"))


def mean_overlap(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """The mean of |difference| scores of consecutive members; rows hold a score in 0 to 1 each."""
    w = Window.partitionBy(group).orderBy(order)
    pairs = rows.withColumn("__next", F.lead(value).over(w)).filter(F.col("__next").isNotNull())
    return pairs.groupBy(group).agg(F.avg(1.0 - F.abs(F.col(value) - F.col("__next"))).alias("mean_overlap"))
