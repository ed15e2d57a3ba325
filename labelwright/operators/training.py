"""The detector's training set (S9, K8, K9): splits by hash, and normalised label lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions.metrics import block_class, normal_box

CLASS_IDS = {"product_name": 0, "manufacturer": 1, "mrp_quantity": 2, "date_fssai": 3, "general_text": 4}


def class_id(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in CLASS_IDS.items() for x in kv)), c), F.lit(CLASS_IDS["general_text"]))


def is_validation(key: Column, share: float = 0.15, seed: int = 42) -> Column:
    """Whether a row is of the validation part; depends on key and seed alone, so that it holds as rows are added."""
    digest = F.md5(F.concat_ws("/", key.cast("string"), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10_000 < int(share * 10_000)


def split_digest(key: Column, seed: int = 42) -> Column:
    """The 32 hexadecimal digits by which keys are drawn."""
    return F.md5(F.concat_ws("/", key.cast("string"), F.lit(str(seed))).cast("binary"))


def split_boundary(keys: DataFrame, key: str, share: float = 0.15, seed: int = 42) -> str | None:
    """The digits up to which a key's digest is of the validation part: exactly ``max(1, int(n * share))`` of n distinct
    keys are; None without keys.

    The k-th smallest digest is found by refining a histogram: each pass counts the keys by the next three digits, 4096
    counts at most, and goes on in the one bin that holds it. There is no sort, and no key leaves the executors.
    """
    digests = keys.filter(F.col(key).isNotNull()).select(key).distinct().select(split_digest(F.col(key), seed).alias("digest"))
    n = digests.count()
    if not n:
        return None
    prefix, need = "", max(1, int(n * share))
    while True:
        own = digests.filter(F.col("digest").startswith(prefix)) if prefix else digests
        for r in sorted(own.groupBy(F.substring("digest", len(prefix) + 1, 3).alias("bin")).count().collect()):
            if r["count"] >= need:
                prefix += r["bin"]
                break
            need -= r["count"]
        # The bin as a whole, or all digits are used up: keys of equal digests stay together.
        if r["count"] == need or len(prefix) >= 32:
            return prefix


def exact_split(df: DataFrame, key: str, share: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds is_validation, true for exactly ``max(1, int(n * share))`` of n distinct keys.

    Follows from the keys and the seed alone, however rows are split or ordered; rows of one key are of one part, so no
    picture is in both; null keys are never of the validation part; an empty table gives no rows.
    """
    boundary = split_boundary(df, key, share, seed)
    if boundary is None:
        return df.withColumn("is_validation", F.lit(False))
    drawn = F.substring(split_digest(F.col(key), seed), 1, len(boundary)) <= boundary
    return df.withColumn("is_validation", F.coalesce(F.when(F.col(key).isNotNull(), drawn), F.lit(False)))


def label_lines(blocks: DataFrame, key: str = "id") -> DataFrame:
    """A row per block: its class and box as a line of a label file; blocks: key, text, x1, y1, x2, y2, width, height."""
    box = normal_box(*(F.col(c) for c in ("x1", "y1", "x2", "y2", "width", "height")))
    rows = blocks.select(key, block_class(F.col("text")).alias("class"), box.alias("b")).filter(F.col("b").isNotNull())
    line = F.format_string("%d %.6f %.6f %.6f %.6f", class_id(F.col("class")), "b.cx", "b.cy", "b.w", "b.h")
    return rows.select(key, "class", F.col("b.cx").alias("cx"), F.col("b.cy").alias("cy"), F.col("b.w").alias("w"), F.col("b.h").alias("h"), line.alias("line"), is_validation(F.col(key)).alias("is_validation"))


def write_label_files(lines: DataFrame, path: str, key: str = "id") -> None:
    """Label texts per key as Parquet, validation apart; a file per picture would be millions of small ones."""
    lines.groupBy(key, "is_validation").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("label")).write.mode("overwrite").partitionBy("is_validation").parquet(path)
