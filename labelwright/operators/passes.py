"""M9: the controller of readings as rounds: only labels that are still open go to the next pass.

A reading is expensive, so a pass is made for the labels that ask for it and no others. Between rounds each label has one
narrow row of what is known so far, written to the shared folder in buckets by key, so that rounds deal no label out again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.sources.published import shared_folder

#: The passes in their order.
PASSES = ("natural_90deg", "natural_270deg", "variant_crop", "variant_a", "variant_b", "variant_d", "variant_c", "region")


def wanted(name: str, retries: int = 5) -> Column:
    """Whether a label asks for that pass, by its row of :func:`staged`."""
    c = F.col
    left = c("retries") < retries
    return {
        "natural_90deg": (c("aspect") >= 1.15) | (c("first_confidence") < 0.65) | (c("first_score") < 0.20),
        "natural_270deg": (c("first_confidence") < 0.40) & ((c("passes") <= 1) | (c("best_confidence") < 0.50)),
        "variant_crop": left,
        "variant_a": left & c("enhance"),
        "variant_b": left & c("enhance"),
        "variant_d": left & c("enhance"),
        "variant_c": left & c("enlarge"),
        "region": (c("best_confidence") < 0.25) & (c("length") < 15),
    }[name]


def bucket_count(labels: DataFrame, most: int = 250_000) -> int:
    """So many buckets that each has about ``most`` labels, which a task sorts in memory; one for each core at least."""
    return max(labels.sparkSession.sparkContext.defaultParallelism, -(-labels.count() // most))


@contextmanager
def bucketed(df: DataFrame, name: str, key: str, buckets: int, *parts: str) -> Iterator[DataFrame]:
    """The rows, written to the shared folder in buckets by key; tables of one number of buckets meet by key without a shuffle.

    The catalog knows the table until the context ends. Its files stay; a table without ``parts`` may be read later, too.
    """
    spark, known = df.sparkSession, f"labelwright_{name}_{uuid.uuid4().hex}"
    try:
        df.write.bucketBy(buckets, key).partitionBy(*parts).option("path", shared_folder(spark, name)).saveAsTable(known, format="parquet")
        yield spark.table(known)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {known}")


def _table(df: DataFrame, key: str, buckets: int) -> DataFrame:
    with bucketed(df, "passes", key, buckets) as state:
        return state


def staged(labels: DataFrame, read: Callable[[str, DataFrame], DataFrame], key: str = "label_id", retries: int = 5, buckets: int | None = None) -> DataFrame:
    """key, ran, retries, passes, best_confidence of each label.

    labels: key (once), first_confidence (0 where the first reading found no text), first_score, aspect, text of the first
    reading. ``read(pass, keys)`` gives key, text, confidence of the labels asked for that have such a picture, each once.
    Two thresholds end it early: enhanced variants are read only below a confidence of 0.70 or 40 letters, the enlarged one
    below 0.45; turned and cropped pictures count as retries only if text came out. Null texts are empty; an empty table
    gives no rows. The labels are dealt once into so many buckets (see :func:`bucket_count`; else as many as a shuffle has
    partitions). Readings that are :func:`bucketed` by that number are not shuffled; of others a pass shuffles its own.
    """
    buckets = buckets or int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = labels.select(key, "first_confidence", "first_score", "aspect", F.coalesce(F.char_length("text"), F.lit(0)).alias("length"))
    state = _table(
        narrow.repartition(buckets, key).select(
            key, "first_confidence", "first_score", "aspect", F.col("first_confidence").alias("best_confidence"), "length", F.lit(0).alias("retries"),
            F.when(F.col("first_confidence") > 0, 1).otherwise(0).alias("passes"), F.array().cast("array<string>").alias("ran"), F.lit(False).alias("enhance"), F.lit(False).alias("enlarge"),
        ),
        key,
        buckets,
    )
    for name in PASSES:
        left, short = F.col("retries") < retries, F.col("length") < 40
        if name == "variant_a":
            state = state.withColumn("enhance", left & ((F.col("best_confidence") < 0.70) | short))
        if name == "variant_c":
            state = state.withColumn("enlarge", left & ((F.col("best_confidence") < 0.45) | short))
        got = read(name, state.filter(wanted(name, retries)).select(key)).select(key, F.coalesce(F.trim("text"), F.lit("")).alias("__text"), F.col("confidence").alias("__confidence"))
        joined = state.join(got, key, "left")
        runs = F.col("__text").isNotNull()
        found = runs & (F.col("__text") != "")
        counts = F.lit(False) if name == "region" else found if name in PASSES[:3] else runs
        new = {
            "best_confidence": F.when(found, F.greatest("best_confidence", "__confidence")).otherwise(F.col("best_confidence")),
            "length": F.when(found, F.greatest("length", F.char_length("__text"))).otherwise(F.col("length")),
            "retries": F.col("retries") + F.when(counts, 1).otherwise(0),
            "passes": F.col("passes") + F.when(found, 1).otherwise(0),
            "ran": F.when(runs, F.array_append("ran", F.lit(name))).otherwise(F.col("ran")),
        }
        state = _table(joined.withColumns(new).select(*state.columns), key, buckets)
    return state.select(key, "ran", "retries", "passes", "best_confidence")


def from_table(readings: DataFrame, key: str = "label_id") -> Callable[[str, DataFrame], DataFrame]:
    """``read`` over a table of readings (key, pass, text, confidence), partitioned by pass: a round scans that pass alone."""
    return lambda name, keys: readings.filter(F.col("pass") == name).join(keys, key, "left_semi")
