"""Inspections and their findings, published batch by batch as one commit.

A batch's two tables are written to folders of an attempt of its own; a manifest that names the attempt is then put in its
place by one rename that never overwrites. What no manifest names does not exist for readers: an attempt that died between
the two writes, or that lost to another one, leaves nothing to see, and a batch that comes again is left as it was.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = ("inspections", "findings")
MANIFEST = "batch long, attempt string, inspections long, findings long"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share; a temporary one only under a local master without one."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="labelwright-")
    return f"{base.rstrip('/')}/labelwright/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def is_published(spark: SparkSession, base: str, batch: int) -> bool:
    fs, path = _files(spark, base)
    return fs.exists(path(f"{base}/_manifests/{batch}.json"))


def publish(inspections: DataFrame, findings: DataFrame, base: str, batch: int, between: Callable[[], None] | None = None) -> bool:
    """Publishes both tables as that batch, unless it is there already; whether this call did. ``between`` runs between the
    two writes, for tests."""
    spark = inspections.sparkSession
    if is_published(spark, base, batch):
        return False
    attempt, counts = uuid.uuid4().hex, {}
    for part, df in zip(PARTS, (inspections, findings), strict=True):
        folder = f"{base}/{part}/batch={batch}/attempt={attempt}"
        df.write.parquet(folder)
        counts[part] = spark.read.schema(df.schema).parquet(folder).count()
        if between and part == PARTS[0]:
            between()
    fs, path = _files(spark, base)
    held, final = path(f"{base}/_manifests/.{batch}-{attempt}"), path(f"{base}/_manifests/{batch}.json")
    fs.mkdirs(final.getParent())
    out = fs.create(held, False)
    out.write(bytearray(json.dumps({"batch": batch, "attempt": attempt, **counts}).encode()))
    out.close()
    # Two attempts at once: a rename onto what is there fails, or is found to have lost below.
    won = not fs.exists(final) and fs.rename(held, final)
    if not won or read_manifests(spark, base).filter((F.col("batch") == batch) & (F.col("attempt") == attempt)).isEmpty():
        for part in PARTS:
            fs.delete(path(f"{base}/{part}/batch={batch}/attempt={attempt}"), True)
        return False
    return True


def publisher(base: str, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: makes inspections and findings of a batch and publishes them once, however often it comes."""

    def batch(df: DataFrame, batch_id: int) -> None:
        if not is_published(df.sparkSession, base, batch_id):
            held = df.persist()
            try:
                publish(*split(held), base, batch_id)
            finally:
                held.unpersist()

    return batch


def read_manifests(spark: SparkSession, base: str) -> DataFrame:
    """A row per published batch."""
    return spark.read.schema(MANIFEST).option("pathGlobFilter", "*.json").json(f"{base}/_manifests")


def read_published(spark: SparkSession, base: str, part: str, columns: str) -> DataFrame:
    """The rows of all published batches with their batch; columns: the table's, as DDL.

    Only attempts that a manifest names are read: the join with the manifests prunes the partitions.
    """
    rows = spark.read.schema(f"{columns}, batch long, attempt string").option("basePath", f"{base}/{part}").parquet(f"{base}/{part}")
    return rows.join(read_manifests(spark, base).filter(F.length("attempt") == 32).select("batch", "attempt"), ["batch", "attempt"]).drop("attempt")


def sweep(spark: SparkSession, base: str) -> int:
    """Deletes attempts that no manifest names, of batches that are published; how many. Run while no batch is under way."""
    fs, path = _files(spark, base)
    named = {(r["batch"], r["attempt"]) for r in read_manifests(spark, base).select("batch", "attempt").toLocalIterator()}
    gone = 0
    for part in PARTS:
        for f in fs.globStatus(path(f"{base}/{part}/batch=*/attempt=*")) or []:
            batch, attempt = (x.split("=", 1)[1] for x in f.getPath().toString().rsplit("/", 2)[1:])
            if is_published(spark, base, int(batch)) and (int(batch), attempt) not in named:
                fs.delete(f.getPath(), True)
                gone += 1
    return gone
