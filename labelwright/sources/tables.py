"""Scans (S1, S2, S12), the view-label parser (S5) and the image source (S3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelwright.functions.text import strip

#: View names given to uploads without labels.
UPLOAD_VIEWS = ["Front", "Back", "Left Side", "Right Side", "Top", "Bottom", "Batch Panel", "Close-up"]

MAX_IMAGES = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, rows: int, *keys: str, most: int = 1_000_000) -> DataFrame:
    """The rows by keys in so many partitions that each has about ``most`` of the given number, so that what a task sorts and
    groups does not grow with the table."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // most)), *keys)


def jdbc_table(spark: SparkSession, url: str, name: str, key: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 1) -> DataFrame:
    """A database table, read in ranges of a key where one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions)
    return reader.load()


def latest_with_payload(inspections: DataFrame, limit: int = 2000) -> DataFrame:
    """The newest inspections that have extracted data and an image; a top-k."""
    path = F.coalesce(F.nullif(F.col("image_path"), F.lit("")), F.nullif(F.col("cropped_image_path"), F.lit("")))
    return inspections.filter(F.col("extracted_data").isNotNull() & path.isNotNull()).orderBy(F.desc("id")).limit(limit)


def evolve(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Adds the columns that an older table lacks, with their defaults; keeps the others."""
    missing = [f for f in schema if f.name not in df.columns]
    return df.select("*", *(F.lit((defaults or {}).get(f.name)).cast(f.dataType).alias(f.name) for f in missing))


def view_labels(c: Column) -> Column:
    """A JSON array of strings, a JSON scalar or a comma list; trimmed, blanks dropped, null gives none."""
    listed = F.from_json(c, "array<string>")
    parts = F.when(c.rlike(r"^\s*\["), F.coalesce(listed, F.split(c, ","))).when(c.rlike(r'^\s*".*"\s*$'), F.array(F.regexp_extract(c, r'^\s*"(.*)"\s*$', 1))).otherwise(F.split(c, ","))
    return F.coalesce(F.filter(F.transform(parts, strip), lambda x: x != ""), F.array().cast("array<string>"))


def view_name(given: Column, at: Column, defaults: list[str] = UPLOAD_VIEWS) -> Column:
    """The label given at a place (from 0), else the default's, else its number."""
    return F.coalesce(F.get(given, at), F.get(F.array(*map(F.lit, defaults)), at), F.concat(F.lit("Angle "), (at + 1).cast("string")))


def image_type(content: Column) -> Column:
    """The MIME type by leading bytes: PNG, WebP, else JPEG where they say so, else null."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("89504E47"), "image/png").when(head.startswith("52494646") & head.endswith("57454250"), "image/webp").when(head.startswith("FFD8"), "image/jpeg")


def image_requests(spark: SparkSession, path: str, depth: int = 1) -> DataFrame:
    """S3: the images below a folder with one sub-folder per request, and whether the request is admissible.

    A request has one to eight files, each of an image type. Files are counted without their bytes, and the counts are
    small next to those, so that the join brings them to the files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    part = F.split("path", "/")
    files = files.select(F.element_at(part, -1 - depth).alias("request"), "path", "length", "content", image_type(F.col("content")).alias("mime"))
    narrow = files.select("request", "mime")
    per = narrow.groupBy("request").agg(F.count(F.lit(1)).alias("n_images"), F.count_if(F.col("mime").isNull()).alias("n_other"))
    return files.join(per, "request").withColumn("admissible", F.col("n_images").between(1, MAX_IMAGES) & (F.col("n_other") == 0))
