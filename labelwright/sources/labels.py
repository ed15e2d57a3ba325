"""Label texts made from the relational tables, with defects set by the part's key, so that the right answers are known.

A part's label names its supplier as maker, its size as quantity, its price, and a licence, month and contact derived
from the key. Defects are stated in :data:`DEFECTS` as (divisor, remainder) of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.functions.text import built

from .tables import table

DEFECTS = {
    "no_tax": (3, 1),
    "no_care": (5, 2),
    "noisy_license": (7, 3),
    "bad_unit": (11, 4),
    "comma_price": (13, 5),
    "no_license": (16, 9),
    "no_country": (17, 6),
    "bad_date": (19, 7),
    "no_maker": (23, 8),
}

COUNTRIES = ["India", "Japan", "Brazil", "Kenya", "France"]
LABEL_UNITS = ["gm", "kg", "ml", "ltr"]
VIEWS = [("Front", 0.9), ("Back", 0.8), ("Left Side", 0.95)]
CODES = ["322", "330", "102", "951", "999", "500(ii)"]


def defect(k: Column, name: str) -> Column:
    by, rest = DEFECTS[name]
    return k % by == rest


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def spread(df: DataFrame, most: int | None = None) -> DataFrame:
    """The rows in as many partitions as there are cores, if the scan has fewer; or so many that each has ``most`` at most, about."""
    n = df.sparkSession.sparkContext.defaultParallelism
    if most and (needed := -(-df.count() // most)) > n:
        return df.repartition(needed)
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their maker and country; the maker is the supplier whose key is the part's modulo their number.

    The narrow rows are dealt out over all cores, since what is made of them costs far more than they do.
    """
    supplier = table(spark, sf_dir, "supplier")
    n = supplier.count()
    part = spread(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_brand", "p_size", "p_retailprice", "p_name"))
    maker = supplier.select(F.col("s_suppkey").alias("maker_key"), F.col("s_name").alias("maker"), F.col("s_nationkey").alias("nation_key"))
    return part.join(maker, F.col("k") % F.lit(max(1, n)) == F.col("maker_key"))


def lines(p: DataFrame) -> DataFrame:
    """The label's lines by name; null where a defect leaves one out."""
    return p.select("*", *built(("label lines",), _lines))


def _lines() -> list[Column]:
    k = F.col("k")
    money = F.format_string("%.2f", F.col("p_retailprice"))
    bare = F.concat(F.lit("1"), F.lpad(k.cast("string"), 13, "0"))
    number = F.when(defect(k, "noisy_license"), F.translate(bare, "0", "O")).otherwise(bare)
    month = F.format_string("%02d/%d", (k % 12 + 1).cast("int"), (k % 6 + 2020).cast("int"))
    unit = F.when(defect(k, "bad_unit"), "xyz").otherwise(_pick(LABEL_UNITS, k % 4))
    tax = F.when(defect(k, "no_tax"), "").otherwise(" (incl. of all taxes)")
    return [
        F.concat(F.lit("Pkd. Date: "), F.when(defect(k, "bad_date"), "8X/2Q26").otherwise(month)).alias("l_date"),
        F.when(~defect(k, "no_maker"), F.concat(F.lit("Marketed by: "), F.col("maker"), F.lit(" Foods Pvt Ltd, Plot 7"))).alias("l_maker"),
        F.concat(F.lit("MRP Rs. "), F.when(defect(k, "comma_price"), "1,").otherwise(""), money, tax).alias("l_price"),
        F.concat(F.lit("Net Quantity: "), F.col("p_size").cast("string"), F.lit(" "), unit).alias("l_quantity"),
        F.when(~defect(k, "no_care"), F.concat(F.lit("Customer Care: 1800-"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("-"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit(", care"), k.cast("string"), F.lit("@example.com"))).alias("l_care"),
        F.when(~defect(k, "no_license"), F.concat(F.lit("FSSAI Lic No: "), number)).alias("l_license"),
        F.when(~defect(k, "no_country"), F.concat(F.lit("Country of Origin: "), _pick(COUNTRIES, F.col("nation_key") % 5))).alias("l_country"),
    ]


ORDER = ("l_date", "l_maker", "l_price", "l_quantity", "l_care", "l_license", "l_country")


def _text(*names: str) -> Column:
    return F.concat_ws("\n    ", *names)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id, brand, view, text, is_food: a label of all lines per part."""
    p = lines(parts(spark, sf_dir))
    return p.select(F.col("k").alias("product_id"), F.col("p_brand").alias("brand"), F.lit("Front").alias("view"), _text(*ORDER).alias("text"), (F.col("k") % 10 != 0).alias("is_food"))


def label_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id, view_ord, view, image_path, confidence, text, is_food: three views per part.

    The front has date, maker, price and batch; the back price (10 more where the key is a multiple of 9, always with taxes),
    contact and licence; the side quantity and country.
    """
    p = lines(parts(spark, sf_dir))
    again = F.concat(F.lit("MRP Rs. "), F.format_string("%.2f", F.col("p_retailprice") + F.when(F.col("k") % 9 == 0, 10.0).otherwise(0.0)), F.lit(" (incl. of all taxes)"))
    p = p.withColumn("l_again", again).withColumn("l_batch", F.lit("Batch 1234512345"))
    texts = [_text("l_date", "l_maker", "l_price", "l_batch"), _text("l_again", "l_care", "l_license"), _text("l_quantity", "l_country")]
    views = F.array(*(F.struct(F.lit(i).alias("view_ord"), F.lit(v).alias("view"), F.lit(c).alias("confidence"), t.alias("text")) for i, ((v, c), t) in enumerate(zip(VIEWS, texts, strict=True))))
    p = p.select("k", F.inline(views))
    return p.select(F.col("k").alias("product_id"), "view_ord", "view", F.concat_ws("/", F.lit("images"), "k", F.concat("view_ord", F.lit(".png"))).alias("image_path"), "confidence", "text", (F.col("k") % 10 != 0).alias("is_food"))


def compositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id, text: an ingredient label per part, with one coded additive by key and a declaration on even keys."""
    k = F.col("p_partkey")
    said = F.when(k % 2 == 0, "Contains Wheat and Soy.").otherwise("")
    text = F.concat(
        F.lit("Ingredients: Sugar, Wheat Flour (Maida, Atta), Emulsifier (INS 471), Colour ("), F.when(k % 3 == 0, "E").otherwise("INS "), _pick(CODES, k % len(CODES)),
        F.lit("), "), F.when(k % 4 == 0, "Guar Gum").otherwise("Salt"), F.lit(".\n"),
        F.when(k % 5 == 0, "Nutritional Information per 100 g: Energy 450 kcal, Protein 7").otherwise("Best Before 6 months"), F.lit("\n"), said,
    )
    return spread(table(spark, sf_dir, "part").select("p_partkey")).select(k.alias("product_id"), text.alias("text"))
