"""Lists and dashboards (F1-F8, JN1-JN5, JN10, A1-A4, A14, O1-O3): one scan and conditional sums where there were loops.

inspections: id, inspector_id, product_name, brand, compliance_score, quality_score, ocr_confidence, overall_status,
image_path, created_at; violations: inspection_id, rule_code, status; users: id, name, email, role.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Principal:
    """Who asks."""

    id: int
    role: str = "inspector"


def target(who: Principal, inspector_id: int | None = None) -> int | None:
    """whose rows are seen: an inspector's own, an admin's choice, else everyone's."""
    return who.id if who.role == "inspector" else inspector_id if who.role == "admin" else None


def scope(df: DataFrame, who: Principal, inspector_id: int | None = None, column: str = "inspector_id") -> DataFrame:
    """F2 as a filter, which reaches the scan."""
    own = target(who, inspector_id)
    return df if own is None else df.filter(F.col(column) == own)


def by_id(df: DataFrame, value: int) -> DataFrame:
    """a point lookup."""
    return df.filter(F.col("id") == value)


def by_email(users: DataFrame, email: str) -> DataFrame:
    """a user by address, trimmed and in lower case; no credentials."""
    return users.filter(F.lower("email") == email.strip().lower())


def with_status(df: DataFrame, status: str | None) -> DataFrame:
    """F3."""
    return df if not status else df.filter(F.col("overall_status") == status)


def team(users: DataFrame) -> DataFrame:
    """inspectors and admins."""
    return users.filter(F.col("role").isin("inspector", "admin"))


def without_metadata(c: Column) -> Column:
    """F8: a map without keys that begin with an underscore."""
    return F.map_filter(c, lambda k, _: ~k.startswith("_"))


def newest_page(df: DataFrame, skip: int = 0, limit: int = 20) -> DataFrame:
    """O1: a page, newest first, of equals the larger id; a top-k of skip + limit rows."""
    if skip < 0 or not 1 <= limit <= 100:
        raise ValueError("skip is 0 or more and limit 1 to 100")
    return df.orderBy(F.desc("created_at"), F.desc("id")).offset(skip).limit(limit)


def summaries(page: DataFrame, users: DataFrame) -> DataFrame:
    """F5, JN2: the ten listed columns, defaults for what is null or empty, the owner's name."""
    names = users.select(F.col("id").alias("__u"), F.col("name").alias("__name"))
    joined = page.join(names, page["inspector_id"] == names["__u"], "left")
    return joined.select(
        "id", "product_name", "brand", "compliance_score", F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"), F.coalesce("ocr_confidence", F.lit(0.0)).alias("ocr_confidence"), "overall_status",
        "created_at", F.coalesce("__name", F.lit("Unknown Inspector")).alias("inspector_name"), F.when(F.coalesce(F.col("image_path"), F.lit("")) == "", "/storage/images/placeholder.png").otherwise(F.col("image_path")).alias("image_path"),
    )


def search(df: DataFrame, text: str, status: str | None = None) -> DataFrame:
    """a substring of product or brand without regard to case, or of the id; and a status."""
    t = F.lit(text.lower())
    hit = F.contains(F.lower("product_name"), t) | F.contains(F.lower("brand"), t) | F.contains(F.col("id").cast("string"), F.lit(text))
    return with_status(df.filter(F.coalesce(hit, F.lit(False))), status)


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100.0, 1)).otherwise(0.0)


def totals(inspections: DataFrame) -> DataFrame:
    """A1, A2: a row of total, compliant, non_compliant and rate, in one pass."""
    is_ = lambda s: F.count_if(F.col("overall_status") == s)
    out = inspections.agg(F.count(F.lit(1)).alias("total"), is_("Compliant").alias("compliant"), is_("Non-Compliant").alias("non_compliant"))
    return out.withColumn("compliance_rate", _rate(F.col("compliant"), F.col("total")))


def of_inspections(violations: DataFrame, inspections: DataFrame) -> DataFrame:
    """JN1: violations of the given (scoped) inspections; a semi join, since nothing else is asked of them."""
    return violations.join(inspections.select(F.col("id").alias("inspection_id")), "inspection_id", "left_semi")


def breakdown(violations: DataFrame, rules: DataFrame) -> DataFrame:
    """A3, JN4: failed and other results of each rule; rules without results have none, unknown codes describe themselves."""
    counts = violations.groupBy("rule_code").agg(F.count_if(F.coalesce(F.col("status"), F.lit("")) == "Fail").alias("f"), F.count_if(F.coalesce(F.col("status"), F.lit("")) != "Fail").alias("p"))
    out = rules.select("rule_code", "description").join(counts, "rule_code", "full")
    return out.select("rule_code", F.coalesce("description", "rule_code").alias("description"), F.coalesce("f", F.lit(0)).cast("long").alias("fail_count"), F.coalesce("p", F.lit(0)).cast("long").alias("pass_count"))


def trend(inspections: DataFrame, limit: int = 30, newest: bool = False) -> DataFrame:
    """O2, O3: the oldest (or newest) rows, of equals the smaller id, with a padded label and a short date."""
    order = [F.desc("created_at"), F.desc("id")] if newest else [F.asc("created_at"), F.asc("id")]
    rows = inspections.orderBy(*order).limit(limit)
    return rows.select("id", F.format_string("#%03d", "id").alias("label"), F.date_format("created_at", "dd MMM").alias("date"), F.col("product_name").alias("product"), F.col("compliance_score").alias("score"), F.col("overall_status").alias("status"))


def progress(inspections: DataFrame, users: DataFrame) -> DataFrame:
    """A4, JN5: each inspector's and admin's totals, rate, mean score and last inspection; zeros without any.

    Rows are summed by owner before they meet the users. Scores have one decimal, so their tenths are summed as whole
    numbers and the mean's half goes up, whatever the order of the rows.
    """
    per = inspections.groupBy("inspector_id").agg(
        F.count(F.lit(1)).alias("t"), F.count_if(F.col("overall_status") == "Compliant").alias("c"), F.count_if(F.col("overall_status") == "Non-Compliant").alias("n"), F.sum(F.round(F.col("compliance_score") * 10).cast("long")).alias("s"), F.max("created_at").alias("last_inspection_at")
    )
    out = team(users).join(per, F.col("id") == F.col("inspector_id"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        "id", "name", "email", "role", zero("t").alias("total_inspections"), zero("c").alias("compliant_count"), zero("n").alias("non_compliant_count"),
        F.coalesce(_rate(F.col("c"), F.col("t")), F.lit(0.0)).alias("compliance_rate"), F.coalesce(F.expr("(2 * s + t) div (2 * t)") / 10.0, F.lit(0.0)).alias("avg_score"), "last_inspection_at",
    )


def with_violations(inspections: DataFrame, violations: DataFrame) -> DataFrame:
    """JN3: each inspection with its results in order of rule."""
    per = violations.groupBy("inspection_id").agg(F.sort_array(F.collect_list(F.struct("rule_code", "status"))).alias("violations"))
    return inspections.join(per, F.col("id") == F.col("inspection_id"), "left").drop("inspection_id")


def passed_failed(violations: DataFrame) -> DataFrame:
    """Passed and failed results of each inspection."""
    return violations.groupBy("inspection_id").agg(F.count_if(F.col("status") == "Pass").alias("passed"), F.count_if(F.col("status") == "Fail").alias("failed"))


def linked_views(violations: DataFrame, images: DataFrame) -> DataFrame:
    """JN10: results and pictures of an inspection whose view names contain one another, without regard to case.

    The inspection is the key of the join; only its eight pictures at most are compared.
    """
    v = violations.select("inspection_id", "rule_code", F.lower("source_view").alias("__s"))
    i = images.select("inspection_id", "view", F.lower("view").alias("__v"))
    both = (F.col("__s") != "") & (F.col("__v") != "") & (F.contains("__s", "__v") | F.contains("__v", "__s"))
    return v.join(i, "inspection_id").filter(both).drop("__s", "__v")


def ranked_owners(inspections: DataFrame) -> DataFrame:
    """Ours: owners by rate, best first.

    A rate has one decimal, so there are 1,001 of them at most: their owners are counted, the window runs over those
    counts alone, and the ranks go back to the owners.
    """
    from pyspark.sql import Window

    per = inspections.groupBy("inspector_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("overall_status") == "Compliant").alias("compliant"))
    per = per.withColumn("compliance_rate", _rate(F.col("compliant"), F.col("total")))
    better = F.sum("n").over(Window.orderBy(F.desc("compliance_rate")).rowsBetween(Window.unboundedPreceding, -1))
    ranks = per.groupBy("compliance_rate").agg(F.count(F.lit(1)).alias("n")).select("compliance_rate", (F.coalesce(better, F.lit(0)) + 1).alias("rank"))
    return per.join(F.broadcast(ranks), "compliance_rate").select("inspector_id", "total", "compliant", "compliance_rate", "rank")


def rolling_rate(inspections: DataFrame, rows: int = 10) -> DataFrame:
    """Ours: an owner's rate over the last rows up to each."""
    from pyspark.sql import Window

    w = Window.partitionBy("inspector_id").orderBy("created_at", "id").rowsBetween(1 - rows, 0)
    return inspections.select("id", "inspector_id", F.round(F.avg((F.col("overall_status") == "Compliant").cast("int")).over(w) * 100.0, 1).alias("rolling_rate"))


def status_rollup(inspections: DataFrame) -> DataFrame:
    """Ours: counts by brand and status with subtotals."""
    return inspections.rollup("brand", "overall_status").agg(F.count(F.lit(1)).alias("n"))
