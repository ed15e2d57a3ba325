"""The seven rules (R1-R9) and the score (A5) as Columns over a struct of fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import UNCERTAIN, built, let, once

#: Rule code, severity and field of each rule, in order.
RULES = [
    ("LM-01", "Major", "manufacturer_details"),
    ("LM-02", "Major", "net_quantity"),
    ("LM-03", "Major", "mrp"),
    ("LM-04", "Major", "manufacture_date"),
    ("LM-05", "Minor", "customer_care"),
    ("LM-06", "Major", "fssai_license"),
    ("LM-07", "Minor", "country_of_origin"),
]

#: What each rule asks for, in our words.
DESCRIPTIONS = {
    "LM-01": "Maker, packer or importer",
    "LM-02": "Net quantity",
    "LM-03": "Retail price with taxes",
    "LM-04": "Month of making or packing",
    "LM-05": "Consumer contact",
    "LM-06": "Food licence",
    "LM-07": "Country of origin",
}

EXPECTED = {
    "LM-01": "name and address of maker, packer or importer",
    "LM-02": "a quantity in a metric unit or a count",
    "LM-03": "a retail price that says it includes all taxes",
    "LM-04": "month and year of making, packing or import",
    "LM-05": "a telephone number or an e-mail address",
    "LM-06": "a licence number of 14 digits on food",
    "LM-07": "the country of origin or making",
}

RESULT = "struct<rule_code:string,severity:string,status:string,reason:string,detected_value:string,expected_condition:string,source_view:string,evidence_image_path:string,bounding_box:array<int>,confidence:double>"


def _filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def _verdict(code: str, f: Column, is_food: Column) -> Column:
    """Struct of passed and reason."""
    value, status = f["value"], F.coalesce(f["status"], F.lit("not_found"))
    uncertain = (status == "uncertain") | F.coalesce(value == UNCERTAIN, F.lit(False))
    found, low = status == "found", status == "low_confidence"
    taxed = F.coalesce(f["taxes_included"], F.lit(False))
    good = {
        "LM-01": (found & _filled(value) & (F.char_length(value) >= 8)) | (low & _filled(value)),
        "LM-02": found & _filled(value),
        "LM-03": found & taxed,
        "LM-04": (found | low) & _filled(value),
        "LM-05": _filled(f["phone"]) | _filled(f["email"]),
        "LM-06": found & (F.char_length(value) == 14),
        "LM-07": found & _filled(value),
    }[code]
    out = lambda ok, why: F.struct(F.lit(ok).alias("passed"), F.lit(why).alias("reason"))
    verdict = F.when(uncertain, out(False, "unreadable")).when(F.coalesce(good, F.lit(False)), out(True, "declared"))
    if code == "LM-03":
        verdict = verdict.when(_filled(value) & ~taxed, out(False, "taxes not declared"))
    verdict = verdict.otherwise(out(False, "missing"))
    return F.when(~is_food, out(True, "not applicable")).otherwise(verdict) if code == "LM-06" else verdict


def check(code: str, severity: str, f: Column, is_food: Column, evidence: bool = False) -> Column:
    """A rule's result; with evidence (R8) where the field says which view it came from.

    A confidence of null or 0 becomes 0.95 for a found field, 0.75 for a low one, else 0.
    """
    return let(_verdict(code, f, is_food), lambda v: _result(code, severity, f, v, evidence))


def _result(code: str, severity: str, f: Column, v: Column, evidence: bool) -> Column:
    assumed = F.when(f["status"] == "found", 0.95).when(f["status"] == "low_confidence", 0.75).otherwise(0.0)
    stated = F.when(f["confidence"] != 0, f["confidence"]) if evidence else F.lit(None)
    view = F.coalesce(F.when(f["source_view"] != "", f["source_view"]), F.lit("Front")) if evidence else F.lit("Front")
    return F.struct(
        F.lit(code).alias("rule_code"),
        F.lit(severity).alias("severity"),
        F.when(v["passed"], "Pass").otherwise("Fail").alias("status"),
        v["reason"].alias("reason"),
        f["value"].alias("detected_value"),
        F.lit(EXPECTED[code]).alias("expected_condition"),
        view.alias("source_view"),
        (f["evidence_image_path"] if evidence else F.lit(None)).alias("evidence_image_path"),
        (f["bounding_box"] if evidence else F.lit(None)).alias("bounding_box"),
        F.coalesce(stated, assumed).alias("confidence"),
    ).cast(RESULT)


def results(fields: Column, is_food: Column | bool = True, evidence: bool = False) -> Column:
    """The seven results in order."""
    food = is_food if isinstance(is_food, Column) else F.lit(is_food)
    food = F.coalesce(food, F.lit(True))
    return F.array(*(check(code, severity, fields[name], food, evidence) for code, severity, name in RULES))


def score(found: Column) -> Column:
    """A5: the share of passed rules in per cent, to one decimal; severity has no weight."""
    return F.round(F.size(F.filter(found, lambda r: r["status"] == "Pass")) / F.size(found) * 100.0, 1)


def overall(of: Column, threshold: float = 80.0) -> Column:
    return F.when(of >= threshold, "Compliant").otherwise("Non-Compliant")


def evaluate(df, fields: str = "fields", is_food: Column | bool = True, evidence: bool = False, threshold: float = 80.0):
    """Adds results, compliance_score and overall_status."""
    out = df.withColumn("__is_food", is_food if isinstance(is_food, Column) else F.lit(is_food))
    out = out.withColumn("results", built(("results", fields, evidence), lambda: once(results(F.col(fields), F.col("__is_food"), evidence)))).drop("__is_food")
    out = out.withColumn("compliance_score", score(F.col("results")))
    return out.withColumn("overall_status", overall(F.col("compliance_score"), threshold))


def violations(evaluated, *keys: str):
    """A row per rule and evaluated row, passes included."""
    return evaluated.select(*keys, F.explode(once(F.col("results"))).alias("__r")).select(*keys, "__r.*")
