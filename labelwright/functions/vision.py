"""Answers of a vision service as fields (J1, J2, M7), and their consensus with locally extracted fields (M6, JN12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .extract import FIELDS, field
from .text import agreed, let, strip, title

#: The flat keys of an answer.
ANSWER = (
    "struct<manufacturer_name_and_address:string,net_quantity_declared:string,mrp_declared_value:string,mrp_taxes_inclusive_declared:boolean,mrp_numeric_amount:double,"
    "mfg_month_and_year:string,customer_care_phone:string,customer_care_email:string,fssai_license_14_digit:string,country_of_origin:string>"
)

#: What an analysis holds if it can't be read.
ANALYSIS = {"packaging_type": "Packaged Commodity", "legibility_score": 85, "visual_clarity": "Good", "lighting_condition": "Balanced", "glare_detected": False, "glare_severity": "None", "surface_curvature": "Flat", "is_truncated": False, "recommended_opencv_variant": "variant_a"}
ANALYSIS_TYPE = "struct<packaging_type:string,legibility_score:int,visual_clarity:string,lighting_condition:string,glare_detected:boolean,glare_severity:string,surface_curvature:string,is_truncated:boolean,recommended_opencv_variant:string>"

RANKS = {"not_found": 0, "uncertain": 1, "low_confidence": 2, "found": 3}


def fenced_json(c: Column) -> Column:
    """The JSON in a json fence, else in a bare fence, else the text itself; null if it can't be parsed."""

    def of(t: Column) -> Column:
        inside = lambda p: F.when(t.rlike(p), strip(F.regexp_extract(t, p, 1))).otherwise(t)
        payload = F.when(F.contains(t, F.lit("```json")), inside(r"(?sU)```json\s*(.+?)\s*```")).when(F.contains(t, F.lit("```")), inside(r"(?sU)```\s*(.+?)\s*```")).otherwise(t)
        return let(payload, lambda p: F.when((p != "") & F.try_parse_json(p).isNotNull(), p))

    return let(strip(c), of)


def analysis(c: Column) -> Column:
    """An analysis with its source; the defaults if it can't be parsed."""
    fallback = F.struct(*(F.lit(v).alias(k) for k, v in ANALYSIS.items())).cast(ANALYSIS_TYPE)
    return let(fenced_json(c), lambda j: F.struct(F.when(j.isNotNull(), F.from_json(j, ANALYSIS_TYPE)).otherwise(fallback).alias("analysis"), F.when(j.isNotNull(), "vision").otherwise("fallback").alias("source")))


def _given(c: Column) -> Column:
    """Trimmed; null, blank and the word null are missing."""
    return let(strip(c), lambda v: F.when((v != "") & (F.lower(v) != "null"), v))


def adapt(answer: Column) -> Column:
    """M7: the seven fields of an answer (a struct of type ANSWER; null: nothing found)."""
    g = lambda k: _given(answer[k])
    plain = lambda v: F.when(v.isNotNull(), field(v, "found", v)).otherwise(field())
    maker = let(g("manufacturer_name_and_address"), lambda v: F.when(v.isNotNull(), field(F.substring(v, 1, 180), F.when(F.char_length(v) >= 8, "found").otherwise("low_confidence"), F.substring(v, 1, 200))).otherwise(field()))
    net = let(F.regexp_replace(g("net_quantity_declared"), r"(?U)(\d+)([a-zA-Z]+)", "$1 $2"), plain)
    taxed = F.coalesce(answer["mrp_taxes_inclusive_declared"], F.lit(False))
    tag = F.when(taxed, " (incl. of all taxes)").otherwise(" (taxes NOT declared)")

    def priced(v: Column) -> Column:
        stated = F.when(answer["mrp_numeric_amount"] != 0, answer["mrp_numeric_amount"])
        amount = F.coalesce(stated, F.regexp_extract(v, r"(\d+(?:\.\d{1,2})?)", 1).try_cast("double"))
        shown = F.when(amount != 0, F.format_string("%.2f", amount)).otherwise(v)
        return F.when(v.isNotNull(), field(F.concat(F.lit("₹ "), shown, tag), F.when(taxed, "found").otherwise("low_confidence"), F.concat(v, tag), amount, taxed)).otherwise(field(taxes_included=False))

    def care(x: Column) -> Column:
        p, e = x["p"], x["e"]
        both = F.concat(F.lit("Phone: "), p, F.lit(", Email: "), e)
        one = F.coalesce(F.concat(F.lit("Phone: "), p), F.concat(F.lit("Email: "), e))
        return F.when(both.isNotNull(), field(both, "found", both, phone=p, email=e)).when(one.isNotNull(), field(one, "low_confidence", one, phone=p, email=e)).otherwise(field())

    def licensed(d: Column) -> Column:
        n = F.char_length(d)
        return F.when(n == 14, field(d, "found", d)).when(n >= 10, field(d, "low_confidence", d)).otherwise(field())

    return F.struct(
        maker.alias("manufacturer_details"),
        net.alias("net_quantity"),
        let(g("mrp_declared_value"), priced).alias("mrp"),
        let(g("mfg_month_and_year"), plain).alias("manufacture_date"),
        let(F.struct(g("customer_care_phone").alias("p"), g("customer_care_email").alias("e")), care).alias("customer_care"),
        let(F.regexp_replace(g("fssai_license_14_digit"), r"(?U)\D", ""), licensed).alias("fssai_license"),
        let(title(g("country_of_origin")), plain).alias("country_of_origin"),
    )


def rank(status: Column) -> Column:
    """How good a status is: 0 not found to 3 found."""
    return F.when(status == "found", 3).when(status == "low_confidence", 2).when(status == "uncertain", 1).otherwise(0)


def consensus(vision: Column, local: Column) -> Column:
    """M6, JN12: an array of field, tag, source, value, status and local value, a struct per field in order.

    Both at least low: the vision field, verified if one normalised value contains the other (an empty one is contained),
    else preferred. Else the better one; of equals the vision field.
    """

    def one(name: str) -> Column:
        def of(x: Column) -> Column:
            g, l = x["g"], x["l"]
            gs, ls = rank(g["status"]), rank(l["status"])
            # A missing value reads as the word none.
            gv, lv = agreed(F.coalesce(g["value"], F.lit("none"))), agreed(F.coalesce(l["value"], F.lit("none")))
            both = (gs >= 2) & (ls >= 2)
            tag = F.when(both & (F.contains(lv, gv) | F.contains(gv, lv)), "verified").when(both, "vision_preferred").when(gs > ls, "vision_exclusive").when(ls > gs, "local_exclusive").otherwise("none")
            chosen = F.when(~both & (ls > gs), l).otherwise(g)
            return F.struct(F.lit(name).alias("field"), tag.alias("consensus"), chosen["value"].alias("value"), chosen["status"].alias("status"), both.alias("cross_validated"), F.when(both, l["value"]).alias("local_value"), chosen.alias("chosen"))

        return let(F.struct(vision[name].alias("g"), local[name].alias("l")), of)

    return F.array(*(one(n) for n in FIELDS))


def fields_of(found: Column) -> Column:
    """The chosen fields of a consensus, as a struct that rules can read."""
    return F.struct(*(F.get(found, F.lit(i))["chosen"].alias(n) for i, n in enumerate(FIELDS)))
