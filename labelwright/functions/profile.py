"""Ingredients, nutrition panel, additives and allergens (K1-K7, JN6-JN8, A6) as Columns over a label's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelwright.sources.dimensions import ADDITIVES, ALLERGENS

from .text import built, let, once, split_items, squeeze, strip, title

SECTION = r"(?isdU)(?:Ingredients|Composition|Ingr[eé]dients|Contains|Contents)[\s\:\-]+(.+?)(?=(?:Nutritional|Nutrition|Best\s*Before|Mfg|Manufactured|Net\s*Q|Customer|FSSAI|Country|Allergen\s*Info|\z))"
DECLARED = r"(?idU)(?:Allergen\s*(?:Advice|Warning|Information)|Contains|May\s*Contain)[\s\:\-]+(.+?)(?=(?:Nutritional|Mfg|Best\s*Before|FSSAI|\n\n|\z))"
CODE = r"(?iU)\b(?:INS|E)[\s\-\.]*(\d{3,4}(?:\([a-z0-9]+\)|[a-z])?)\b"

#: Classes of ingredients in the order they are tried, and words that suggest a list without a heading.
CLASSES = [
    ("Food Additive", r"(?U)\bins\s*\d+|\be\s*\d+|emulsifier|stabilizer|preservative|regulator|raising\s*agent|flavor"),
    ("Allergenic Ingredient", r"milk|soy|wheat|peanut|almond|cashew|egg|fish|sesame|gluten"),
    ("Primary Commodity", r"sugar|salt|oil|flour|cocoa|water|butter|syrup|spice"),
]
COMMON = ["sugar", "salt", "flour", "cocoa", "milk solids", "palm oil", "lecithin"]

#: Signs of a nutrition panel.
PANEL = [
    r"(?iU)nutrition(?:al)?\s*(?:facts|information|values|panel)?",
    r"(?iU)per\s*100\s*(?:g|ml)",
    r"(?iU)energy\s*[:\s]*\d+\s*(?:kcal|kj)",
    r"(?iU)protein\s*[:\s]*\d+",
    r"(?iU)carbohydrate\s*[:\s]*\d+",
    r"(?iU)total\s*fat\s*[:\s]*\d+",
]

ITEM = "struct<name:string,category:string>"
ADDITIVE = "struct<identifier:string,common_name:string,function:string,risk_level:string,detected_token:string,recognized:boolean>"


def category(name: Column) -> Column:
    """K2: an ingredient's class."""

    def of(lower: Column) -> Column:
        c = F.lit("Ingredient")
        for label, pattern in reversed(CLASSES):
            c = F.when(lower.rlike(pattern), label).otherwise(c)
        return c

    return let(F.lower(name), of)


def ingredients(text: Column) -> Column:
    """K1, K3: struct of found, raw_text and items.

    The first heading's section, squeezed and cut at 600 characters, split outside brackets; without a heading, two or
    more common words stand for the list.
    """

    def headed(section: Column) -> Column:
        names = F.transform(split_items(section), lambda x: strip(F.regexp_replace(x, r"(?U)^[\d\.\-\s]+", "")))
        names = F.filter(names, lambda x: (F.char_length(x) >= 2) & ~F.lower(x).isin("and", "contains", "ingredients"))
        items = F.transform(names, lambda x: F.struct(x.alias("name"), category(x).alias("category")))
        return F.struct(F.lit(True).alias("found"), section.alias("raw_text"), items.alias("items"))

    words = F.array_compact(F.array(*(F.when(text.rlike(rf"(?iU)\b{w}\b"), F.lit(w)) for w in COMMON)))

    def inferred(found: Column) -> Column:
        items = F.transform(found, lambda w: F.struct(title(w).alias("name"), F.lit("Primary Commodity").alias("category")))
        some = F.size(found) >= 2
        return F.struct(some.alias("found"), F.when(some, F.array_join(found, ", ")).otherwise("").alias("raw_text"), F.when(some, items).otherwise(F.array().cast(f"array<{ITEM}>")).alias("items"))

    whole = F.regexp_extract(text, SECTION, 1)
    return F.when(text.rlike(SECTION), let(F.substring(F.regexp_replace(strip(whole), r"(?U)[\s\x1C-\x1F]+", " "), 1, 600), headed)).otherwise(let(words, inferred))


def nutrition(text: Column) -> Column:
    """K4: struct of detected, confidence and matched_elements."""
    found = F.array_compact(F.array(*(F.when(text.rlike(p), strip(F.regexp_extract(text, p, 0))) for p in PANEL)))
    return let(found, lambda m: F.struct((F.size(m) >= 2).alias("detected"), F.round(F.least(F.lit(1.0), F.size(m) / 4.0), 2).alias("confidence"), m.alias("matched_elements")))


def knowledge(rows=ADDITIVES) -> Column:
    """The additives as a constant array, in order."""
    names = ("identifier", "common_name", "function", "risk_level")
    return F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(names, (r[0], r[2], r[3], r[4]), strict=True)), F.array(*map(F.lit, r[1])).alias("aliases")) for r in rows))


def lookup(token: Column, strict: bool = False, rows=ADDITIVES) -> Column:
    """JN6: the first known additive with the token as an alias, plain or with its prefix spaced.

    A token that begins with "ins" also takes an additive of which it contains an alias, unless strict.
    """

    def of(t: Column) -> Column:
        spaced = squeeze(F.replace(F.replace(F.replace(t, F.lit("e-"), F.lit("e")), F.lit("ins-"), F.lit("ins ")), F.lit("ins"), F.lit("ins ")))

        def hit(k: Column) -> Column:
            exact = F.array_contains(k["aliases"], t) | F.array_contains(k["aliases"], spaced)
            return exact if strict else exact | (t.startswith("ins") & F.exists(k["aliases"], lambda a: F.contains(t, a)))

        return F.get(F.filter(knowledge(rows), hit), F.lit(0))

    return let(F.lower(strip(token)), of)


def additives(text: Column, items: Column, strict: bool = False, rows=ADDITIVES) -> Column:
    """K5, JN7: coded additives in the order of their first code, then known ones that an ingredient names.

    A code that isn't known gives a record of its own at yellow. A named additive is left out if its identifier is
    among the codes, which are written INS and number.
    """
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(CODE), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(CODE), F.lit(1)).alias("num"))
    codes = F.transform(pairs, lambda p: F.struct(squeeze(F.replace(F.upper(p["all"]), F.lit("-"), F.lit(" "))).alias("raw"), F.lower(p["num"]).alias("num")))

    def of(found: Column) -> Column:
        numbers = F.transform(found, lambda c: c["num"])
        first = let(numbers, lambda n: F.filter(found, lambda c, i: F.array_position(n, c["num"]) == i + 1))

        def decoded(c: Column) -> Column:
            return let(
                F.coalesce(lookup(c["raw"], strict, rows), lookup(c["num"], strict, rows)),
                lambda k: F.when(
                    k.isNotNull(), F.struct(*(k[x].alias(x) for x in ("identifier", "common_name", "function", "risk_level")), c["raw"].alias("detected_token"), F.lit(True).alias("recognized"))
                ).otherwise(
                    F.struct(
                        c["raw"].alias("identifier"), F.concat(F.lit("Additive "), c["raw"]).alias("common_name"), F.lit("Not indexed").alias("function"), F.lit("yellow").alias("risk_level"),
                        c["raw"].alias("detected_token"), F.lit(False).alias("recognized"),
                    )
                ),
            )

        keys = F.transform(numbers, lambda n: F.concat(F.lit("INS "), n))

        def named(k: Column, i: Column) -> Column:
            where = F.filter(F.transform(items, lambda x, j: F.struct(j.alias("j"), x["name"].alias("name"))), lambda x: F.contains(F.lower(x["name"]), F.lower(k["common_name"])))
            return let(
                F.get(where, F.lit(0)),
                lambda w: F.when(
                    w.isNotNull() & ~F.array_contains(keys, k["identifier"]),
                    F.struct(w["j"].alias("j"), i.alias("i"), F.struct(*(k[x].alias(x) for x in ("identifier", "common_name", "function", "risk_level")), w["name"].alias("detected_token"), F.lit(True).alias("recognized")).alias("a")),
                ),
            )

        extra = F.transform(F.array_sort(F.array_compact(F.transform(knowledge(rows), named))), lambda x: x["a"])
        return F.concat(F.transform(first, decoded).cast(f"array<{ADDITIVE}>"), extra.cast(f"array<{ADDITIVE}>"))

    return let(codes, of)


def _keyword(text: Column, lower: Column, keywords: list[str], flags: str, strict: bool) -> Column:
    """JN8: the first keyword that stands between word boundaries; strict also takes a plural s."""
    escape = lambda k: "".join("\\" + c if not c.isalnum() and c != " " else c for c in k)
    hits = (F.when(F.contains(lower, F.lit(k)) & text.rlike(rf"(?{flags})\b{escape(k)}{'s?' * strict}\b"), F.lit(k)) for k in keywords)
    return F.coalesce(*hits, F.lit(None).cast("string"))


def allergens(text: Column, items: Column, strict: bool = False) -> Column:
    """K6: declared allergens, then those inferred from text and ingredient names; one record each, declared ones first."""
    snippet = strip(F.regexp_extract(text, DECLARED, 0))
    everything = F.concat(F.lower(text), F.when(F.size(items) > 0, F.concat(F.lit(" "), F.array_join(F.transform(items, lambda x: F.lower(x["name"])), " "))).otherwise(""))

    def of(x: Column) -> Column:
        said, implied = x["said"], x["all"]
        one = lambda name, label, severity, kw, declared: F.when(kw.isNotNull(), F.struct(F.lit(name).alias("allergen"), F.lit(label).alias("display_name"), F.lit(severity).alias("severity"), kw.alias("trigger_keyword"), F.lit(declared).alias("is_explicit")))
        explicit = F.array(*(one(n, label, sev, _keyword(said, x["low"], kws, "iU", strict), True) for n, label, sev, kws in ALLERGENS))
        inferred = F.array(*(one(n, label, sev, _keyword(implied, implied, kws, "U", strict), False) for n, label, sev, kws in ALLERGENS))
        both = F.struct(explicit.alias("e"), inferred.alias("i"))
        return let(both, lambda b: F.concat(F.array_compact(b["e"]), F.array_compact(F.zip_with(b["e"], b["i"], lambda e, i: F.when(e.isNull(), i)))))

    return let(F.struct(snippet.alias("said"), F.lower(snippet).alias("low"), everything.alias("all")), of)


def risks(found: Column) -> Column:
    """Additives by risk level."""
    def at(level: str) -> Column:
        return F.size(F.filter(found, lambda a: a["risk_level"] == level)).cast("long").alias(level)

    return F.struct(*map(at, ("green", "yellow", "orange", "red")))


def confidence(has_list: Column, n_additives: Column, n_allergens: Column) -> Column:
    """K7: how well founded a profile is."""
    base = F.when(has_list, 0.85).otherwise(0.60)
    base = F.when(n_additives > 0, F.least(F.lit(0.96), base + 0.08)).otherwise(base)
    base = F.when(n_allergens > 0, F.least(F.lit(0.98), base + 0.04)).otherwise(base)
    return F.round(base, 2)


def profile(df, text: str = "text", strict: bool = False):
    """K7: adds ingredients, additives, allergens, nutrition, risks and evidence_confidence; a null text is empty."""
    t, items = F.col("__text"), F.col("ingredients.items")
    out = df.withColumn("__text", F.coalesce(F.col(text), F.lit(""))).withColumn("ingredients", built(("ingredients",), lambda: once(ingredients(t))))
    found = {
        "additives": built(("additives", strict), lambda: once(additives(t, items, strict))),
        "allergens": built(("allergens", strict), lambda: once(allergens(t, items, strict))),
        "nutrition": built(("nutrition",), lambda: nutrition(t)),
    }
    out = out.withColumns(found).drop("__text").withColumn("risks", risks(F.col("additives")))
    return out.withColumn("evidence_confidence", confidence(F.col("ingredients.found"), F.size("additives"), F.size("allergens")))
