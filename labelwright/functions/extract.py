"""Validators (T8-T11) and the seven field extractors (X1-X8) as Columns: leftmost matches, no Python on the workers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import UNCERTAIN, built, canonical_unit, clean_lines, fix_digits, fix_unit, fix_words, is_unit, let, once, split_lines, squeeze, strip, title

__all__ = ["FIELDS", "FIELD", "license_number", "quantity", "price", "date", "extract_fields", "EXTRACTORS", "split_lines"]

FIELDS = ("manufacturer_details", "net_quantity", "mrp", "manufacture_date", "customer_care", "fssai_license", "country_of_origin")

#: An extracted field.
FIELD = "struct<value:string,status:string,raw_snippet:string,amount:double,taxes_included:boolean,phone:string,email:string>"

NUMBER = r"^(?:\d+\.?\d*|\.\d+)$"
AMOUNT = r"[0-9OIl!sSBZzGD\.,]+"
AMOUNT_ON_LABEL = r"[0-9OIl!sSBZzG\.,]+"

#: Where the fields stand on a label.
MAKER = r"(?isdU)(?:Mfg\b|Manufactured\s+by|Marketed\s+by|Packed\s+by|Imported\s+by|Pkd\s+by)[\s\:\-]+(.+?)(?=(?:MRP|Net\s*Q|Best\s*Before|Customer|FSSAI|Country|$))"
COMPANY = r"(?idU)([A-Z][A-Za-z0-9\s.,&\-]+(?:Pvt\.?\s*Ltd\.?|Ltd\.?|Industries|Foods|Enterprises|Corporation)[^\n\r]*)"
COMPANY_WORDS = r"(?idU)Ltd|Industries|Foods|Enterprises|Corporation"
QUANTITY = rf"(?iU)Net\s*(?:Quantity|Qty|Weight|Wt|Volume|Vol)[.:\s]*({AMOUNT_ON_LABEL}\s*[a-zA-Z]+)"
ANY_QUANTITY = rf"(?iU)\b({AMOUNT_ON_LABEL}\s*(?:kg|g|gm|gms|grams|ml|l|ltr|litres|liters|pieces|pcs|units|N|count))\b"
PRICE = rf"(?iU)(?:M\.?R\.?P\.?|MRP|Max\s*Retail\s*Price)[.:\s]*(?:Rs\.?|INR|₹)?\s*({AMOUNT_ON_LABEL})"
TAXES = r"(?iU)(?:incl(?:usive)?\.?\s*(?:of)?\s*all\s*taxes|incl\.?\s*taxes)"
ANY_PRICE = rf"(?iU)(?:Rs\.?|₹)\s*({AMOUNT_ON_LABEL})"
DATE = r"(?iU)(?:Mfg|Manufactured|Packed|Packing|Pkg|PKD|Mfd|Date|Dt)[.:\s]*(?:Date|Dt)?[:.\s]*([A-Za-z0-9\/\-\.\s]{3,15})"
PHONE = r"(?iU)(?:(?:Tel|Phone|Ph|Call|Helpline|Toll[\s\-]*Free|Care)[\s.:]*)?(1800[\s\-]*[0-9OIl!]{3}[\s\-]*[0-9OIl!]{3,4}|[6-9][0-9OIl!]{9}|\b[0-9OIl!]{3,5}[\-\s][0-9OIl!]{6,8}\b)"
EMAIL = r"(?iU)([a-zA-Z0-9_.+\-]+@[a-zA-Z0-9\-]+\.[a-zA-Z0-9\-.]+)"
LICENSE = r"(?iU)(?:FSSAI|Lic(?:ense)?\.?\s*(?:No)?)[\s.:]*([A-Za-z0-9\s]{10,20})"
COUNTRY = r"(?idU)(?:Country\s*of\s*Origin|Made\s*in|Product\s*of)[:\s]*([A-Za-z0-9\s]+?)(?=[\n,.]|$)"
HOME = r"(?iU)\b(?:India|Bharat|1NDIA)\b"
DAY = r"(?U)\b(0[1-9]|[12]\d|3[01])[\/\-\.](0[1-9]|1[0-2])[\/\-\.](20\d{2}|\d{2})\b"
MONTH = r"(?U)\b(0[1-9]|1[0-2]|[1-9])[\/\-\.](20\d{2}|\d{2})\b"
NAMED = r"(?iU)\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[\s\/\-\.]+(20\d{2}|\d{2})\b"


def _checked(value: Column | str | None, valid: bool) -> Column:
    value = value if isinstance(value, Column) else F.lit(value).cast("string")
    return F.struct(value.alias("value"), F.lit(valid).alias("valid"))


NOTHING, UNREADABLE = (None, False), (UNCERTAIN, False)


def license_number(c: Column) -> Column:
    """Struct of value and valid: 14 digits are valid, 10 to 16 uncertain, else there is none."""

    def of(d: Column) -> Column:
        n = F.char_length(d)
        return F.when(n == 14, _checked(d, True)).when(n.between(10, 16), _checked(*UNREADABLE)).otherwise(_checked(*NOTHING))

    return let(F.regexp_replace(fix_digits(F.coalesce(c, F.lit(""))), r"(?U)\D", ""), of)


def _plain(number: Column) -> Column:
    """A decimal text without leading zeros and without a fraction of zeros."""
    whole = F.regexp_replace(F.regexp_extract(number, r"^(\d*)", 1), "^0+(?=.)", "")
    fraction = F.regexp_replace(F.regexp_extract(number, r"\.(\d*)$", 1), "0+$", "")
    return F.concat(F.when(whole == "", "0").otherwise(whole), F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)))


def quantity(c: Column) -> Column:
    """Struct of value and valid: a positive number and an accepted unit."""
    pattern = rf"(?iU)({AMOUNT})\s*([a-zA-Z]+)"
    parts = F.struct(fix_digits(F.regexp_extract(c, pattern, 1)).alias("n"), fix_unit(F.regexp_extract(c, pattern, 2)).alias("u"), c.rlike(pattern).alias("m"))

    def of(p: Column) -> Column:
        is_number = p["n"].rlike(NUMBER)
        positive = F.when(is_number, p["n"].try_cast("double") > 0).otherwise(False)
        return (
            F.when(~F.coalesce(p["m"], F.lit(False)) | ~is_unit(p["u"]), _checked(*NOTHING))
            .when(positive, _checked(F.concat(_plain(p["n"]), F.lit(" "), canonical_unit(p["u"])), True))
            .otherwise(_checked(*UNREADABLE))
        )

    return let(parts, of)


def price(c: Column, strict: bool = False) -> Column:
    """Struct of value (two decimals), valid and amount: over 0, up to a million.

    strict drops commas that separate thousands, which else are read as decimal points.
    """
    found = F.regexp_extract(c, rf"(?iU)(?:Rs\.?|INR|₹|MRP)?\s*({AMOUNT})", 1)
    if strict:
        found = F.regexp_replace(found, r",(?=\d{3}(?:\D|$))", "")

    def of(n: Column) -> Column:
        amount = F.when(n.rlike(NUMBER), n.try_cast("double"))
        ok = F.coalesce((amount > 0) & (amount <= 1_000_000), F.lit(False))
        text = F.when(n == "", F.lit(None)).when(ok, F.format_string("%.2f", amount)).otherwise(UNCERTAIN)
        return F.struct(text.cast("string").alias("value"), ok.alias("valid"), F.when(ok, amount).alias("amount"))

    return let(fix_digits(F.coalesce(found, F.lit(""))), of)


def _year(c: Column) -> Column:
    return F.when(F.char_length(c) == 2, 2000 + c.try_cast("int")).otherwise(c.try_cast("int"))


def date(c: Column) -> Column:
    """Struct of value and valid: day, else month, else named month, of the years 2015 to 2035; no calendar is asked."""

    def read(n: Column, pattern: str, between: str, written: Callable[[Column, Column], Column]) -> Column:
        """The first match as it is written, null without one or in another year; parts: what stands between separators."""
        dated = lambda parts: let(_year(F.element_at(parts, -1)), lambda y: F.when(y.between(2015, 2035), written(parts, y.cast("string"))))
        return let(F.regexp_extract(n, pattern, 0), lambda m: F.when(m != "", let(F.split(m, between), dated)))

    def of(x: Column) -> Column:
        found = F.coalesce(
            read(x["n"], DAY, r"[/\-.]", lambda p, y: F.concat_ws("/", p[0], p[1], y)),
            read(x["n"], MONTH, r"[/\-.]", lambda p, y: F.concat(F.lpad(p[0], 2, "0"), F.lit("/"), y)),
            read(x["c"], NAMED, r"(?U)[\s/\-.]", lambda p, y: F.concat(F.upper(F.substring(p[0], 1, 1)), F.lower(F.substring(p[0], 2, 2)), F.lit(" "), y)),
        )
        return let(found, lambda v: F.when(v.isNotNull(), _checked(v, True)).otherwise(_checked(*NOTHING)))

    return let(F.struct(fix_digits(F.coalesce(c, F.lit(""))).alias("n"), F.coalesce(c, F.lit("")).alias("c")), of)


def field(value=None, status="not_found", raw_snippet=None, amount=None, taxes_included=None, phone=None, email=None) -> Column:
    """An extracted field; what isn't given is null."""
    own = {"value": value, "status": status, "raw_snippet": raw_snippet, "amount": amount, "taxes_included": taxes_included, "phone": phone, "email": email}
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in own.items())).cast(FIELD)


def _match(text: Column, pattern: str, group: int = 1) -> Column:
    """Struct of the leftmost match, which is never empty: whether there is one, all of it, a group."""
    own = lambda m: F.when(m == "", m).otherwise(F.regexp_extract(text, pattern, group))
    return let(F.regexp_extract(text, pattern, 0), lambda m: F.struct((m != "").alias("is"), m.alias("all"), own(m).alias("own")))


def maker(text: Column) -> Column:
    """X1."""

    def cued(m: Column) -> Column:
        return let(
            squeeze(fix_words(m["own"])),
            lambda v: F.when(F.char_length(v) >= 10, field(F.substring(v, 1, 180), "found", F.substring(m["all"], 1, 200))).otherwise(field(v, "low_confidence", F.substring(m["all"], 1, 100))),
        )

    def company(m: Column) -> Column:
        return F.when(m["is"], field(F.substring(squeeze(fix_words(m["own"])), 1, 180), "low_confidence", F.substring(m["all"], 1, 150))).otherwise(field())

    # A text without one of its words has no company; the pattern itself is tried from every letter to the end.
    return let(_match(text, MAKER), lambda m: F.when(m["is"], cued(m)).when(text.rlike(COMPANY_WORDS), let(_match(text, COMPANY), company)).otherwise(field()))


def net_quantity(text: Column) -> Column:
    """The labelled quantity, else the first number and unit that is valid or uncertain."""
    general = F.transform(F.regexp_extract_all(text, F.lit(ANY_QUANTITY), F.lit(1)), lambda s: F.struct(s.alias("s"), quantity(s).alias("q")))

    def verdict(q: Column, snippet: Column, otherwise: Column) -> Column:
        return F.when(q["valid"], field(q["value"], "found", snippet)).when(q["value"] == UNCERTAIN, field(UNCERTAIN, "uncertain", snippet)).otherwise(otherwise)

    other = let(F.get(F.filter(general, lambda x: x["q"]["value"].isNotNull()), F.lit(0)), lambda x: F.when(x.isNull(), field()).otherwise(verdict(x["q"], x["s"], field())))
    named = let(_match(text, QUANTITY), lambda m: F.when(m["is"], let(quantity(m["own"]), lambda q: verdict(q, m["all"], F.lit(None).cast(FIELD)))))
    return F.coalesce(named, other)


def mrp(text: Column, strict: bool = False) -> Column:
    """X3."""

    def tagged(m: Column) -> Column:
        def of(p: Column) -> Column:
            taxed = text.rlike(TAXES)
            start = F.regexp_instr(text, F.lit(PRICE)) - 1
            begin = F.greatest(F.lit(0), start - 20)
            window = strip(F.substring(text, begin + 1, start + F.char_length(m["all"]) + 50 - begin))
            value = F.concat(F.lit("₹ "), p["value"], F.when(taxed, " (incl. of all taxes)").otherwise(" (taxes NOT declared)"))
            good = field(value, F.when(taxed, "found").otherwise("low_confidence"), window, p["amount"], taxed)
            return F.when(p["valid"], good).otherwise(field(UNCERTAIN, "uncertain", m["all"], None, False))

        return let(price(m["own"], strict), of)

    def bare(m: Column) -> Column:
        return let(
            price(m["own"], strict),
            lambda p: F.when(m["is"] & p["valid"], field(F.concat(F.lit("₹ "), p["value"], F.lit(" (unverified MRP tag)")), "low_confidence", m["all"], p["amount"], False)).otherwise(field(taxes_included=False)),
        )

    return let(_match(text, PRICE), lambda m: F.when(m["is"], tagged(m)).otherwise(let(_match(text, ANY_PRICE), bare)))


def manufacture_date(text: Column) -> Column:
    """X4."""

    def of(m: Column) -> Column:
        cued = F.when(m["is"], let(date(strip(m["own"])), lambda d: F.when(d["valid"], field(d["value"], "found", m["all"]))))
        anywhere = let(date(text), lambda d: F.when(d["valid"], field(d["value"], "low_confidence", d["value"])))
        corrupt = F.when(m["is"] & (F.char_length(strip(m["own"])) >= 4), field(UNCERTAIN, "uncertain", m["all"]))
        return F.coalesce(cued, anywhere, corrupt, field())

    return let(_match(text, DATE), of)


def customer_care(text: Column) -> Column:
    """X5."""
    found = let(
        fix_digits(F.regexp_extract(text, PHONE, 1)),
        lambda p: let(F.regexp_replace(p, r"(?U)\D", ""), lambda d: F.when(F.char_length(d).isin(10, 11) | d.startswith("1800"), p)),
    )
    mail = let(squeeze(F.regexp_extract(text, EMAIL, 1)), lambda e: F.when(e != "", e))

    def of(x: Column) -> Column:
        p, e = x["p"], x["e"]
        one = F.coalesce(F.concat(F.lit("Phone: "), p), F.concat(F.lit("Email: "), e))
        both = field(F.concat(F.lit("Phone: "), p, F.lit(", Email: "), e), "found", F.concat(p, F.lit(" | "), e), phone=p, email=e)
        return F.when(p.isNotNull() & e.isNotNull(), both).when(one.isNotNull(), field(one, "low_confidence", one, phone=p, email=e)).otherwise(field())

    return let(F.struct(found.alias("p"), mail.alias("e")), of)


def fssai_license(text: Column) -> Column:
    """X6."""
    anywhere = let(license_number(text), lambda v: F.when(v["valid"], field(v["value"], "found", v["value"])).otherwise(field()))

    def cued(m: Column) -> Column:
        return let(license_number(m["own"]), lambda v: F.when(v["valid"], field(v["value"], "found", m["all"])).when(v["value"] == UNCERTAIN, field(UNCERTAIN, "uncertain", m["all"])))

    return F.coalesce(let(_match(text, LICENSE), lambda m: F.when(m["is"], cued(m))), anywhere)


def country_of_origin(text: Column) -> Column:
    """X7."""
    home = F.when(text.rlike(HOME), field("India", "found", "India stands in the text")).otherwise(field())
    return let(
        _match(text, COUNTRY),
        lambda m: let(squeeze(fix_words(m["own"])), lambda v: F.when(m["is"] & (F.char_length(v) >= 3), field(title(v), "found", m["all"])).otherwise(home)),
    )


EXTRACTORS = dict(zip(FIELDS, (maker, net_quantity, mrp, manufacture_date, customer_care, fssai_license, country_of_origin), strict=True))

#: Fields that are tried again on the text as it was read.
RETRIED = ("mrp", "fssai_license", "net_quantity")


def extract_field(name: str, raw: Column, clean: Column) -> Column:
    """X8 for one field: from the cleaned text, and for three fields from the raw text where that finds nothing."""
    own = EXTRACTORS[name]
    if name not in RETRIED:
        return own(clean)
    again = F.coalesce(raw != clean, F.lit(False)) & (raw != "")

    # One body for both texts; the raw one is read only where it is asked for.
    def step(found: Column, t: Column) -> Column:
        asked = found.isNull() | (again & (found["status"] == "not_found"))
        return F.when(asked, let(own(t), lambda f: F.when(found.isNull() | (f["status"] != "not_found"), f).otherwise(found))).otherwise(found)

    return F.aggregate(F.array(clean, raw), F.lit(None).cast(FIELD), step)


def extract_fields(df, text: str = "text", only: tuple[str, ...] = FIELDS, into: str = "fields"):
    """A struct of the fields, beside the columns of the input; a null text is empty.

    The cleaned text is a projection of its own, so that each extractor reads it instead of computing it.
    """
    texts = df.withColumn("__raw", F.coalesce(F.col(text), F.lit("")))
    texts = texts.withColumn("__clean", built(("clean",), lambda: clean_lines(F.col("__raw"))))
    fields = built(("fields", only), lambda: once(F.struct(*(extract_field(n, F.col("__raw"), F.col("__clean")).alias(n) for n in only))))
    return texts.withColumn(into, fields).drop("__raw", "__clean")
