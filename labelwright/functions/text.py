"""Text operators as Columns. Patterns carry (?U), so word, digit and space classes are Unicode, and (?d), so only LF ends a line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what stands for a value that can't be read.
UNCERTAIN = "[uncertain — please upload a clearer image]"

#: Confusable characters in numbers, pairwise.
CONFUSED, MEANT = "OoDIl|!SsBZzG", "0001111558226"

#: Misread words and what they are replaced by, in order.
WORD_FIXES = [
    (r"\b1NDIA\b", "INDIA"),
    (r"\bBHAR4T\b", "BHARAT"),
    (r"\bC0RPORATION\b", "CORPORATION"),
    (r"\bL1MITED\b", "LIMITED"),
    (r"\bPVT\.?\s*1TD\.?\b", "PVT. LTD."),
    (r"\b1NDUSTRIES\b", "INDUSTRIES"),
    (r"\bF00DS\b", "FOODS"),
    (r"\bM4RKETED\b", "MARKETED"),
    (r"\bMFR\.?\b", "MFG."),
    (r"\bPACKED\s+8Y\b", "PACKED BY"),
    (r"\bMFG\s+8Y\b", "MFG BY"),
    (r"\bENTERPR1SES\b", "ENTERPRISES"),
    (r"\bPR0DUCTS\b", "PRODUCTS"),
    (r"\bQUAL1TY\b", "QUALITY"),
    (r"\bNUTR1TION\b", "NUTRITION"),
    (r"\bINGREDI[E3]NTS\b", "INGREDIENTS"),
    (r"\bN[E3]T\s*(?:W[E3]IGHT|QTY|QUANTITY)\b", "NET QUANTITY"),
    (r"\bM[A4]NUFACTURED\b", "MANUFACTURED"),
    (r"\bCONSUM[E3]R\b", "CONSUMER"),
    (r"\bCUST[O0]MER\b", "CUSTOMER"),
    (r"\bC[O0]UNTRY\b", "COUNTRY"),
    (r"\b[O0]RIGIN\b", "ORIGIN"),
    (r"\bIMP[O0]RTED\b", "IMPORTED"),
    (r"\bD[E3]CLARATION\b", "DECLARATION"),
    (r"\bgrarnrns?\b", "grams"),
    (r"\bgrarnrne?\b", "grams"),
    (r"\bnarne\b", "name"),
    (r"\bcomrnon\b", "common"),
]

#: Misread units.
UNIT_FIXES = {"q": "g", "rnl": "ml", "rnL": "mL", "kq": "kg", "Kg": "kg", "KG": "kg", "GM": "gm", "Gm": "gm", "ML": "ml", "Lt": "l", "LT": "l", "Ltr": "ltr", "LTR": "ltr"}

#: Accepted units and their canonical forms.
UNITS = {
    "g": "g", "gm": "g", "gms": "g", "gram": "g", "grams": "g",
    "kg": "kg", "kgs": "kg", "kilogram": "kg", "kilograms": "kg",
    "ml": "ml", "milli-litre": "ml", "millilitre": "ml", "millilitres": "ml", "milliliters": "ml",
    "l": "l", "ltr": "l", "litre": "l", "litres": "l", "liter": "l", "liters": "l",
    "pieces": "pcs", "pcs": "pcs", "units": "units", "u": "units", "n": "N", "count": "count",
}

#: Name, weight and pattern of each label field that raises a block's score, in order.
FIELD_PATTERNS = [
    ("fssai", 0.25, r"(?U)\b\d{14}\b"),
    ("fssai_tag", 0.20, r"(?iU)fssai|lic\s*no"),
    ("date", 0.20, r"(?iU)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[\s/\-\.]\d{2,4}\b|\b\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}\b"),
    ("mfg_date", 0.20, r"(?iU)\b(?:mfg|mfd|manufactured|packed|pkd)[\s\.\:]*(?:date|dt)?[\s\.\:]*\d"),
    ("expiry", 0.20, r"(?iU)\b(?:exp|expiry|best\s*before|use\s*by|bb)[\s\.\:]+"),
    ("mrp", 0.20, r"(?iU)\b(?:mrp|m\.r\.p\.?|max\s*retail\s*price)[\s\.\:₹Rs]*\d"),
    ("price", 0.15, r"(?U)[₹Rs]\s*\d+(?:\.\d{2})?|\bRs\.?\s*\d+"),
    ("net_qty", 0.15, r"(?iU)\b\d+\s*(?:g|gm|gms|kg|ml|l|ltr|pieces|pcs)\b"),
    ("mfr_by", 0.15, r"(?iU)\b(?:manufactured|marketed|packed|imported)\s+by\b"),
    ("incl_tax", 0.10, r"(?iU)incl(?:usive)?\s*(?:of\s*)?all\s*taxes"),
    ("country", 0.10, r"(?iU)(?:country\s*of\s*origin|made\s*in)\s*:?\s*\w+"),
    ("advisory", 0.20, r"(?iU)\b(?:contains\s*(?:steviol|non-caloric|sweetener|aspartame|sucralose|caffeine)|nutritional\s*info|ingredients?)\b"),
    ("brand_product", 0.15, r"(?iU)\b(?:sprite|coca[\s\-]*cola|thums\s*up|fanta|pepsi|limca|maaza|frooti|bisleri)\b"),
    ("india", 0.05, r"(?iU)\bIndia\b|\bBharat\b"),
]

LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"


_columns: dict = {}


def built(key: tuple, make: Callable[[], Column]) -> Column:
    """The Column of that key, made once for each Spark context: a large expression takes seconds to put together from Python.

    It has to read its inputs by fixed names.
    """
    context = SparkContext._active_spark_context
    if _columns.get("context") is not context:
        _columns.clear()
        _columns["context"] = context
    if key not in _columns:
        _columns[key] = make()
    return _columns[key]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """The value, but opaque to the optimizer, which else repeats an expression for each field that is read from it."""
    return let(value, lambda x: x)


def literal_map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


#: Fixed value: white space, as (?U)\\s has it, and the four separators.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Runs of white space to a space, ends trimmed."""
    return strip(F.regexp_replace(c, r"(?U)[\s\x1C-\x1F]+", " "))


def fix_digits(c: Column) -> Column:
    """A number's confusable characters; a comma between digits is a decimal point."""
    return F.translate(F.regexp_replace(strip(c), r"(?U)(\d),(\d)", "$1.$2"), CONFUSED, MEANT)


def fix_words(c: Column) -> Column:
    """Misread words, without regard to case; the replacements keep their own.

    A single search tells most lines that need none; a fix makes no place for an earlier one, so the chain is rarely run.
    It runs in groups, each behind a search of its own, as few of them have a word.
    """

    def shown(c: Column, fixes: list) -> Column:
        return c.rlike(r"(?iU)\b(?:" + "|".join(p.removeprefix(r"\b") for p, _ in fixes) + ")")

    def group(at: int) -> Callable[[Column], Column]:
        fixes = WORD_FIXES[at : at + 5]

        def of(c: Column) -> Column:
            fixed = c
            for pattern, word in fixes:
                fixed = F.regexp_replace(fixed, f"(?iU){pattern}", word)
            return F.when(shown(c, fixes), fixed).otherwise(c)

        return of

    fixed = c
    for at in range(0, len(WORD_FIXES), 5):
        fixed = let(fixed, group(at))
    return F.when(shown(c, WORD_FIXES), fixed).otherwise(c)


def split_lines(c: Column) -> Column:
    """Lines as Python's splitlines has them: many line ends, none after the last."""
    return F.split(F.regexp_replace(c, rf"(?:{LINE_ENDS})\z", ""), LINE_ENDS)


def clean_lines(c: Column) -> Column:
    """T4: T3 line by line, rejoined with LF; null and empty give an empty text."""
    c = F.coalesce(c, F.lit(""))
    return F.when(c == "", F.lit("")).otherwise(F.array_join(F.transform(split_lines(c), fix_words), "\n"))


def fix_unit(c: Column) -> Column:
    """T5: misread units, exact."""
    return let(strip(c), lambda u: F.coalesce(F.try_element_at(literal_map(UNIT_FIXES), u), u))


def canonical_unit(c: Column) -> Column:
    """The canonical unit; an unknown one in lower case."""
    return let(F.lower(strip(c)), lambda u: F.coalesce(F.try_element_at(literal_map(UNITS), u), u))


def is_unit(c: Column) -> Column:
    """Whether the unit is accepted."""
    return F.lower(c).isin(*UNITS)


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; over 500 characters the Jaccard similarity of the words."""
    words = lambda c: F.array_distinct(F.array_remove(F.split(F.lower(c), r"(?U)[\s\x1C-\x1F]+"), ""))
    longer = F.greatest(F.char_length(a), F.char_length(b))
    jaccard = F.size(F.array_intersect(words(a), words(b))) / F.greatest(F.lit(1), F.size(F.array_union(words(a), words(b))))
    return (
        F.when((a == "") & (b == ""), 1.0)
        .when((a == "") | (b == ""), 0.0)
        .when(longer > 500, jaccard)
        .otherwise(1.0 - F.levenshtein(a, b) / longer)
    )


def field_score(c: Column) -> Column:
    """The summed weights of the label fields that a text shows, 1 at most, 0 below three characters."""
    c = F.coalesce(c, F.lit(""))
    total = F.lit(0.0)
    for _, weight, pattern in FIELD_PATTERNS:
        total = total + F.when(c.rlike(pattern), weight).otherwise(0.0)
    return F.when(F.char_length(strip(c)) < 3, 0.0).otherwise(F.least(total, F.lit(1.0)))


def field_tags(c: Column) -> Column:
    """Names of the label fields that a text shows."""
    return F.array_compact(F.array(*(F.when(c.rlike(p), F.lit(name)) for name, _, p in FIELD_PATTERNS)))


def boosted(confidence: Column, bonus: Column) -> Column:
    """The confidence with the field score's share."""
    return F.least(F.lit(1.0), confidence + bonus * 0.3)


def is_token(text: Column, confidence: Column) -> Column:
    """Whether a token is more than noise."""

    def of(t: Column) -> Column:
        single = (F.char_length(t) == 1) & ~t.rlike(r"(?U)^[\dglLmM₹]$") & (confidence < 0.45)
        return (t != "") & ~single & t.rlike("[A-Za-z0-9₹]")

    return let(strip(text), of)


def rating(confidence: Column) -> Column:
    """High, Medium or Low."""
    return F.when(confidence >= 0.70, "High").when(confidence >= 0.40, "Medium").otherwise("Low")


def advice(confidence: Column) -> Column:
    """What the rating asks for."""
    return F.when(confidence >= 0.70, "Text is clear.").when(confidence >= 0.40, "Text should be verified.").otherwise("Text is unclear; take a closer, well-lit picture.")


def passes_gate(confidence: Column) -> Column:
    """The text gate."""
    return confidence >= 0.35


def compared(c: Column) -> Column:
    """Word characters in lower case, for discrepancies between views."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[^\w\d]", ""))


def agreed(c: Column) -> Column:
    """Lower-case ASCII letters and digits, for agreement between engines."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def title(c: Column) -> Column:
    """A capital at the start of each run of letters, the rest in lower case; ASCII that has this form is left as it is."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    other = c.rlike(r"[^\x00-\x7F]|(?<![A-Za-z])[a-z]|(?<=[A-Za-z])[A-Z]")
    return F.when(~other, c).otherwise(F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), ""))


def split_items(c: Column) -> Column:
    """Items between , ; bullet and LF outside brackets.

    Items of one character and those that begin with "and " go, but for the last, of which trailing dots and stars go.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("own"), F.array().cast("array<string>").alias("items"))

    # Separators and brackets one by one, what stands between them in one piece.
    def step(a: Column, ch: Column) -> Column:
        opens, closes = ch.isin("(", "[", "{"), ch.isin(")", "]", "}")
        cut = ch.isin(",", ";", "•", "\n") & (a["depth"] == 0)
        depth = F.when(opens, a["depth"] + 1).when(closes, F.greatest(F.lit(0), a["depth"] - 1)).otherwise(a["depth"])
        own = strip(a["own"])
        kept = (F.char_length(own) > 1) & ~F.lower(own).startswith("and ")
        return F.struct(
            depth.alias("depth"),
            F.when(cut, "").otherwise(F.concat(a["own"], ch)).alias("own"),
            F.when(cut & kept, F.array_append(a["items"], own)).otherwise(a["items"]).alias("items"),
        )

    def finish(a: Column) -> Column:
        last = strip(a["own"])
        trimmed = strip(F.regexp_replace(last, r"[\.\*]+$", ""))
        return F.when((F.char_length(last) > 1) & (trimmed != ""), F.array_append(a["items"], trimmed)).otherwise(a["items"])

    return F.aggregate(F.regexp_extract_all(c, F.lit(r"[,;•\n(\[{)\]}]|[^,;•\n(\[{)\]}]+"), F.lit(0)), start, step, finish)
