"""Additives by an inverted index of aliases (JN6, JN7, K5): tokens meet the knowledge base in equi-joins, whatever its size.

The codes and ingredient names of all labels are few next to the labels. So distinct tokens are looked up once, and the
answers are joined back. A token that may contain an alias is looked up by its substrings, a name by its grams.

What labels are made of is larger than the optimizer takes it for, as exploding arrays doesn't count there, so no side of
these joins is left for it to broadcast: they are merged, and only indexes of at most :data:`SMALL` records are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions.profile import CODE, allergens, confidence, ingredients, nutrition, risks
from labelwright.functions.text import built, once, squeeze, strip

#: Letters of the grams by which names of additives are found in names of ingredients: enough to tell most names apart.
GRAM = 12

#: Records of a knowledge base up to which its indexes are broadcast.
SMALL = 4096

FOUND = ("identifier", "common_name", "function", "risk_level", "detected_token", "recognized")


def alias_index(known: DataFrame) -> DataFrame:
    """alias, ordinal: the first additive of each alias; known: ordinal, identifier, aliases, common_name, function, risk_level."""
    return known.select(F.explode("aliases").alias("alias"), "ordinal").groupBy("alias").agg(F.min("ordinal").alias("ordinal"))


def _met(rows: DataFrame, index: DataFrame, on: str, small: bool) -> DataFrame:
    return rows.join(F.broadcast(index) if small else index.hint("merge"), on)


def _spaced(t: Column) -> Column:
    """The token with the blank after its prefix that aliases have."""
    return squeeze(F.replace(F.replace(F.replace(t, F.lit("e-"), F.lit("e")), F.lit("ins-"), F.lit("ins ")), F.lit("ins"), F.lit("ins ")))


def _substrings(t: Column) -> Column:
    n = F.char_length(t)
    cut = lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(t, i, k))
    return F.flatten(F.transform(F.sequence(F.lit(1), n), cut))


def resolve_tokens(tokens: DataFrame, index: DataFrame, strict: bool = False, small: bool = False) -> DataFrame:
    """raw, num, ordinal: each code's additive; tokens: distinct raw, num.

    The first additive by order with the written code as an alias, plain or spaced; a code that begins with "ins" also takes
    one of which it contains an alias, unless strict. Where there is none, the same for the number alone.
    """
    forms = []
    for order, c in enumerate(("raw", "num")):
        t = F.lower(strip(F.col(c)))
        exact = F.array(t, _spaced(t))
        keys = exact if strict else F.when(t.startswith("ins"), F.array_union(exact, _substrings(t))).otherwise(exact)
        forms.append(tokens.select("raw", "num", F.lit(order).alias("order"), F.explode(F.array_distinct(keys)).alias("alias")))
    met = _met(forms[0].unionByName(forms[1]), index, "alias", small)
    return met.groupBy("raw", "num").agg(F.min(F.struct("order", "ordinal")).alias("x")).select("raw", "num", F.col("x.ordinal").alias("ordinal"))


def _grams(c: Column, size: int) -> Column:
    n = F.char_length(c)
    return F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(c, i, size)))).otherwise(F.array().cast("array<string>"))


def resolve_names(names: DataFrame, known: DataFrame, small: bool = False) -> DataFrame:
    """name, ordinal: the additives whose name stands in an ingredient's; names: distinct name.

    An additive is indexed under the rarest of its name's grams (its whole name, if that is shorter). An ingredient's grams
    meet that index, and what they meet is checked.
    """
    own = known.select("ordinal", F.lower("common_name").alias("own")).filter(F.char_length("own") > 0)
    grams = own.withColumn("gram", F.explode(F.when(F.char_length("own") < GRAM, F.array("own")).otherwise(_grams(F.col("own"), GRAM))))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    anchors = grams.join(often.hint("merge"), "gram").groupBy("ordinal", "own").agg(F.min(F.struct("n", "gram")).alias("x")).select("ordinal", "own", F.col("x.gram").alias("gram"))
    lower = names.select("name", F.lower("name").alias("low"))
    # Of the lengths that the index has, GRAM at most.
    lengths = sorted(r[0] for r in own.select(F.least(F.char_length("own"), F.lit(GRAM))).distinct().collect())
    cut = lower.withColumn("gram", F.explode(F.flatten(F.array(*(_grams(F.col("low"), k) for k in lengths or [GRAM])))))
    return _met(cut, anchors, "gram", small).filter(F.contains("low", "own")).select("name", "ordinal").distinct()


def codes(text: Column) -> Column:
    """K5: struct of raw and num of each code in the text, the first of each number, in their order."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(CODE), F.lit(1)), F.lower)
    written = F.transform(F.regexp_extract_all(text, F.lit(CODE), F.lit(0)), lambda c: squeeze(F.replace(F.upper(c), F.lit("-"), F.lit(" "))))
    pairs = F.arrays_zip(written.alias("raw"), numbers.alias("num"))
    return F.transform(F.array_distinct(numbers), lambda n: F.get(F.filter(pairs, lambda p: p["num"] == n), F.lit(0)))


def decode(labels: DataFrame, known: DataFrame, key: str, text: str = "text", strict: bool = False) -> DataFrame:
    """A row per additive of a label: key, part (0 for a code, 1 for a name), at and ordinal, its place among those, then
    :data:`FOUND` and whatever further columns the knowledge base has; ``part, at, ordinal`` is their order.

    Coded additives come in the order of their codes, then those that an ingredient names, in the order of ingredients and
    of the knowledge base. A code that isn't known gives a record of its own at yellow, its further columns null. A named
    additive is left out if its identifier is among the codes. Null texts have none; keys that stand on several rows must
    be told apart before.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = labels.select(key, t.alias("__text"))
    base = base.select(key, once(codes(F.col("__text"))).alias("codes"), once(built(("ingredients",), lambda: once(ingredients(F.col("__text"))))["items"]["name"]).alias("names"))
    # Outer: else the optimizer asks for the arrays' sizes first, and makes them once more for that.
    coded = base.select(key, F.posexplode_outer("codes").alias("at", "c")).filter("c is not null").select(key, "at", "c.raw", "c.num")
    small = known.limit(SMALL + 1).count() <= SMALL
    answers = resolve_tokens(coded.select("raw", "num").distinct(), alias_index(known), strict, small)
    more = [c for c in known.columns if c not in ("ordinal", "aliases", *FOUND)]
    record = known.select("ordinal", *FOUND[:4], *more)
    answers = answers.join(record.hint("merge"), "ordinal").drop("ordinal")
    first = coded.join(answers.hint("merge"), ["raw", "num"], "left").select(
        key, F.lit(0).alias("part"), "at", F.lit(0).alias("ordinal"), F.coalesce("identifier", "raw").alias("identifier"),
        F.coalesce("common_name", F.concat(F.lit("Additive "), "raw")).alias("common_name"), F.coalesce("function", F.lit("Not indexed")).alias("function"),
        F.coalesce("risk_level", F.lit("yellow")).alias("risk_level"), F.col("raw").alias("detected_token"), F.col("identifier").isNotNull().alias("recognized"), *more,
    )
    said = F.transform("codes", lambda c: F.concat(F.lit("INS "), c["num"]))
    items = base.select(key, said.alias("said"), F.posexplode_outer("names").alias("at", "name")).filter("name is not null")
    met = resolve_names(items.select("name").distinct(), known, small).join(record.hint("merge"), "ordinal")
    named = items.join(met.hint("merge"), "name").filter(~F.array_contains("said", F.col("identifier")))
    named = named.groupBy(key, "ordinal").agg(F.min(F.struct("at", "name", *FOUND[:4], *more)).alias("x"))
    named = named.select(key, F.lit(1).alias("part"), "x.at", "ordinal", *(F.col(f"x.{c}").alias(c) for c in FOUND[:4]), F.col("x.name").alias("detected_token"), F.lit(True).alias("recognized"), *(F.col(f"x.{c}").alias(c) for c in more))
    return first.unionByName(named)


def listed(decoded: DataFrame, key: str) -> DataFrame:
    """key, additives: a label's additives in their order, as an array; labels without any have no row."""
    rows = F.array_sort(F.collect_list(F.struct("part", "at", "ordinal", F.struct(*FOUND).alias("a"))))
    return decoded.groupBy(key).agg(F.transform(rows, lambda x: x["a"]).alias("additives"))


def profiles(labels: DataFrame, known: DataFrame, key: str, text: str = "text", strict: bool = False) -> DataFrame:
    """K7: key, ingredients, additives, allergens, nutrition, risks and evidence_confidence of each label.

    As :func:`labelwright.functions.profile.profile`, with the knowledge base as a table of any size; its cost is a shuffle
    of the additives found by key.
    """
    t, items = F.col("__text"), F.col("ingredients.items")
    held = labels.select(key, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    out = held.withColumn("ingredients", built(("ingredients",), lambda: once(ingredients(t))))
    out = out.withColumn("allergens", built(("allergens", strict), lambda: once(allergens(t, items, strict)))).withColumn("nutrition", built(("nutrition",), lambda: nutrition(t))).drop("__text")
    found = listed(decode(labels, known, key, text, strict), key)
    out = out.join(found.hint("merge"), key, "left")
    none = F.array().cast(found.schema["additives"].dataType)
    out = out.withColumn("additives", F.coalesce("additives", none)).withColumn("risks", risks(F.col("additives")))
    return out.withColumn("evidence_confidence", confidence(F.col("ingredients.found"), F.size("additives"), F.size("allergens")))
