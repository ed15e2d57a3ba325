"""Consensus over several readings of one label (M8, JN11, A7, A8, O4, U3, U4): ordered folds inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions.text import field_score, fix_words, let, similarity, split_lines, strip


def _norm(c: Column) -> Column:
    return F.lower(strip(c))


def pass_score(p: Column) -> Column:
    """What a reading is worth; p: struct of text, confidence, blocks (text, confidence, source_pass)."""
    text = F.coalesce(p["text"], F.lit(""))
    length = F.char_length(strip(text))
    sure = F.transform(F.filter(p["blocks"], lambda b: b["confidence"] >= 0.35), lambda b: b["confidence"])
    mean = F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda a, x: a + x) / F.size(sure)).otherwise(p["confidence"])
    clean = F.char_length(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}\s]", ""))
    name = F.coalesce(F.get(p["blocks"], F.lit(0))["source_pass"], F.lit(""))
    natural = F.when(F.contains(name, F.lit("natural")) | F.contains(name, F.lit("whole")), 20.0).otherwise(0.0)
    return F.when(length == 0, 0.0).otherwise(let(field_score(text), lambda d: d * 60.0 + mean * 40.0 + F.when(d > 0.05, 35.0).otherwise(0.0) + natural + clean / F.greatest(F.lit(1), length) * 15.0))


def ranked(passes: Column) -> Column:
    """Readings from the best to the worst; of equals the earlier first."""
    scored = F.transform(passes, lambda p, i: F.struct((-pass_score(p)).alias("s"), i.alias("i"), p.alias("p")))
    # The order needs the first two alone; readings may hold what can't be ordered.
    keys = F.array_sort(F.transform(scored, lambda x: F.struct(x["s"].alias("s"), x["i"].alias("i"))))
    return let(scored, lambda sc: F.transform(keys, lambda k: F.get(sc, k["i"])["p"]))


def merged_text(sorted_passes: Column) -> Column:
    """JN11: the best reading's text, and lines of the others that resemble none so far, if they show a label field or
    there are fewer than four lines."""
    base = F.coalesce(F.get(sorted_passes, F.lit(0))["text"], F.lit(""))
    known = F.array_distinct(F.filter(F.transform(split_lines(base), _norm), lambda x: x != ""))
    others = F.flatten(F.transform(F.slice(sorted_passes, 2, 1 << 30), lambda p: split_lines(F.coalesce(p["text"], F.lit("")))))
    lines = F.filter(F.transform(others, lambda x: F.struct(strip(x).alias("t"), _norm(x).alias("n"), field_score(strip(x)).alias("s"))), lambda x: x["t"] != "")

    def step(a: Column, x: Column) -> Column:
        like = F.exists(a["known"], lambda k: similarity(x["n"], k) > 0.55)
        adds = ~like & ((x["s"] > 0.05) | (F.size(a["known"]) < 4))
        return F.struct(F.when(adds, F.array_append(a["known"], x["n"])).otherwise(a["known"]).alias("known"), F.when(adds, F.concat(a["text"], F.lit("\n"), x["t"])).otherwise(a["text"]).alias("text"))

    return F.aggregate(lines, F.struct(known.alias("known"), base.alias("text")), step, lambda a: a["text"])


def merged_blocks(sorted_passes: Column) -> Column:
    """Blocks with distinct texts, first one wins, 0.05 more confidence for each repeat, 1 at most."""
    blocks = F.flatten(F.transform(sorted_passes, lambda p: p["blocks"]))

    def of(b: Column) -> Column:
        names = F.transform(b, lambda x: _norm(x["text"]))

        def dedup(n: Column) -> Column:
            first = F.filter(F.transform(b, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: (F.get(n, y["i"]) != "") & (F.array_position(n, F.get(n, y["i"])) == y["i"] + 1))

            def boosted(y: Column) -> Column:
                times = F.size(F.filter(n, lambda m: m == F.get(n, y["i"])))
                raised = F.when(times > 1, F.least(F.lit(1.0), y["x"]["confidence"] + 0.05 * (times - 1))).otherwise(y["x"]["confidence"])
                return F.struct(y["x"]["text"].alias("text"), raised.alias("confidence"), y["x"]["source_pass"].alias("source_pass"), (times > 1).alias("cross_validated"))

            return F.transform(first, boosted)

        return let(names, dedup)

    return let(blocks, of)


def block_confidence(blocks: Column, otherwise: Column) -> Column:
    """The mean confidence of blocks of at least 0.35, else of all, else what is given; to three decimals."""
    mean = lambda b: F.aggregate(b, F.lit(0.0), lambda a, x: a + x["confidence"]) / F.size(b)
    sure = F.filter(blocks, lambda x: x["confidence"] >= 0.35)
    return F.round(let(sure, lambda s: F.when(F.size(s) > 0, mean(s)).when(F.size(blocks) > 0, mean(blocks)).otherwise(otherwise)), 3)


def consensus(df: DataFrame, passes: str = "passes") -> DataFrame:
    """M8: adds raw_text, validated_text, blocks and confidence; no passes give empty texts and confidence 0."""
    out = df.withColumn("__sorted", ranked(F.col(passes)))
    s = F.col("__sorted")
    out = out.withColumn("raw_text", F.coalesce(merged_text(s), F.lit(""))).withColumn("blocks", merged_blocks(s))
    out = out.withColumn("confidence", F.coalesce(block_confidence(F.col("blocks"), F.get(s, F.lit(0))["confidence"]), F.lit(0.0)))
    return out.withColumn("validated_text", fix_words(F.col("raw_text"))).drop("__sorted")


def collect_passes(rows: DataFrame, product: str = "product_id") -> DataFrame:
    """A row per product with its passes in order; rows: product, pass_ord, text, confidence, blocks."""
    return rows.groupBy(product).agg(F.array_sort(F.collect_list(F.struct("pass_ord", "text", "confidence", "blocks"))).alias("passes"))


def unique_lines(c: Column, least: int = 3) -> Column:
    """U4: trimmed lines with distinct lower-case forms of at least three characters, the first of each."""
    lines = F.filter(F.transform(split_lines(c), strip), lambda x: F.char_length(x) >= least)
    return let(lines, lambda x: let(F.transform(x, F.lower), lambda n: F.filter(x, lambda _, i: F.array_position(n, F.get(n, i)) == i + 1)))


def duplicate_counts(blocks: DataFrame, key: str, text: str) -> DataFrame:
    """A8 over rows: each block with how often its text occurs for the key, and the boosted confidence."""
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy(key, _norm(F.col(text))))
    return blocks.withColumn("times", n).withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + 0.05 * (F.col("times") - 1)))


def first_of_each(blocks: DataFrame, key: str, text: str, *order: str) -> DataFrame:
    """U3 over rows: the first block of each text, by the given order."""
    from pyspark.sql import Window

    w = Window.partitionBy(key, _norm(F.col(text))).orderBy(*order)
    return blocks.filter(_norm(F.col(text)) != "").withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
