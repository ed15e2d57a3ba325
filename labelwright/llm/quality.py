"""Host-level quality rules: documents fail rules, hosts collect failures, shrunken host rates come back to documents.

Only DataFrame functions. The per-text counts are one projection over the scan (no explode, no shuffle); hosts are one
partial aggregation, whose single-row prior (an empirical beta fitted by moments over the hosts' rates) is all that
reaches the driver. A host with a third of all rows costs no more than its narrow counts: partial sums go into the
shuffle, and the join back is a plain equi-join that Spark may broadcast by measured size or split by skew.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, settle, sized, written

#: What separates words, what counts as a symbol.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

#: The rules by name; the first two are the base rules.
RULES = ("short", "repeats", "symbols", "dup_lines")

PREFIX = "__quality_"


def _repeated(words: Column) -> Column:
    """Words inside 5-word windows that occur at least twice in the text.

    Windows are 64-bit hashes. Only texts with an equal pair sort (hash, position) pairs; neighbours of equal hashes
    whose words are equal too give the starts, and each start covers five words less what the next start covers too.
    """

    def of_windows(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            at = lambda i: F.slice(words, i + 1, 5)
            same = lambda e, k: F.coalesce(F.when(F.get(s, k)["h"] == e["h"], at(F.get(s, k)["i"]) == at(e["i"])), F.lit(False))
            hit = F.filter(s, lambda e, k: F.when(k > 0, same(e, k - 1)).otherwise(False) | same(e, k + 1))
            starts = F.sort_array(F.transform(hit, lambda e: e["i"]))
            return let(
                starts,
                lambda q: F.lit(5) + F.aggregate(F.sequence(F.lit(1), F.size(q) - 1), F.lit(0), lambda a, k: a + F.least(F.lit(5), F.get(q, k) - F.get(q, k - 1))),
            )

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, of_sorted))

    def of_hashes(w: Column) -> Column:
        window = lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(5)))
        return let(F.transform(F.sequence(F.lit(0), F.size(w) - 5), window), of_windows)

    return F.when(F.size(words) < 6, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def text_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of a text; a null text has none of any."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    of_words = let(
        words,
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w).cast("long").alias("n_repeat_words")),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")
    return F.struct(of_words.alias("w"), of_lines.alias("l"), symbols.alias("s"))


def with_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The named columns and the counts of each row."""
    c = PREFIX + "c"
    return docs.select(*(docs[k] for k in keep), text_counts(docs[text]).alias(c)).select(
        *keep, f"{c}.w.n_words", f"{c}.w.word_chars", F.col(f"{c}.s").alias("n_symbols"), f"{c}.l.n_lines", f"{c}.l.n_dup_lines", f"{c}.w.n_repeat_words"
    )


def rule_flags(max_symbol_ratio: float = 0.5, max_dup_lines: float = 0.3) -> dict[str, Column]:
    """The rules, by name; the first two are the base rules."""
    c = F.col
    return {
        "short": c("n_words") < 10,
        "repeats": 100 * c("n_repeat_words") > 20 * c("n_words"),
        "symbols": c("n_symbols") > F.lit(max_symbol_ratio) * c("n_words"),
        "dup_lines": c("n_dup_lines") > F.lit(max_dup_lines) * c("n_lines"),
    }


def host_rates(scored: DataFrame, host: str = "host", failed: str = "base_failed") -> DataFrame:
    """host, n, failed, rate: each host's share of failures, shrunk to the hosts' own prior.

    Prior: beta(mean * strength, (1 - mean) * strength), strength = mean (1 - mean) / variance of the rates over hosts
    - 1, held between 1 and 10,000. A host with few rows so keeps near the mean, and one bad page condemns no host.
    """
    hosts = scored.groupBy(host).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("long")).alias("failed"))
    p = hosts.agg(F.sum("failed").alias("f"), F.sum("n").alias("n"), F.var_pop(F.col("failed") / F.col("n")).alias("v")).first()
    mean = (p["f"] or 0) / p["n"] if p["n"] else 0.0
    strength = min(10_000.0, max(1.0, mean * (1 - mean) / p["v"] - 1)) if p["v"] else 10_000.0
    return hosts.withColumn("rate", (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength)))


def judge(docs: DataFrame, keep: list[str], host: str = "source", text: str = "text", max_host_rate: float = 0.5, host_rules: tuple[str, ...] = RULES) -> DataFrame:
    """Every row's kept columns, counts, rule flags, base_failed, host_rate, host_rejected and kept.

    A document goes if it fails a base rule, or if its host's shrunken failure rate is over ``max_host_rate``; a
    document counts as its host's failure if it fails any of ``host_rules``, by default all rules. Null hosts are one
    host, and hosts with the same rate have the same verdict. A null or empty text has no words and fails as short. Very
    long texts count whole. Repeated rows are judged each. Extra columns are left alone, whatever their names. An empty
    table gives no rows.
    """
    names = {k: f"{PREFIX}k{i}" for i, k in enumerate(keep)}
    held = docs.select(*(docs[k].alias(v) for k, v in names.items()), docs[host].alias(PREFIX + "host"), docs[text].alias(PREFIX + "text"))
    counted = with_counts(held, [*names.values(), PREFIX + "host"], PREFIX + "text").withColumnRenamed(PREFIX + "host", "host")
    flags = rule_flags()
    scored = counted.select("*", *(v.alias(f"fails_{k}") for k, v in flags.items()), (flags["short"] | flags["repeats"]).alias("base_failed"), functools.reduce(operator.or_, (flags[k] for k in host_rules)).alias(PREFIX + "host_failed"))
    scored = materialize(scored, "quality")
    # Written, so that its size is known: Spark broadcasts it only below its own threshold.
    rates = materialize(host_rates(scored, failed=PREFIX + "host_failed").select(F.col("host").alias(PREFIX + "h"), F.col("rate").alias("host_rate")), "host-rates")
    out = scored.join(rates, F.col("host").eqNullSafe(F.col(PREFIX + "h")), "left").drop(PREFIX + "h")
    out = out.withColumn("host_rejected", F.coalesce(F.col("host_rate") > max_host_rate, F.lit(False)))
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    own = {*names.values(), PREFIX + "host_failed"}
    taken = [c for c in out.columns if c not in own]
    return out.select(*(F.col(v).alias(k if k not in taken else f"doc_{k}") for k, v in names.items()), *taken)


def kept_documents(docs: DataFrame, host: str = "source", text: str = "text", max_host_rate: float = 0.5) -> DataFrame:
    """The rows that :func:`judge` keeps, with the columns of the input.

    What is judged and written is a digest and counts per row; texts that go are few, and are taken out by an anti join
    on text digest and host, which is broadcast only while it is small.
    """
    since = written()
    digest = F.unhex(F.md5(F.coalesce(docs[text], F.lit("")).cast("binary")))
    held = docs.select(docs[host].alias("source"), docs[text].alias("text"), digest.alias("digest"))
    judged = judge(held, ["digest"], max_host_rate=max_host_rate).filter(~F.col("kept"))
    gone = settle(judged.select(F.col("digest").alias(PREFIX + "d"), F.col("host").alias(PREFIX + "h")).distinct(), "rejected", since)
    return docs.join(sized(gone), (digest == F.col(PREFIX + "d")) & docs[host].eqNullSafe(F.col(PREFIX + "h")), "left_anti")
