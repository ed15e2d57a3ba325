"""Quotation linking: nested quote levels, hashed passages joined to the messages they came from, reply order, quotes out.

Only DataFrame functions. Quote levels and passages are taken inside the row; only messages with quotes make rows of
their own. The original of a passage is the first message of the conversation that says it, found by a partial
minimum per (conversation, digest), so a line said by a third of all messages costs one row per task and each quoted
unit meets one original at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, let, materialize, settle, written

#: A quoted line's marks, and a line that announces a quotation.
MARKS = r"^[ \t]*((?:>[ \t]?)+)"
ANNOUNCE = r"(?i)(wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t\r]*$"

PREFIX = "__quote_"
NEW = ("quote_levels", "n_passages", "n_linked", "parent_turn", "thread_turn", "reply_level")


def normalised(text: Column) -> Column:
    """Lower case, everything but letters and digits to single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    """Structs of depth and body of each line."""

    def one(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 1)
        return F.struct(F.char_length(F.regexp_replace(marks, "[^>]", "")).alias("depth"), F.regexp_replace(line, MARKS, "").alias("body"))

    return F.transform(F.split(text, "\n"), one)


def _own_text(text: Column) -> Column:
    """The text without quoted lines and without a line that announces the quotation right below it."""

    def of(lines: Column) -> Column:
        below = lambda i: F.coalesce(F.get(lines, i + 1)["depth"] > 0, F.lit(False))
        own = F.filter(lines, lambda x, i: (x["depth"] == 0) & ~(x["body"].rlike(ANNOUNCE) & below(i)))
        return F.regexp_replace(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), r"^\n+|\n+$", "")

    return let(_lines(text), of)


def _passages(text: Column) -> Column:
    """Runs of lines of one depth of at least 1: structs of depth and the lines' bodies."""

    def of(lines: Column) -> Column:
        depth = lambda i: F.get(lines, i)["depth"]
        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.when(i == 0, True).otherwise(depth(i) != depth(i - 1)))
        runs = let(
            starts,
            lambda s: F.transform(
                s, lambda a, k: F.struct(depth(a).alias("depth"), F.transform(F.slice(lines, a + 1, F.coalesce(F.get(s, k + 1), F.size(lines)) - a), lambda x: x["body"]).alias("bodies"))
            ),
        )
        return F.filter(runs, lambda r: r["depth"] > 0)

    return let(_lines(text), of)


def _units(bodies: Column) -> Column:
    """What is matched: the whole, if it has more than one line with a word, and each line; normalised, without empty ones."""
    lines = F.filter(F.transform(bodies, normalised), lambda x: x != "")
    return F.array_distinct(let(lines, lambda x: F.when(F.size(x) > 1, F.concat(F.array(F.array_join(x, " ")), x)).otherwise(x)))


def quote_links(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """c, t, d, passage, depth, original, w: which earlier turn of the conversation each passage comes from; d is the
    digest of its message's text, w the matched words.

    Units match by digest; the original with most matched words wins, of equals the latest.
    """
    held = messages.select(messages[conv].alias("c"), messages[turn].alias("t"), messages[text].alias("x")).filter(F.col("c").isNotNull() & F.col("t").isNotNull() & F.col("x").isNotNull())
    quoting = materialize(held.filter(F.col("x").rlike(r"(^|\n)[ \t]*>")), "quoting")
    digest = lambda u: F.unhex(F.md5(u.cast("binary")))
    passages = quoting.select("c", "t", F.md5(F.col("x").cast("binary")).alias("d"), F.posexplode(_passages(F.col("x"))).alias("passage", "p"))
    place = ("c", "t", "d", "passage", "depth")
    units = passages.select("c", "t", "d", "passage", F.col("p.depth").alias("depth"), F.explode(_units(F.col("p.bodies"))).alias("u")).select(*place, digest(F.col("u")).alias("h"), F.size(F.split("u", " ")).alias("w"))
    said = held.join(quoting.select("c").distinct(), "c", "left_semi").select("c", "t", F.explode(_units(F.split(_own_text(F.col("x")), "\n"))).alias("u"))
    first = said.groupBy("c", digest(F.col("u")).alias("h")).agg(F.min("t").alias("original"))
    found = units.join(first, ["c", "h"]).filter(F.col("original") < F.col("t"))
    votes = found.groupBy(*place, "original").agg(F.sum("w").alias("w"))
    return votes.groupBy(*place).agg(F.max(F.struct("w", "original")).alias("b")).select(*place, F.col("b.original").alias("original"), F.col("b.w").alias("w"))


def threads(links: DataFrame) -> DataFrame:
    """c, t, parent, thread, level: the turn replied to, the turn that the chain of replies began with, the steps to it.

    The parent is the original of the least deep linked level, there the one with most words over its passages, of equals
    the latest. Pointers double each round.
    """
    level = links.groupBy("c", "t", "depth", "original").agg(F.sum("w").alias("w"))
    up = materialize(level.groupBy("c", "t").agg(F.max(F.struct((-F.col("depth")).alias("depth"), "w", "original")).alias("b")).select("c", "t", F.col("b.original").alias("parent"), F.col("b.original").alias("up"), F.lit(1).cast("long").alias("level")), "threads")
    while True:
        above = up.select("c", F.col("t").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        if up.join(above, ["c", "up"], "left_semi").isEmpty():
            return up.withColumnRenamed("up", "thread")
        joined = up.join(above, ["c", "up"], "left")
        before, up = up, materialize(joined.select("c", "t", "parent", F.coalesce("next", "up").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "threads")
        discard(before)


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Every message with its text without quotes, quote_levels, n_passages, n_linked (passages whose original is known),
    parent_turn, thread_turn and reply_level, in reply order: by conversation, thread, level, turn.

    A message that quotes nothing known begins a thread of its own: no parent, its own turn, level 0. Null texts stay
    null and empty ones empty; messages with a null conversation or turn are not linked; rows that repeat a turn share
    its links. Of originals that match equally well the latest wins. Very long texts are parsed whole, inside the row.
    Other columns pass through, but for those that have the names of the results; an empty table gives no rows.
    """
    since = written()
    links = settle(quote_links(messages, conv, turn, text), "quote-links", since)
    counts = links.groupBy("c", "t", "d").count().groupBy("c", "t").agg(F.map_from_entries(F.collect_list(F.struct("d", "count"))).alias("n"))
    per = threads(links).join(counts, ["c", "t"])
    per = per.select(*(F.col(k).alias(PREFIX + k) for k in ("c", "t", "parent", "thread", "level", "n")))
    out = messages.join(per, (messages[conv] == F.col(PREFIX + "c")) & (messages[turn] == F.col(PREFIX + "t")), "left")
    quoted = F.coalesce(messages[text].rlike(r"(^|\n)[ \t]*>"), F.lit(False))
    depths = F.transform(_passages(messages[text]), lambda p: p["depth"])
    out = out.select(
        *((F.when(quoted, _own_text(messages[text])).otherwise(messages[text]).alias(c) if c == text else messages[c]) for c in messages.columns if c not in NEW),
        F.when(quoted, F.array_max(depths)).otherwise(0).cast("long").alias("quote_levels"),
        F.when(quoted, F.size(depths)).otherwise(0).cast("long").alias("n_passages"),
        F.coalesce(F.try_element_at(F.col(PREFIX + "n"), F.md5(messages[text].cast("binary"))), F.lit(0)).cast("long").alias("n_linked"),
        F.col(PREFIX + "parent").alias("parent_turn"),
        F.coalesce(F.col(PREFIX + "thread"), messages[turn]).alias("thread_turn"),
        F.coalesce(PREFIX + "level", F.lit(0)).cast("long").alias("reply_level"),
    )
    return out.orderBy(conv, "thread_turn", "reply_level", turn)
