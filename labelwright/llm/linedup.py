"""Line dedup by distinct-site spread: HyperLogLog sketches per line, exact counts near the threshold, boilerplate out.

Only DataFrame functions. Lines travel as 16-byte digests. Sketches merge by aggregation, so a line that stands in a
third of all documents costs one sketch per task; only lines whose estimate lies near the threshold are counted
exactly, over (line, site) pairs that are made distinct before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, let, materialize, sized
from .quality import NOT_SPACE

PREFIX = "__line_"
LINE, SITE, TEXT, POS, KEY, ROWS = (PREFIX + x for x in ("digest", "site", "text", "pos", "key", "rows"))


def _digest(c: Column) -> Column:
    return F.unhex(F.md5(c.cast("binary")))


def line_table(docs: DataFrame, site: str = "source", text: str = "text") -> DataFrame:
    """A row per line that has a word: the text's digest, the line's place and digest, the site (null: one site, '')."""
    # The text's digest is taken below the explode, or it would be taken again for every line.
    held = docs.filter(docs[text].isNotNull()).select(_digest(docs[text]).alias(TEXT), F.coalesce(docs[site], F.lit("")).alias(SITE), docs[text].alias(KEY))
    rows = held.select(TEXT, SITE, F.posexplode(F.split(KEY, "\n")).alias(POS, LINE))
    return rows.filter(F.col(LINE).rlike(NOT_SPACE)).withColumn(LINE, _digest(F.col(LINE)))


def spread_lines(lines: DataFrame, min_sites: int = 10, lg_k: int = 12, margin: float = 0.25) -> DataFrame:
    """Digests of lines found on at least ``min_sites`` distinct sites.

    The sketch's relative error is 1.04 / sqrt(2 ** lg_k), 1.6 % at 12; estimates within ``margin`` (15 times that) of
    the threshold are settled by an exact distinct count.
    """
    sketches = lines.groupBy(LINE).agg(F.hll_sketch_estimate(F.hll_sketch_agg(SITE, F.lit(lg_k))).alias("sites"))
    likely = materialize(sketches.filter(F.col("sites") >= min_sites * (1 - margin)), "line-sketches")
    near = likely.filter(F.col("sites") <= min_sites * (1 + margin)).select(LINE)
    exact = lines.join(near, LINE, "left_semi").select(LINE, SITE).distinct().groupBy(LINE).count().filter(F.col("count") >= min_sites)
    out = materialize(likely.filter(F.col("sites") > min_sites * (1 + margin)).select(LINE).unionByName(exact.select(LINE)), "line-spread")
    discard(likely)
    return out


def _without(parts: Column, places: Column) -> Column:
    """The array without the elements at the given sorted places: a mask is laid out between them, then asked once an element."""
    before = F.concat(F.array(F.lit(-1)), places)
    after = F.concat(places, F.array(F.size(parts)))
    mask = F.flatten(F.zip_with(before, after, lambda a, b: F.concat(F.array_repeat(F.lit(False), b - a - 1), F.array(F.lit(True)))))
    return let(mask, lambda m: F.filter(parts, lambda _, i: ~F.get(m, i)))


def dedup_lines(docs: DataFrame, site: str = "source", text: str = "text", min_sites: int = 10, keep_copies: bool = False, total_as: str = "line_total", removed_as: str = "line_removed", wholly_as: str = "wholly_spread") -> DataFrame:
    """The rows with boilerplate lines taken out of the text, and line_total, line_removed (lines that have a word) and
    wholly_spread.

    A line is boilerplate if it stands on at least ``min_sites`` distinct sites; it goes from every text, whatever its
    share of the words. A text all of whose lines are boilerplate has nothing of its own and is marked wholly_spread;
    with ``keep_copies`` such a text keeps its lines if the same text stands on another row, as near-duplicate removal then
    leaves one of these rows; a text that is made of boilerplate and stands alone loses them like any other.
    Lines are compared as they are; blank lines stay. Null texts stay null and count no lines, and are not wholly
    spread; nor is an empty text. Null sites are one site. Repeated rows are treated alike, and of a line that repeats
    in a text all places go. Very long texts are cut whole, in time proportional to their length. Other columns pass
    through, but for those that have the names of the three results; an empty table gives no rows.
    """
    lines = materialize(line_table(docs, site, text), "lines")
    spread = spread_lines(lines, min_sites)
    found = lines.select(TEXT, POS, LINE).join(sized(spread), LINE, "left_semi").groupBy(TEXT).agg(F.sort_array(F.collect_set(POS)).alias(POS), F.count(F.lit(1)).alias(ROWS))
    found = materialize(found, "line-places")
    discard(lines, spread)
    keyed = docs.withColumn(KEY, _digest(docs[text]))
    joined = keyed.join(sized(found), keyed[KEY] == found[TEXT], "left")
    hit = F.col(POS).isNotNull()
    parts = F.split(F.col(text), "\n")
    n_lines = F.coalesce(F.size(F.filter(parts, lambda x: x.rlike(NOT_SPACE))), F.lit(0))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(n_lines).cast("long")
    counted = joined.withColumns({PREFIX + "total": n_lines, PREFIX + "hits": F.when(hit, F.size(POS)).otherwise(0).cast("long")})
    wholly = hit & (F.col(PREFIX + "hits") == F.col(PREFIX + "total"))
    # A text's places were met once for each row that has it.
    cut = hit & ~(wholly & (F.col(ROWS) > F.size(POS))) if keep_copies else hit
    rest = F.array_join(_without(parts, F.col(POS)), "\n")
    out = {c: F.when(cut, rest).otherwise(F.col(c)) if c == text else F.col(c) for c in docs.columns if c not in (total_as, removed_as, wholly_as)}
    return counted.select(
        *(v.alias(k) for k, v in out.items()),
        F.col(PREFIX + "total").alias(total_as),
        F.when(cut, F.col(PREFIX + "hits")).otherwise(0).cast("long").alias(removed_as),
        wholly.alias(wholly_as),
    )
