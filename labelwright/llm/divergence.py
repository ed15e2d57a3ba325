"""Source divergence audit: how far the term shares of the sources of a language lie apart, in exact integers.

Terms are counted where the texts are read. Kept terms are dealt into blocks by hash, sources too; a tile is a dense
int64 matrix of a block's sources by a block's terms, and all pairs of its rows are compared by broadcasting. A tile
leaves a partial matrix of pairs, which Spark adds up, and the foremost terms of each source, which Spark merges.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, lodged, materialize, nothing, ship, sized

#: What is added to each count.
PRIOR = 5
#: Entries that a task's counters hold before they are given away.
HELD = 200_000

#: Lower-case letters of A to Z and all bytes beyond ASCII stay, anything else ends a term.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The text's terms, in lists from parts of about that many bytes."""
    data, at = text.translate(_FOLD), 0
    while at < len(data):
        end = len(data) if len(data) - at <= size or (end := data.find(b" ", at + size)) < 0 else end
        yield data[at:end].split()
        at = end


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(1000000000 * (count + PRIOR) / total), exact for totals to 9e15: divided three digits at a time."""
    quotient, rest = np.divmod(count + PRIOR, total)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        quotient = quotient * 1000 + digits
    return 1 + quotient


def count_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n, df: partial sums of occurrences and documents; an empty term stands for the group itself."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}

        def out() -> pa.RecordBatch:
            rows = [(g, s, t, c, df[t]) for (g, s), (n, df) in groups.items() for t, c in n.items()]
            types = (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["lang", "source", "term", "n", "df"])

        for batch in batches:
            held = 0
            for g, s, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (own := groups.get((g, s))) is None:
                    own = groups[g, s] = (Counter({b"": 0}), Counter())
                seen: set[bytes] = set()
                for part in terms(t):
                    own[0].update(part)
                    seen.update(part)
                own[1].update(seen)
                held += len(seen)
                if held > HELD and sum(len(n) for n, _ in groups.values()) > HELD:
                    yield out()
                    groups.clear()
                    held = 0
        yield out()

    held = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).cast("binary").alias(k) for k, c in (("lang", lang), ("source", source), ("text", text))))
    return held.mapInArrow(lodged("divergence", nothing, run), "lang binary, source binary, term binary, n long, df long")


def tile(unit: pa.Table, top: int, lines: int = 8) -> pa.Table:
    """The partial results of one block of terms with one or two blocks of sources.

    Rows without a term give the sources and their totals, the others counts. ``pair``: value, the sum over the terms that
    stand in the tile; seen, how many these are; gap, what any other term adds. ``term``: the ``top`` foremost terms.
    """
    sources = unit.filter(pc.is_null(unit["term"]))
    sources = sources.take(pc.sort_indices(sources["source"]))
    unit = unit.filter(pc.is_valid(unit["term"]))
    names = pc.unique(unit["term"])
    names = names.take(pc.sort_indices(names))
    row, col = (pc.index_in(unit[k], value_set=of).to_numpy() for k, of in (("source", sources["source"].combine_chunks()), ("term", names)))
    counts = np.zeros((len(sources), len(names)), dtype=np.int64)
    counts[row, col] = unit["n"].to_numpy()
    totals = np.maximum(sources["total"].to_numpy(), 1)
    p, rare = share(counts, totals[:, None]), share(np.zeros_like(totals), totals)
    found: list[tuple] = []
    lo, hi = unit_blocks(sources)
    block, source = sources["block"].to_numpy(), sources["source"].to_pylist()
    lang, kept = sources["lang"][0].as_py(), sources["kept"][0].as_py()
    for at in range(0, len(source), lines):
        apart = np.zeros((len(p[at : at + lines]), len(source)), dtype=np.int64)
        for t in range(0, len(names), 2048):
            part = p[:, t : t + 2048]
            apart += np.abs(part[at : at + lines, None, :] - part[None, :, :]).sum(-1)
        for i in range(at, at + len(apart)):
            others = np.flatnonzero(block == hi) if lo != hi else np.arange(i + 1, len(source))
            if lo == hi or block[i] == lo:
                found += [(lang, "pair", source[i], source[j], int(apart[i - at, j]), len(names), int(abs(rare[i] - rare[j])), kept) for j in others]
    if lo == hi and len(names):
        whole = np.zeros(len(names), dtype=np.int64)
        whole[col] = unit["whole"].to_numpy()
        over = np.where(counts > 0, p - share(whole, np.int64(max(sources["lang_total"][0].as_py(), 1))), 0)
        for i, name in enumerate(source):
            own = np.flatnonzero(over[i] > 0)
            own = own[np.argsort(-over[i, own], kind="stable")[:top]]
            found += [(lang, "term", name, names[int(j)].as_py(), int(over[i, j]), 0, 0, kept) for j in own]
    types = (pa.binary(), pa.string(), pa.binary(), pa.binary(), *[pa.int64()] * 4)
    return pa.table([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], names=["lang", "part", "source", "item", "value", "seen", "gap", "kept"])


def unit_blocks(sources: pa.Table) -> tuple[int, int]:
    """The two blocks of sources that the unit compares."""
    return sources["lo"][0].as_py(), sources["hi"][0].as_py()


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, tile_terms: int = 2048, tile_sources: int = 64, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank of every source of every language.

    ``pair`` ranks the other sources by the sum, over the language's kept terms (those in ``min_docs`` of its documents), of
    the distance of shares; ``term`` the ``top`` kept terms whose share in the source lies furthest above the language's.
    Null texts, languages and sources are ''. A group without terms has shares like any other; a language without kept
    terms has pairs of value 0; one source alone has no pairs. Very long texts count whole; ties go by the item's bytes;
    repeated rows count each; extra columns are ignored, whatever their names; an empty table gives no rows.
    """
    counted = materialize(count_terms(docs, text, lang, source).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "term-counts")
    worded = counted.filter(F.length("term") > 0)
    kept = materialize(worded.groupBy("lang", "term").agg(F.sum("n").alias("whole"), F.sum("df").alias("df")).filter(F.col("df") >= min_docs).drop("df"), "kept-terms")
    rows = materialize(worded.drop("df").join(sized(kept), ["lang", "term"]), "kept-counts")
    sums = materialize(rows.groupBy("lang", "source").agg(F.sum("n").alias("n")), "source-sums")
    named = counted.filter(F.length("term") == 0).select("lang", "source")
    langs = named.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("whole").alias("whole")), "lang", "left").na.fill(0)
    blocks = lambda n, size: F.greatest(F.ceil(F.col(n) / size), F.lit(1)).cast("long")
    langs = materialize(langs.select("lang", "kept", (F.col("whole") + PRIOR * F.col("kept")).alias("lang_total"), blocks("kept", tile_terms).alias("term_blocks"), blocks("sources", tile_sources).alias("source_blocks")), "languages")

    def dealt(of: DataFrame) -> DataFrame:
        """Each row once for every block of sources that its own is compared with."""
        of = of.withColumn("block", F.pmod(F.xxhash64("source"), "source_blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("source_blocks") - 1)))
        return of.select("lang", "at", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "source", "term", "n", "whole", "total", "lang_total", "kept")

    none = F.lit(None).cast("long")
    heads = named.join(sized(sums), ["lang", "source"], "left").join(sized(langs), "lang").withColumn("total", F.coalesce("n", F.lit(0)) + PRIOR * F.col("kept"))
    heads = heads.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1)))
    heads = heads.withColumn("term", F.lit(None).cast("binary")).withColumn("n", none).withColumn("whole", none)
    body = rows.join(sized(langs), "lang").withColumn("at", F.pmod(F.xxhash64("term"), "term_blocks")).withColumn("total", none)
    units = dealt(heads).unionByName(dealt(body))
    schema = "lang binary, part string, source binary, item binary, value long, seen long, gap long, kept long"
    ship(docs.sparkSession)
    parts = units.groupBy("lang", "at", "lo", "hi").applyInArrow(lambda unit: tile(unit, top), schema)
    parts = materialize(parts, "tiles")
    discard(counted, kept, rows, sums, langs)
    pairs = parts.filter("part = 'pair'").groupBy("lang", "source", "item").agg((F.sum("value") + (F.max("kept") - F.sum("seen")) * F.max("gap")).alias("value"))
    pairs = materialize(pairs, "pairs")
    both = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    first = parts.filter("part = 'term'").select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out = both.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair")).unionByName(first.withColumn("part", F.lit("term")))
    return out.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "part", "item")), "value", F.col("rank").cast("int").alias("rank"))
