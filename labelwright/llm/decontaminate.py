"""Benchmark decontamination: pigeonhole pieces find candidates, Myers' bit-parallel distance verifies them.

An item with a budget of k edits is cut into k + 1 pieces, one of which a contaminated text holds unchanged. Items are
a stated, small query set held against all rows: they go to the workers in blocks of bounded size, one pass of an
Aho-Corasick automaton finds all pieces of a block, and each candidate window is verified exactly.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lodged, ship

SCHEMA = "doc_id long, item_id long, edits int, start long, end long"

_OTHER = bytes(b for b in range(128) if not chr(b).isalnum())
_TO_SPACE = bytes.maketrans(_OTHER, b" " * len(_OTHER))


def normalise(text: str | None) -> str:
    """Lower case, ASCII punctuation and white space to single spaces; one character per UTF-8 byte."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_TO_SPACE).split()).decode("latin-1")


def budget(n: int, rate: float, min_piece: int) -> int:
    """Edits allowed to an item of n characters: a share of its length, and no more than leaves pieces of min_piece."""
    return max(0, min(int(rate * n), n // min_piece - 1))


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end) of the pattern's best place in the text, the first such end; a bit for each pattern character."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << m - 1
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    get = peq.get
    pv, mv, score, best, at = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = ((eq & pv) + pv ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, at = score, j
        ph = ph << 1 & full
        pv = (mh << 1 | ~(xv | ph)) & full
        mv = ph & xv
    return best, at


def ends(pattern: str, text: str, a: int, b: int, k: int) -> Iterator[tuple[int, int]]:
    """(end, edits) of places of the pattern in text[a:b] that are within k edits and no worse than those that end right before and after."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << m - 1
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    get = peq.get
    pv, mv, score, best, at = full, 0, m, k + 1, 0
    for j in range(a, b):
        eq = get(text[j], 0)
        xv = eq | mv
        xh = ((eq & pv) + pv ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        if score < best:
            best, at = score, j + 1
        elif best <= k and (score > k or j + 1 - at > k):
            yield at, best
            best, at = k + 1, 0
        ph = ph << 1 & full
        pv = (mh << 1 | ~(xv | ph)) & full
        mv = ph & xv
    if best <= k:
        yield at, best


def merged(windows: list[tuple[int, int]]) -> list[list[int]]:
    """The windows in order of their start, those that touch as one."""
    out: list[list[int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


class Items:
    """The automaton over the pieces of a block of items."""

    def __init__(self, items: tuple[tuple[int, str], ...], rate: float, min_piece: int):
        import ahocorasick

        # A space on either side: what is found begins and ends with whole words, but that a space can be an edit too.
        self.items = [(i, f" {n} ", budget(len(n), rate, min_piece)) for i, n in items]
        self.grams = [frozenset(zip(n, n[1:], n[2:], n[3:], strict=False)) for _, n, _ in self.items]
        found: dict[str, list[tuple[int, int]]] = {}
        for x, (_, n, k) in enumerate(self.items):
            at = [round(i * len(n) / (k + 1)) for i in range(k + 2)]
            for a, b in zip(at, at[1:], strict=False):
                found.setdefault(n[a:b], []).append((x, a))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def hits(self, norm: str) -> Iterator[tuple[int, int, int, int]]:
        """(item, edits, start, end) of each item's best place within its budget; offsets are into the normalised text."""
        size_of_text, norm = len(norm), f" {norm} "
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (size, uses) in self.seeds.iter(norm):
            for x, at in uses:
                _, n, k = self.items[x]
                a = max(0, last + 1 - size - at - k)
                b = last + 1 - size - at + len(n) + k
                windows.setdefault(x, []).append((a, b))
        for x, spans in windows.items():
            spans = merged(spans)
            item, n, k = self.items[x]
            best, grams, least = None, self.grams[x], len(n) - 3 - 4 * k
            for a, b in spans:
                window = norm[a:b]
                # Each edit spoils four 4-grams at most, so a place within the budget keeps this many.
                if least > 0 and sum(map(grams.__contains__, zip(window, window[1:], window[2:], window[3:], strict=False))) < least:
                    continue
                e, end = (0, at + len(n)) if (at := window.find(n)) >= 0 else myers(n, window)
                if e <= k and (best is None or e < best[0]):
                    back = myers(n[::-1], window[:end][::-1])[1] if e else len(n)
                    best = e, a + end - back, a + end
            if best:
                # Without the spaces at its ends, where an edit has not taken them; one less for the text's own.
                e, start, end = best
                start, end = start + (norm[start] == " ") - 1, end - (norm[end - 1] == " ") - 1
                yield item, e, max(start, 0), min(max(end, start), size_of_text)


@functools.lru_cache(2)
def _block(items: tuple[tuple[int, str], ...], rate: float, min_piece: int) -> Items:
    return Items(items, rate, min_piece)


def forget() -> None:
    """Drops a worker's automata."""
    _block.cache_clear()


def blocks(benchmark: DataFrame, block_chars: int, item_id: str, text: str) -> Iterator[tuple[tuple[int, str], ...]]:
    """The items in blocks of at most ``block_chars`` characters (or one item), streamed through the driver."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).distinct().orderBy("i", "t").toLocalIterator():
        if not (norm := normalise(row["t"])):
            continue
        if block and size + len(norm) > block_chars:
            yield tuple(block)
            block, size = [], 0
        block.append((row["i"], norm))
        size += len(norm)
    if block:
        yield tuple(block)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, min_piece: int = 12, block_chars: int = 4_000_000, id_type: str = "long", doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each row and item of which the text holds a place within the item's edit budget: its best place.

    An item of n normalised characters may differ by min(rate * n, n / min_piece - 1) edits: at 8 % and pieces of 12 the
    first counts from about 300 characters on, below that the length of pieces does. The spaces around an item are part of
    it, so without edits it stands there in whole words; an edit may be spent on such a space. One of fewer than 2 *
    min_piece characters stands there exactly, and one of a single word is held by every text with that word. Items without a letter or digit are ignored, as are null and empty texts; of equally good places
    the first counts. Very long texts are searched whole. Repeated rows give repeated results, repeated items one; null
    ids stay null; extra columns are ignored, whatever their names; an empty table or benchmark gives no rows. Each block
    of items is one scan without a shuffle.
    """
    spark = docs.sparkSession
    ship(spark)
    held = docs.select(docs[doc_id].cast(id_type).alias("doc_id"), docs[text].alias("text"))
    schema, out = SCHEMA.replace("doc_id long", f"doc_id {id_type}"), None
    for items in blocks(benchmark, block_chars, item_id, item_text):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = _block(sent.value, rate, min_piece)
            for batch in batches:
                rows = [(k, *h) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for h in own.hits(normalise(t))]
                types = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["doc_id", "item_id", "edits", "start", "end"])

        part = held.mapInArrow(lodged("decontaminate", forget, run), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)
