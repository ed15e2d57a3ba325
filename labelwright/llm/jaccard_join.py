"""Near duplicates by a chosen-path similarity join on word n-gram sets.

Texts with equal sets are one set with a number of copies. Sets are embedded as min-wise tokens; each run walks a tree
whose nodes pick random tokens, and a set follows every picked token it holds, so similar sets meet in a leaf far more
often than others. Nodes with few sets are compared by brute force, larger ones are split on; runs are repeated until a
pair at the threshold meets with the target probability.

A class is what links connect, so sets that are known to be connected need not be compared again. The first run's leaves
are covered with stars: a set and all that look like it. Verified stars label the sets, and from then on only sets of
different labels are compared. Every further run adds each set's best candidate in another label; these are verified, and
join labels. What then stands in one leaf with a candidate in another label is verified throughout, with nothing left out.

So classes cost a dense group a row for each of its sets and leaves, and a comparison with a few representatives: rows,
bytes and comparisons grow with its size. They grow faster only where sets are nearly as similar as the threshold without
being linked, as then every pair has to be refuted; these pairs are dealt in blocks of bounded size.

Links are counted afterwards. All links of a set lie in its class, so the sets of a class are compared with each other,
exactly and each pair once, in blocks; that is quadratic in the sets of a class, and only the counts leave a block.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, lodged, materialize, nothing, ship, sized
from .components import components

WORDS = 5
TOKENS = 64
#: A bucket whose average similarity is within this of the threshold is compared, not split.
DENSE = 0.05
#: Sets in buckets that are split below one of these levels take the further runs of the next.
LEVELS = (3, 8, 16, 32)
#: Buckets of up to so many sets are compared together, many at a time.
SMALL = 64
U = np.uint64

_rng = np.random.default_rng(20)
_XOR = _rng.integers(1 << 63, size=TOKENS, dtype=np.uint64)
_MUL = _rng.integers(1 << 63, size=TOKENS, dtype=np.uint64) << U(1) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n lower-case words; of all words where there are fewer; of none, none."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(n, len(words))
    own = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for j in range(width):
        own = mix(own * U(0x9E3779B97F4A7C15) + h[j : j + len(own)])
    return np.unique(own)


def signature(own: np.ndarray) -> np.ndarray:
    """The set's min-wise tokens, a byte each: different minima agree once in 256."""
    best = np.full(TOKENS, 0xFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(own), 4096):
        part = own[at : at + 4096]
        best = np.minimum(best, (((part[None, :] ^ _XOR[:, None]) * _MUL[:, None]) >> U(32)).min(1))
    return mix(best).astype(np.uint8)


def meeting_probability(threshold: float, depth: int) -> float:
    """That two sets at the threshold share a node at that depth of one walk: picks are Poisson with mean 1 / threshold."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return p


def runs_for(recall: float, threshold: float, depth: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - meeting_probability(threshold, depth)))


def split_runs(recall: float, threshold: float) -> list[int]:
    """Runs of every set, and further runs of sets whose buckets had to be split below each of LEVELS but the last.

    A pair whose buckets are compared down to a level is lost if it parts above it in all runs that its sets take; the
    chances of all levels together stay within 1 - recall.
    """
    shares = [2.0 ** -min(i + 1, len(LEVELS) - 1) for i in range(len(LEVELS))]
    totals = [runs_for(1 - (1 - recall) * x, threshold, d) for x, d in zip(shares, LEVELS, strict=True)]
    return [b - a for a, b in zip([0, *totals], totals, strict=False)]


def _children(path: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path): each row's walk from its path along every picked token; equal paths and tokens pick alike."""
    places = np.arange(1, TOKENS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)
    h = mix(mix(path[:, None] + places[None, :]) ^ tokens.astype(np.uint64) * U(0xD6E8FEB86659FD93))
    row, place = np.nonzero(h < U(int((2**64 - 1) / (threshold * TOKENS))))
    return row, mix(h[row, place] + U(0xA0761D6478BD642F))


def _signed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, digest of the text, set id, size, tokens; the last three null without a word. Both digests have 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sid, n, sig = [], [], []
            for t in batch.column(2).to_pylist():
                own = shingles(t) if t else ()
                sid.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                n.append(len(own) or None)
                sig.append(signature(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sid, pa.binary()), pa.array(n, pa.int32()), pa.array(sig, pa.binary())], names=["doc_id", "digest", "sid", "n", "sig"])

    held = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_digest(docs[text]).alias("digest"), docs[text].alias("text"))
    return held.mapInArrow(lodged("jaccard_join", nothing, run), "doc_id long, digest binary, sid binary, n int, sig binary")


def text_digest(text: Column) -> Column:
    """128 bits that tell a text; null for null."""
    return F.unhex(F.md5(text))


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, TOKENS)


ROWS = "path long, sid binary, n int, sig binary, label long"
FIELDS = ("sid", "n", "sig", "label")


def _walk(rows: DataFrame, threshold: float, levels: int) -> DataFrame:
    """The rows (path, sid, n, sig, label) that many levels deeper."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                path, sig = part.column(0).to_numpy().view(np.uint64), _tokens(part.column(3))
                own = np.arange(part.num_rows)
                for _ in range(levels):
                    row, path = _children(path, sig[own], threshold)
                    own = own[row]
                taken = part.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), *(taken.column(i) for i in (1, 2, 3, 4))], names=["path", *FIELDS])

    return rows.select("path", *FIELDS).mapInArrow(lodged("jaccard_join", nothing, run), ROWS)


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links of a symmetric boolean matrix that connect what all of its links connect."""
    out, left = [], linked.any(1)
    while left.any():
        front = np.array([np.argmax(left)])
        left[front] = False
        while len(front):
            near = linked[:, front] & left[:, None]
            new = np.flatnonzero(near.any(1))
            out += zip(new.tolist(), front[near[new].argmax(1)].tolist(), strict=True)
            left[new] = False
            front = new
    return out


def _joining(linked: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the labels which all links connect."""
    names, code = np.unique(label, return_inverse=True)
    i, j = np.nonzero(linked)
    pair, first = np.unique(code[i] * len(names) + code[j], return_index=True)
    between = np.zeros((len(names), len(names)), dtype=bool)
    between[pair // len(names), pair % len(names)] = True
    link = dict(zip(pair.tolist(), first.tolist(), strict=True))
    return [(int(i[k]), int(j[k])) for a, b in spanning(between) for k in (link[a * len(names) + b],)]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of two rows and more that are equal in the first column, over batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None

    def whole() -> Iterator[pa.RecordBatch]:
        if sum(b.num_rows for b in held) > 1:
            yield held[0] if len(held) == 1 else pa.concat_batches(held)

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        at = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [batch.num_rows]])
        if held and key[0] != last:
            yield from whole()
            held = []
        if len(at) == 2:
            held.append(batch)
        else:
            held.append(batch.slice(0, at[1]))
            yield from whole()
            for i in np.flatnonzero(np.diff(at[1:-1]) > 1) + 1:
                yield batch.slice(at[i], at[i + 1] - at[i])
            held = [batch.slice(at[-2])]
        last = key[-1]
    yield from whole()


_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
#: Tokens in the first half of a signature, by words of eight.
HALF = TOKENS // 16


def _words(sig: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(sig).view(np.uint64)


def _equal(x: np.ndarray) -> np.ndarray:
    """How many bytes of each word are zero: only there a top bit is left."""
    return np.bitwise_count(~((x & _LOW) + _LOW | x | _LOW))


def _agreement(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """How many tokens each set has in common with each of the others; both as words."""
    same = np.zeros((len(mine), len(theirs)), dtype=np.uint8)
    for k in range(mine.shape[1]):
        same += _equal(mine[:, k, None] ^ theirs[None, :, k])
    return same


def _near(n: np.ndarray, sig: np.ndarray, rows: int, least: float, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, tokens in common) of pairs i < j, i below ``rows``, that may be as similar as the threshold, by tokens and sizes.

    Blocks of rows meet what comes after their first one. After half of the tokens only pairs go on that can still have
    enough; where these are few, one by one.
    """
    words, need, at = _words(sig), math.ceil(least * TOKENS), 0
    while at < rows:
        end = min(rows, at + max(1, (1 << 18) // (len(n) - at)))
        mine, theirs = words[at:end], words[at:]
        same = _agreement(mine[:, :HALF], theirs[:, :HALF])
        i, j = np.nonzero(same >= max(0, need - TOKENS // 2))
        if 4 * len(i) > same.size:
            same += _agreement(mine[:, HALF:], theirs[:, HALF:])
            i, j = np.nonzero(same >= need)
            both = same[i, j]
        else:
            both = same[i, j] + _equal(mine[i, HALF:] ^ theirs[j, HALF:]).sum(1, dtype=np.uint8)
        x, y = n[at + i], n[at + j]
        ok = (j > i) & (both >= need) & (np.minimum(x, y) >= threshold * np.maximum(x, y))
        yield at + i[ok], at + j[ok], both[ok]
        at = end


def _alike(n: np.ndarray, sig: np.ndarray, least: float, threshold: float) -> np.ndarray:
    """Which pairs of sets may be as similar as the threshold, by their tokens and sizes."""
    out = np.zeros((len(n), len(n)), dtype=bool)
    for i, j, _ in _near(n, sig, len(n), least, threshold):
        out[i, j] = out[j, i] = True
    return out


def average(sig: np.ndarray) -> float:
    """The average similarity of two of the sets, by the tokens that not all of them share, as those of their path; 1 if all do."""
    m = len(sig)
    counts = [np.bincount(sig[:, k]) for k in range(TOKENS)]
    same = [int((c * (c - 1)).sum()) for c in counts if c.max() < m]
    return sum(same) / (len(same) * m * (m - 1)) if same else 1.0


def _leaves(path: np.uint64, sig: np.ndarray, label: np.ndarray, level: int, threshold: float, bucket: int, reached: np.ndarray) -> Iterator[tuple[np.uint64, np.ndarray]]:
    """(cell, rows) of each leaf below a bucket; ``reached`` is raised to the deepest level that each row was split to.

    A bucket of more than ``bucket`` sets is split on, unless its sets are about as similar as the threshold on average:
    then a good part of its pairs are links, and it is a leaf. So is what is large at the deepest level. Where all sets have
    one label there is nothing to find.
    """
    stack = [(path, np.arange(len(sig)), level)]
    while stack:
        path, own, level = stack.pop()
        if (label[own] == label[own[0]]).all():
            continue
        if len(own) <= bucket or level >= LEVELS[-1] or average(sig[own]) >= threshold - DENSE:
            yield path, own
        else:
            reached[own] = np.maximum(reached[own], level + 1)
            row, child = _children(np.full(len(own), path), sig[own], threshold)
            order = np.argsort(child, kind="stable")
            row, child = own[row[order]], child[order]
            at = np.concatenate([[0], np.flatnonzero(child[1:] != child[:-1]) + 1, [len(child)]])
            stack += [(child[at[i]], row[at[i] : at[i + 1]], level + 1) for i in np.flatnonzero(np.diff(at) > 1)]


def _stars(n: np.ndarray, sig: np.ndarray, least: float, threshold: float, small: int = 2048) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which sets have a candidate, and (middle, set) pairs: every one of those is a middle or has one, the first it can."""
    met, pairs = np.zeros(len(n), dtype=bool), []
    if len(n) <= small:
        found = list(_near(n, sig, len(n), least, threshold))
        i, j = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        met[i] = met[j] = True
        return met, _cover(i, j, len(n))
    words, left, need = _words(sig), np.arange(len(n)), math.ceil(least * TOKENS)
    while len(left):
        i = left[0]
        near = (_agreement(words[i : i + 1], words)[0] >= need) & (np.minimum(n, n[i]) >= threshold * np.maximum(n, n[i]))
        near[i] = False
        if near.any():
            met[i] = True
            met |= near
        pairs += [(i, j) for j in left[near[left]].tolist()]
        left = left[~near[left]][1:]
    return met, pairs


def _cover(i: np.ndarray, j: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Stars of candidate pairs i < j: a middle comes before its sets, so only what comes after one matters."""
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    free, pairs = np.ones(size, dtype=bool), []
    first, since = np.unique(i, return_index=True)
    for a, own in zip(first.tolist(), np.split(j, since[1:]), strict=True) if len(i) else ():
        if free[a]:
            own = own[free[own]]
            free[own] = False
            pairs += [(a, b) for b in own.tolist()]
    return pairs


def _best(n: np.ndarray, sig: np.ndarray, label: np.ndarray, least: float, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which sets have a candidate in another label, and (candidate, set) pairs: of each set that isn't of the leaf's most
    frequent label the best one in that label and the best one in any other."""
    names, code, times = np.unique(label, return_inverse=True, return_counts=True)
    met = np.zeros(len(n), dtype=bool)
    if len(names) == 1:
        return met, []
    often = code == times.argmax()
    # The others first: they meet each other and that label, whose sets do not meet.
    order = np.argsort(often, kind="stable")
    found = []
    for i, j, same in _near(n[order], sig[order], int((~often).sum()), least, threshold):
        i, j = order[i], order[j]
        ok = code[i] != code[j]
        i, j, same = i[ok], j[ok], same[ok]
        met[i] = met[j] = True
        # Each way, of the best of this block alone.
        found.append(_foremost(np.append(i, j), np.append(j, i), np.append(same, same), often))
    own, other, _ = _foremost(*(np.concatenate([x[k] for x in found]) for k in range(3)), often)
    return met, list(zip(other.tolist(), own.tolist(), strict=True))


def _foremost(own: np.ndarray, other: np.ndarray, same: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set that isn't in the frequent label its best candidate there and its best one elsewhere, the first of equals."""
    rare = ~often[own]
    own, other, same = own[rare], other[rare], same[rare]
    order = np.lexsort((other, -same.astype(np.int16), often[other], own))
    own, other, same = own[order], other[order], same[order]
    first = np.append(True, (own[1:] != own[:-1]) | (often[other[1:]] != often[other[:-1]]))[: len(own)]
    return own[first], other[first], same[first]


MET = "cell long, sid binary, other binary, stage int"


def _stage(level: np.ndarray) -> np.ndarray:
    """How many of LEVELS, but for the last, a level is below."""
    return np.searchsorted(LEVELS[:-1], level, side="left")


def _meet(rows: DataFrame, threshold: float, least: float, bucket: int, level: int, stars: bool) -> DataFrame:
    """With a cell: the leaves in which a set has a candidate of another label. With another set: pairs to verify, of
    :func:`_stars` or :func:`_best`. With a stage: sets whose buckets were split below the first of LEVELS.

    One shuffle by path; buckets are split and compared where they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[pa.Array]] = [[], [], [], []]
        held_rows = 0

        def add(m: int, **known: pa.Array) -> None:
            for column, (k, t) in zip(parts, (("cell", pa.int64()), ("sid", pa.binary()), ("other", pa.binary()), ("stage", pa.int32())), strict=True):
                column.append(known[k] if k in known else pa.nulls(m, t))

        def out() -> pa.RecordBatch:
            add(0)
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in parts], names=["cell", "sid", "other", "stage"])

        def keep(sid: pa.Array, cells: np.ndarray, met: np.ndarray, pairs: list[tuple[int, int]], own: np.ndarray) -> int:
            where = own[met]
            add(len(where), cell=pa.array(cells[met]), sid=sid.take(pa.array(where)))
            if pairs:
                a, b = (own[list(x)] for x in zip(*pairs, strict=True))
                add(len(a), sid=sid.take(pa.array(a)), other=sid.take(pa.array(b)))
            return len(where) + len(pairs)

        for block in _whole(batches):
            path = block.column(0).to_numpy()
            starts = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
            sizes = np.diff(np.append(starts, len(path)))
            small = min(SMALL, bucket)
            own = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= small), sizes))
            if len(own):
                part = block.take(pa.array(own))
                end = np.repeat(np.cumsum(s := sizes[(sizes > 1) & (sizes <= small)]), s)
                met, pairs = _small(end, small, part.column(2).to_numpy(), _tokens(part.column(3)), part.column(4).to_numpy(), least, threshold, stars)
                held_rows += keep(part.column(1), part.column(0).to_numpy(), met, pairs, np.arange(len(own)))
            for k in np.flatnonzero(sizes > small):
                held = block.slice(int(starts[k]), int(sizes[k]))
                sid, n, sig, label = held.column(1), held.column(2).to_numpy(), _tokens(held.column(3)), held.column(4).to_numpy()
                reached = np.full(len(n), level)
                for cell, own in _leaves(np.uint64(int(path[starts[k]]) & (1 << 64) - 1), sig, label, level, threshold, bucket, reached):
                    met, pairs = _stars(n[own], sig[own], least, threshold) if stars else _best(n[own], sig[own], label[own], least, threshold)
                    held_rows += keep(sid, np.full(len(own), np.array([cell]).view(np.int64)[0]), met, pairs, own)
                if len(own := np.flatnonzero(reached > LEVELS[0])):
                    add(len(own), sid=sid.take(pa.array(own)), stage=pa.array(_stage(reached[own]).astype(np.int32)))
                    held_rows += len(own)
            if held_rows >= 50_000:
                yield out()
                parts, held_rows = [[], [], [], []], 0
        yield out()

    return rows.select("path", *FIELDS).repartition("path").sortWithinPartitions("path", "sid").mapInArrow(lodged("jaccard_join", nothing, run), MET)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches that end where a run of equal first columns ends."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if held and key[0] != last:
            yield pa.concat_batches(held)
            held = []
        change = np.flatnonzero(key[1:] != key[:-1])
        if len(change):
            cut = int(change[-1]) + 1
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
        last = key[-1]
    if held:
        yield pa.concat_batches(held)


def _small(end: np.ndarray, most: int, n: np.ndarray, sig: np.ndarray, label: np.ndarray, least: float, threshold: float, stars: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """:func:`_stars` or :func:`_best` of many small buckets at once; end: where each row's bucket ends, each of ``most`` at most.

    A row is compared with the one after it, then the one after that, as long as any bucket reaches as far.
    """
    words, need, found = _words(sig), math.ceil(least * TOKENS), []
    row = np.arange(len(n))
    for d in range(1, most):
        row = row[row + d < end[row]]
        if not len(row):
            break
        i = row if stars else row[label[row] != label[row + d]]
        same = _equal(words[i, :HALF] ^ words[i + d, :HALF]).sum(1, dtype=np.uint8)
        ok = (same >= max(0, need - TOKENS // 2)) & (np.minimum(n[i], n[i + d]) >= threshold * np.maximum(n[i], n[i + d]))
        i, same = i[ok], same[ok]
        same += _equal(words[i, HALF:] ^ words[i + d, HALF:]).sum(1, dtype=np.uint8)
        ok = same >= need
        found.append((i[ok], i[ok] + d, same[ok]))
    i, j, same = (np.concatenate([np.empty(0, t), *(x[k] for x in found)]) for k, t in enumerate((np.int64, np.int64, np.uint8)))
    met = np.zeros(len(n), dtype=bool)
    met[i] = met[j] = True
    if stars:
        return met, _cover(i, j, len(n))
    # Each bucket's most frequent label, of equally frequent ones the least.
    order = np.lexsort((label, end))
    new = np.flatnonzero(np.append(True, (label[order][1:] != label[order][:-1]) | (end[order][1:] != end[order][:-1])))[: len(n)]
    times = np.diff(np.append(new, len(n)))
    bucket, name = end[order][new], label[order][new]
    first = np.lexsort((name, -times, bucket))
    top = first[np.append(True, bucket[first][1:] != bucket[first][:-1])[: len(first)]]
    often = label == name[top][np.searchsorted(bucket[top], end)] if len(n) else met
    own, other, _ = _foremost(np.append(i, j), np.append(j, i), np.append(same, same), often)
    return met, list(zip(other.tolist(), own.tolist(), strict=True))


def _averages(rows: DataFrame) -> DataFrame:
    """path, likeness: the average similarity of the sets of each path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(held.column(0)[0].as_py(), average(_tokens(held.column(3)))) for held in _groups(batches)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.float64()))], names=["path", "likeness"])

    return rows.repartition("path").sortWithinPartitions("path").mapInArrow(lodged("jaccard_join", nothing, run), "path long, likeness double")


def _covered(dense: DataFrame, threshold: float, least: float, crowded: int, level: int) -> list[DataFrame]:
    """Written tables of :func:`_meet` that cover dense buckets of any size (path, count, sets) with stars.

    A bucket is covered in blocks of about half of ``crowded``, then the middles of its blocks' stars among themselves,
    until they fit into one task or nothing joins any more.
    """
    out, now, spent = [], dense, []
    while True:
        block = F.pmod(F.xxhash64("sid"), F.ceil(F.col("count") * 2 / crowded).cast("long"))
        met = materialize(_meet(now.withColumn("path", F.xxhash64("path", block)), threshold, least, 1 << 31, level, True).filter("other is not null"), "met")
        out.append(met)
        covered = materialize(met.select(F.col("other").alias("sid")).distinct(), "covered")
        middles = now.join(sized(covered), "sid", "left_anti")
        larger = materialize(middles.groupBy("path").agg(F.count(F.lit(1)).alias("left"), F.max("count").alias("before")).filter((F.col("before") > crowded / 2) & (F.col("left") < 0.9 * F.col("before"))), "large-buckets")
        spent += [covered, larger]
        if larger.isEmpty():
            discard(*spent)
            return out
        now = materialize(middles.drop("count").join(sized(larger.select("path", F.col("left").alias("count"))), "path"), "paths")
        spent.append(now)


def _descend(sets: DataFrame, roots: list[int], threshold: float, least: float, bucket: int, crowded: int, stars: bool) -> list[DataFrame]:
    """Written tables of :func:`_meet` from a walk from each root, which begins two levels deep; sets: sid, n, sig, label.

    Buckets of up to ``crowded`` sets go to one task each. Larger ones are counted first and walk on, a level at a time,
    before anything is dealt by path. One that is alike throughout, told by about 512 of its sets drawn by hash, is a leaf:
    all its sets meet there, if they have more than one label.
    """
    rows, level, out = _walk(sets.select(F.explode(F.array(*map(F.lit, roots)).cast("array<long>")).alias("path"), *FIELDS), threshold, 2), 2, []
    none = {"other": F.lit(None).cast("binary"), "stage": F.lit(None).cast("int"), "cell": F.lit(None).cast("long")}
    while True:
        counted = rows.groupBy("path").agg(F.count(F.lit(1)).alias("count"), F.min("label").alias("low"), F.max("label").alias("high"))
        large = materialize(counted.filter(F.col("count") > crowded), "large-buckets")
        if large.isEmpty():
            discard(large)
            return [*out, materialize(_meet(rows, threshold, least, bucket, level, stars), "met")]
        out.append(materialize(_meet(rows.join(sized(large), "path", "left_anti"), threshold, least, bucket, level, stars), "met"))
        # A bucket of one label has nothing to find.
        over = rows.join(sized(large.filter("low <> high").select("path", "count")), "path")
        drawn = over.filter(F.pmod(F.xxhash64("sid", "path"), F.col("count")) < 512).select("path", *FIELDS)
        dense = F.coalesce(F.col("likeness") >= threshold - DENSE, F.lit(False)) | F.lit(level >= LEVELS[-1])
        judged = materialize(large.filter("low <> high").join(_averages(drawn), "path", "left").select("path", "count", dense.alias("dense")), "likeness")
        over = rows.join(sized(judged), "path")
        leaf = over.filter("dense").select("path", "count", *FIELDS)
        out.append(materialize(leaf.select(F.col("path").alias("cell"), "sid", none["other"].alias("other"), none["stage"].alias("stage")), "met"))
        if stars:
            out += _covered(leaf, threshold, least, crowded, level)
        rows, level = materialize(_walk(over.filter("not dense"), threshold, 1), "paths"), level + 1
        if stage := int(_stage(np.array(level))):
            deeper = over.filter("not dense").select(none["cell"].alias("cell"), "sid", none["other"].alias("other"), F.lit(stage).alias("stage"))
            out.append(materialize(deeper.distinct(), "deeper"))
        discard(large)


def _runs(sets: DataFrame, threshold: float, recall: float, bucket: int, least: float, crowded: int, first: bool) -> DataFrame:
    """A written table of :func:`_meet`: of the first run, or of all others.

    Sets in buckets that are split deep take further runs, as a pair meets the less the deeper it has to.
    """
    runs = split_runs(recall, threshold)
    roots = [int(x) for x in mix(np.arange(1, sum(runs) + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)).view(np.int64)]
    met = _descend(sets, roots[:1] if first else roots[1 : runs[0]], threshold, least, bucket, crowded, first)
    every = lambda: functools.reduce(DataFrame.unionByName, met)
    for stage in range(1, 1 if first else len(runs)):
        crowd = materialize(every().filter(F.col("stage") >= stage).select("sid").distinct(), "crowd")
        if crowd.isEmpty():
            discard(crowd)
            break
        a = sum(runs[:stage])
        met += _descend(sets.join(sized(crowd), "sid", "left_semi"), roots[a : a + runs[stage]], threshold, least, bucket, crowded, False)
        discard(crowd)
    out = materialize(every().filter("stage is null"), "met")
    discard(*met)
    return out


def _labelled(sets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Adds label: a hash of the component's root, or of the set itself where it has no link yet. Equal hashes of two
    labels would hide the links between those two alone."""
    if labels is None:
        return sets.withColumn("label", F.xxhash64("sid"))
    named = labels.select(F.col("node").alias("sid"), "root")
    return sets.join(sized(named), "sid", "left").withColumn("label", F.xxhash64(F.coalesce("root", "sid"))).drop("root")


def _checked(pairs: DataFrame, own: DataFrame, threshold: float) -> DataFrame:
    """Which of the pairs (a, b) are similar; own: sid, own. A set of many pairs stands as ``a`` and is dealt in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype="<u8") for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    often = materialize(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 256).cast("long").alias("parts")), "often")
    dealt = pairs.join(sized(often), "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts"))
    left = often.join(own.withColumnRenamed("sid", "a"), "a").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("a", "part", F.col("own").alias("x"))
    right = dealt.join(own.select(F.col("sid").alias("b"), F.col("own").alias("y")), "b")
    return right.join(left, ["a", "part"]).select("a", "b", "x", "y").mapInArrow(lodged("jaccard_join", nothing, run), "a binary, b binary")


def _units(met: DataFrame, sets: DataFrame, block: int = 512) -> DataFrame:
    """unit, rare, sid, n, sig, label: what is still to verify, in units of about two blocks; met: cell, sid.

    Of each leaf with more than one label, sets of its most frequent label are in blocks that meet every block of the
    others, and those meet each other; pairs of the frequent label are connected already. Equal leaves count once.
    """
    rows = materialize(met.join(sets.select("sid", "label"), "sid"), "cells")
    labels = rows.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(sid))").alias("a"), F.expr("bit_xor(xxhash64(sid, 1))").alias("b"))
    cells = labels.groupBy("cell").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels"), F.expr("bit_xor(a)").alias("a"), F.expr("bit_xor(b)").alias("b"))
    cells = cells.filter("labels > 1").groupBy("n", "a", "b").agg(F.min(F.struct("cell", "top")).alias("x"))
    parts = lambda c: F.greatest(F.ceil(c / block), F.lit(1)).cast("long")
    cells = materialize(cells.select("x.cell", F.col("x.top.label").alias("most"), parts(F.col("x.top.n")).alias("common"), parts(F.col("n") - F.col("x.top.n")).alias("others")), "open-cells")
    held = rows.join(sized(cells), "cell").withColumn("rare", F.col("label") != F.col("most"))
    at = F.pmod(F.xxhash64("sid"), F.when(F.col("rare"), F.col("others")).otherwise(F.col("common")))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    unit = lambda kind, x, y: F.xxhash64("cell", F.lit(kind), x, y)
    among = F.transform(upto("others"), lambda k: unit(0, F.least("at", k), F.greatest("at", k)))
    across = F.when(F.col("rare"), F.transform(upto("common"), lambda k: unit(1, k, F.col("at")))).otherwise(F.transform(upto("others"), lambda k: unit(1, F.col("at"), k)))
    every = F.when(F.col("rare"), F.concat(among, across)).otherwise(across)
    out = held.withColumn("at", at).select(F.explode(every).alias("unit"), "rare", "sid")
    out = materialize(out.join(sets, "sid"), "units")
    discard(rows, cells)
    return out


def similar(sets: list[np.ndarray], threshold: float, first: int = 0) -> np.ndarray:
    """Which pairs of sets (sorted distinct hashes) have at least the threshold's Jaccard similarity; of the ``first`` ones
    with the others alone, if that is given."""
    m, n = len(sets), np.array([len(s) for s in sets])
    rows, columns = (slice(0, first), slice(first, m)) if first else (slice(0, m), slice(0, m))
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    del values
    owner, shared = np.repeat(np.arange(m), n), times[at] > 1
    owner, at = owner[shared], (np.cumsum(times > 1) - 1)[at[shared]]
    both = np.zeros((len(n[rows]), len(n[columns])), dtype=np.float64)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    width = int(at[-1]) + 1 if len(at) else 0
    for a in range(0, width, 2048):
        i, j = np.searchsorted(at, (a, a + 2048))
        x = np.zeros((m, min(2048, width - a)), dtype=np.float32)
        x[owner[i:j], at[i:j] - a] = 1
        both += x[rows] @ x[columns].T
    union = n[rows, None] + n[None, columns] - both
    return both >= threshold * union - 1e-9


def _verified(sets: list[np.ndarray], pairs: np.ndarray, threshold: float, words: int) -> np.ndarray:
    """Which of the pairs are similar; long sets are compared in blocks of a bounded number of words."""
    at = np.cumsum([len(s) for s in sets]) * 2 // words
    blocks = [np.flatnonzero(at == x) for x in np.unique(at)]
    out = np.zeros_like(pairs)
    for i, a in enumerate(blocks):
        for b in blocks[i:]:
            own = np.unique(np.concatenate([a, b]))
            if (wanted := pairs[np.ix_(own, own)]).any():
                out[np.ix_(own, own)] |= wanted & similar([sets[x] for x in own], threshold)
    return out


def _compare(units: DataFrame, threshold: float, least: float, words: int) -> DataFrame:
    """a, b: links that connect what all links between sets of different labels in a unit connect.

    Units: unit, sid, n, sig, label, own (the set), sorted by unit here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches):
            n, sig, label = held.column(2).to_numpy(), _tokens(held.column(3)), held.column(4).to_numpy()
            pairs = _alike(n, sig, least, threshold) & (label[:, None] != label[None, :])
            at = np.flatnonzero(pairs.any(1))
            if len(at):
                sets = [np.frombuffer(held.column(5)[int(i)].as_buffer(), dtype="<u8") for i in at]
                found = _joining(_verified(sets, pairs[np.ix_(at, at)], threshold, words), label[at])
                if found:
                    a, b = (held.column(1).take(pa.array(at[list(x)])) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

    dealt = units.select("unit", "sid", "n", "sig", "label", "own").repartition("unit").sortWithinPartitions("unit", "sid")
    return dealt.mapInArrow(lodged("jaccard_join", nothing, run), "a binary, b binary")


def _counted(sets: DataFrame, classes: DataFrame, words: Callable[[DataFrame], DataFrame], threshold: float, block_words: int, block: int = 1024) -> DataFrame:
    """A written table of sid, links: the rows whose sets are linked to a set; of all sets in classes (node, root).

    A class is cut into blocks of about ``block`` sets and half of ``block_words`` words at most; each pair of blocks meets
    in one place. Two sets that are a class by themselves are linked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches):
            at = held.column(1).to_numpy()
            first = int((at == at[0]).sum())
            copies = held.column(3).to_numpy()
            sets = [np.frombuffer(v.as_buffer(), dtype="<u8") for v in held.column(4)]
            if first < len(at):
                found = similar(sets, threshold, first)
                links = np.concatenate([found @ copies[first:], copies[:first] @ found])
            elif held.column(5)[0].as_py():
                found = similar(sets, threshold)
                np.fill_diagonal(found, False)
                links = found @ copies
            else:
                continue
            yield pa.RecordBatch.from_arrays([held.column(2), pa.array(links, pa.int64())], names=["sid", "links"])

    members = materialize(sets.select("sid", "n", "copies").join(classes.select(F.col("node").alias("sid"), "root"), "sid"), "members")
    sizes = materialize(members.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("copies").alias("rows"), F.sum(F.col("n").cast("long")).alias("words")), "class-sizes")
    held = members.join(sized(sizes), "root")
    pairs = held.filter("m = 2").select("sid", (F.col("rows") - F.col("copies")).alias("links"))
    parts = F.ceil(F.greatest(F.col("m") / block, F.col("words") * 2 / block_words)).cast("long")
    placed = held.filter("m > 2").withColumn("parts", parts).withColumn("at", F.pmod(F.xxhash64("sid"), "parts")).select("sid", "root", "copies", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("k"))
    own = words(held.filter("m > 2").select("sid"))
    unit = F.xxhash64("root", F.least("at", "k"), F.greatest("at", "k"))
    dealt = placed.join(own, "sid").select(unit.alias("unit"), "at", "sid", "copies", "own", (F.col("at") == F.col("k")).alias("inner"))
    found = dealt.repartition("unit").sortWithinPartitions("unit", "at", "sid").mapInArrow(lodged("jaccard_join", nothing, run), "sid binary, links long")
    out = materialize(found.groupBy("sid").agg(F.sum("links").alias("links")).unionByName(pairs), "link-counts")
    discard(members, sizes, own)
    return out


def _sets(rows: DataFrame) -> DataFrame:
    """sid, own: the sets of candidates' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [shingles(t).astype("<u8").tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.binary())], names=["sid", "own"])

    return rows.select("sid", "text").mapInArrow(lodged("jaccard_join", nothing, run), "sid binary, own binary")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """doc_id, class_id, n_links, n_copies of every row.

    Sets are of five lower-case words between white space (all words of a shorter text). Two rows are linked if their
    sets' Jaccard similarity is at least the threshold and the runs make them meet: a pair at the threshold does with
    probability ``recall`` or more, a closer one with more. A class is what links connect, named by its smallest doc_id.
    n_copies counts the rows with an equal set, itself included; n_links the other rows that a row was verified to be
    linked to: its copies, and all rows of its class whose sets are similar enough, however many they are.

    A text that is null or has no word is alone: its own id, no links, one copy. Rows with a null id take part; they only
    can't name a class that has another id. Repeated rows are copies, always linked. Very long texts count whole. Extra
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    return _classes(docs, doc_id, text, **params).select("doc_id", "class_id", "n_links", "n_copies")


def _links(sets: DataFrame, words: Callable[[DataFrame], DataFrame], threshold: float, recall: float, bucket: int, least: float, crowded: int, block_words: int) -> tuple[DataFrame, DataFrame]:
    """Written tables of the verified links (a, b) and of the components (node, root) of sets (sid, n, sig); ``words``
    gives sid, own of the sets with the sids asked for."""

    def checked(met: DataFrame) -> DataFrame:
        pairs = materialize(met.filter("other is not null").select(F.col("sid").alias("a"), F.col("other").alias("b")).distinct(), "pairs")
        own = words(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct())
        out = materialize(_checked(pairs, own, threshold), "links")
        discard(pairs, own)
        return out

    def connected(*links: DataFrame) -> tuple[DataFrame, DataFrame]:
        edges = materialize(functools.reduce(DataFrame.unionByName, links).distinct(), "links")
        discard(*links)
        labels = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
        return edges, labels

    own = materialize(_labelled(sets, None), "labelled")
    first = _runs(own, threshold, recall, bucket, least, crowded, True)
    discard(own)
    edges, labels = connected(checked(first))
    own = materialize(_labelled(sets, labels), "labelled")
    others = _runs(own, threshold, recall, bucket, least, crowded, False)
    discard(own, labels)
    edges, labels = connected(edges, checked(others))
    own = materialize(_labelled(sets, labels), "labelled")
    units = _units(first.unionByName(others).filter("cell is not null").select("cell", "sid"), own)
    held = words(units.select("sid").distinct())
    rest = materialize(_compare(units.join(held, "sid"), threshold, least, block_words), "links")
    discard(first, others, own, units, held)
    if rest.isEmpty():
        discard(rest)
        return edges, labels
    discard(labels)
    return connected(edges, rest)


def _classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, recall: float = 0.99, bucket: int = 2048, slack: float = 0.16, crowded: int = 32_768, block_words: int = 2_000_000, counted: bool = True) -> DataFrame:
    """The columns of :func:`near_duplicates`, the text's digest, and first: (id, digest) of the row that names the class;
    null without a word. ``bucket`` is the number of sets compared by brute force, ``crowded`` that of a bucket in one task.
    Unless ``counted``, links are not counted, and n_links is null."""
    ship(docs.sparkSession)
    signed = materialize(_signed(docs, doc_id, text), "signed")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")
    grouped = signed.filter(F.col("sid").isNotNull()).groupBy("sid").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.max("sig").alias("sig"))
    sets = materialize(grouped, "sets")
    ids = materialize(signed.select("doc_id", "digest", "sid"), "ids")
    discard(signed)

    def words(asked: DataFrame) -> DataFrame:
        wanted = materialize(asked.join(sets, "sid").select("sid", F.col("first.doc_id").alias("d"), F.col("first.digest").alias("digest")), "wanted")
        texts = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).withColumn("digest", text_digest(F.col("text")))
        key = (texts["digest"] == wanted["digest"]) & texts["doc_id"].eqNullSafe(wanted["d"])
        out = materialize(_sets(texts.join(sized(wanted), key).select("sid", "text")).dropDuplicates(["sid"]), "candidate-sets")
        discard(wanted)
        return out

    edges, classes = _links(sets.select("sid", "n", "sig"), words, threshold, recall, bucket, threshold - slack, crowded, block_words)
    roots = classes.select(F.col("node").alias("sid"), "root")
    placed = sets.select("sid", "first", "copies").join(roots, "sid", "left")
    if counted:
        links = _counted(sets, classes, words, threshold, block_words)
        placed = materialize(placed.join(links, "sid", "left"), "placed")
        discard(links)
    else:
        placed = materialize(placed.withColumn("links", F.lit(None).cast("long")), "placed")
    discard(edges, classes, sets)
    # Sets without a link have no root and stay out of the join, where they would all be one key.
    linked, alone = placed.filter(F.col("root").isNotNull()), placed.filter(F.col("root").isNull())
    names = materialize(linked.groupBy("root").agg(F.min("first").alias("name")), "names")
    named = linked.join(sized(names), "root").select("sid", "copies", "links", "name").unionByName(alone.select("sid", "copies", F.lit(0).cast("long").alias("links"), F.col("first").alias("name")))
    worded = ids.filter(F.col("sid").isNotNull()).join(named, "sid", "left")
    empty = ids.filter(F.col("sid").isNull())
    out = materialize(worded.unionByName(empty, allowMissingColumns=True), "classes")
    discard(ids, placed, names)
    name = F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("name.doc_id"))
    n_links = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    return out.select("doc_id", name.alias("class_id"), (n_links if counted else F.lit(None).cast("long")).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"), "digest", F.col("name").alias("first"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """One row of each class, with the columns of the input: the one with the least id, of equal ids the least digest of
    a text; null ids come last. Rows are told by id and text together, so an id that stands on two texts loses only the
    copy. Texts without a word are alone and stay."""
    found = _classes(docs, doc_id, text, counted=False, **params).filter(F.col("first").isNotNull())
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    judged = materialize(found.select("doc_id", "digest", stays.alias("stays")).groupBy("doc_id", "digest").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")), "near")
    gone = materialize(judged.filter("not stays").select(F.col("doc_id").alias("__near_id"), F.col("digest").alias("__near_digest")), "near-gone")
    repeated = materialize(judged.filter("stays and n > 1").select(F.col("doc_id").alias("__near_id"), F.col("digest").alias("__near_digest")), "near-repeated")
    discard(judged)
    digest = text_digest(docs[text])
    same = docs[doc_id].cast("long").eqNullSafe(F.col("__near_id")) & (digest == F.col("__near_digest"))
    kept = docs.join(sized(gone), same, "left_anti")
    if repeated.isEmpty():
        return kept
    again = sized(repeated)
    same = kept[doc_id].cast("long").eqNullSafe(F.col("__near_id")) & (text_digest(kept[text]) == F.col("__near_digest"))
    once = kept.join(again, same).dropDuplicates(["__near_id", "__near_digest"]).select(*(kept[c] for c in docs.columns))
    return kept.join(again, same, "left_anti").unionByName(once)
