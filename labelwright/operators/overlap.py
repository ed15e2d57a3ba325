"""How much neighbouring pictures of a package overlap, by binary descriptors of corners.

A picture gives at most 1,000 descriptors of 32 bytes, so it is one narrow row; each row meets its neighbour's by a window,
and the pair is matched where it lies. Descriptors match if each is the other's nearest, within a Hamming distance of 55
of 256: at that radius an index by parts of the bits would let nearly all pairs through, so a pair of pictures is compared
in full, a million distances at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Half a side of the patch that a descriptor looks at, and pairs of places in it that it compares.
REACH = 13
_rng = np.random.default_rng(31)
_PAIRS = np.clip(np.rint(_rng.normal(0, REACH / 2.5, (256, 4))), -REACH, REACH).astype(int)

#: The distance of a good match, the least number of descriptors, what a share of good matches is worth.
GOOD, LEAST, WORTH = 55, 10, 3.5


def _box(x: np.ndarray, r: int) -> np.ndarray:
    p = np.pad(x, r, mode="edge").cumsum(0).cumsum(1)
    p = np.pad(p, ((1, 0), (1, 0)))
    n = 2 * r + 1
    return p[n:, n:] - p[:-n, n:] - p[n:, :-n] + p[:-n, :-n]


def corners(g: np.ndarray, most: int = 1000) -> np.ndarray:
    """(y, x) of the strongest corners (Harris), each the largest around it; of equals the first in reading order."""
    h, w = g.shape
    if min(h, w) <= 2 * REACH + 2:
        return np.empty((0, 2), dtype=int)
    dy, dx = np.gradient(g.astype(np.float64))
    a, b, c = _box(dx * dx, 2), _box(dy * dy, 2), _box(dx * dy, 2)
    r = np.round(a * b - c * c - 0.05 * (a + b) ** 2, 3)
    p = np.pad(r, 1, constant_values=-np.inf)
    near = [p[1 + i : 1 + i + h, 1 + j : 1 + j + w] for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    peak = (r > 1) & np.logical_and.reduce([r > x for x in near[:4]]) & np.logical_and.reduce([r >= x for x in near[4:]])
    peak[:REACH], peak[-REACH:], peak[:, :REACH], peak[:, -REACH:] = False, False, False, False
    at = np.argwhere(peak)
    return at[np.argsort(-r[at[:, 0], at[:, 1]], kind="stable")[:most]]


def descriptors(g: np.ndarray, most: int = 1000) -> np.ndarray:
    """A row of 32 bytes for each corner: of 256 pairs of smoothed places around it, which is darker."""
    at = corners(g, most)
    smooth = _box(g.astype(np.int64), 2)
    y, x = at[:, :1], at[:, 1:]
    return np.packbits(smooth[y + _PAIRS[:, 0], x + _PAIRS[:, 1]] < smooth[y + _PAIRS[:, 2], x + _PAIRS[:, 3]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p, q = (np.ascontiguousarray(x).view(np.uint64) for x in (a, b))
    return sum(np.bitwise_count(p[:, k, None] ^ q[None, :, k]).astype(np.int16) for k in range(4))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the share of descriptors with a good mutual match, times 3.5; 0 with fewer than ten on a side."""
    if min(len(a), len(b)) < LEAST:
        return 0.0
    d = distances(a, b)
    to, back = d.argmin(1), d.argmin(0)
    i = np.arange(len(a))
    good = (back[to] == i) & (d[i, to] < GOOD)
    return min(1.0, float(good.sum() / max(len(a), len(b)) * WORTH))


def features(pictures: DataFrame, group: str, order: str, most: int = 1000) -> DataFrame:
    """group, order, descriptors; pictures: group, order, width, height, pixels (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, h, data in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                out.append(descriptors(np.frombuffer(data, dtype=np.uint8).reshape(h, w), most).tobytes() if data and w * h == len(data) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=[group, order, "descriptors"])

    held = pictures.select(group, order, "width", "height", "pixels")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.select(group, order).schema)
    return held.mapInArrow(run, f"{schema}, descriptors binary")


def overlaps(pictures: DataFrame, group: str, order: str, most: int = 1000) -> DataFrame:
    """group, order, overlap: of each picture but the last of its group with the next one."""
    return _met(pictures, group, order, most).filter(F.col("overlap").isNotNull())


def _met(pictures: DataFrame, group: str, order: str, most: int = 1000) -> DataFrame:
    """group, order, overlap of every picture; null for the last of its group. Few large groups leave most cores without
    work, so the pairs are dealt out anew before they are compared."""
    w = Window.partitionBy(group).orderBy(order)
    pairs = features(pictures, group, order, most).withColumn("next", F.lead("descriptors").over(w))
    session = pairs.sparkSession
    n = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    pairs = pairs.repartition(n, group, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if p[1] is None else overlap(*(np.frombuffer(x, dtype=np.uint8).reshape(-1, 32) for x in p)) for p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=[group, order, "overlap"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(group, order).schema)
    return pairs.mapInArrow(run, f"{schema}, overlap double")


def panoramas(pictures: DataFrame, group: str, order: str) -> DataFrame:
    """group, n_images, overlap_confidence: the mean overlap of neighbours, 0 for a single picture."""
    per = _met(pictures, group, order).groupBy(group).agg(F.count(F.lit(1)).alias("n_images"), F.avg("overlap").alias("overlap_confidence"))
    return per.withColumn("overlap_confidence", F.coalesce("overlap_confidence", F.lit(0.0)))
