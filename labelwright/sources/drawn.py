"""Pictures drawn from rows of the relational tables, whose metrics are known by formula."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .labels import spread
from .pictures import PIXELS


def drawn(rows: DataFrame, draw: Callable[..., np.ndarray], *columns: str, most: int = 4096) -> DataFrame:
    """Adds width, height and pixels of ``draw`` of the columns' values; the rows are dealt out over all cores before, about
    ``most`` to a partition, as Python holds up to 10,000 rows of one at a time, here and wherever the pictures go next."""
    rows = spread(rows, most)
    names = rows.columns
    at = [names.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 64) for whole in batches for i in range(0, max(1, whole.num_rows), 64)):
            found = [draw(*v) for v in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]
            new = [pa.array([g.shape[1] for g in found], pa.int32()), pa.array([g.shape[0] for g in found], pa.int32()), pa.array([g.tobytes() for g in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, "width", "height", "pixels"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {PIXELS}")


def stripes(width: int, height: int, a: int, b: int) -> np.ndarray:
    """Upright stripes of one pixel, a and b in turn."""
    return np.tile(np.where(np.arange(width) % 2, b, a).astype(np.uint8), (height, 1))


def block(width: int, height: int, x: int, y: int, w: int, h: int) -> np.ndarray:
    """A dark block on white."""
    g = np.full((height, width), 255, dtype=np.uint8)
    g[y : y + h, x : x + w] = 20
    return g


def texture(seed: int | None, side: int = 96) -> np.ndarray:
    """A random pattern of blocks, blank without a seed."""
    if seed is None:
        return np.full((side, side), 200, dtype=np.uint8)
    return np.kron(np.random.default_rng(seed).integers(0, 256, (side // 6, side // 6)), np.ones((6, 6))).astype(np.uint8)
