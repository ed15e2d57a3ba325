"""Sharpness, gradient, noise, blockiness, edges and skew of grey pictures, in NumPy over Arrow batches.

A picture is a row of width, height and one byte per pixel, row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from labelwright.functions.pixels import edge_density, skew, stable_regions


def _padded(g: np.ndarray) -> np.ndarray:
    return np.pad(g, 1, mode="reflect" if min(g.shape) > 1 else "edge")


def laplacian_variance(g: np.ndarray) -> float:
    p = _padded(g.astype(np.float64))
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def tenengrad(g: np.ndarray) -> float:
    p = _padded(g.astype(np.float64))
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return float(np.hypot(gx, gy).mean())


def noise(g: np.ndarray) -> float:
    """The spread of what a 3 by 3 median takes away."""
    p = np.pad(g, 1, mode="edge")
    h, w = g.shape
    median = np.median(np.stack([p[i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0)
    return float(np.abs(g.astype(np.float64) - median).std())


def blockiness(g: np.ndarray) -> float:
    """The mean step across the edges of 8 by 8 blocks; 0 for small pictures."""
    if min(g.shape) < 16:
        return 0.0

    def steps(x: np.ndarray) -> float:
        before, after = x[7:-1:8].astype(np.float32), x[8::8].astype(np.float32)
        n = min(len(before), len(after))
        return float(np.abs(before[:n] - after[:n]).mean())

    return round((steps(g) + steps(g.T)) / 2, 2)


SCHEMA = "image_id long, width int, height int, sharpness double, tenengrad double, brightness double, contrast double, glare_fraction double, noise double, blockiness double, edge_density double, skew double"


def image_metrics(images: DataFrame) -> DataFrame:
    """A row of metrics per picture (image_id, width, height, pixels); null metrics where the bytes don't fit the size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 9]
        for batch in (whole.slice(i, 64) for whole in batches for i in range(0, whole.num_rows, 64)):
            rows = []
            for r in batch.to_pylist():
                w, h, data = r["width"] or 0, r["height"] or 0, r["pixels"] or b""
                if w * h == 0 or len(data) != w * h:
                    rows.append((r["image_id"], r["width"], r["height"], *[None] * 9))
                    continue
                g = np.frombuffer(data, dtype=np.uint8).reshape(h, w)
                rows.append((r["image_id"], w, h, laplacian_variance(g), tenengrad(g), float(g.mean()), float(g.std()), float((g > 252).mean()), noise(g), blockiness(g), edge_density(g), skew(g)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=names)

    return images.select("image_id", "width", "height", "pixels").mapInArrow(run, SCHEMA)


FRAME_METRICS = "sharpness double, brightness double, contrast double, edge_density double, upper double, lower double, aspect double, histogram array<double>"


def frame_metrics(frames: DataFrame) -> DataFrame:
    """The columns of frames (with width, height, pixels) but the pixels, and what :func:`frames.keyframes` asks of them."""
    keep = [c for c in frames.columns if c != "pixels"]
    held = frames.select(*keep, "pixels")
    w_at, h_at, p_at = (held.columns.index(c) for c in ("width", "height", "pixels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = FRAME_METRICS.split(", ")
        types = [pa.list_(pa.float64()) if "array" in f else pa.float64() for f in fields]
        for batch in batches:
            rows = []
            for w, h, data in zip(*(batch.column(i).to_pylist() for i in (w_at, h_at, p_at)), strict=True):
                g = np.frombuffer(data, dtype=np.uint8).reshape(h, w)
                counts = np.bincount(g.ravel() >> 3, minlength=32).astype(float)
                rows.append((laplacian_variance(g), float(g.mean()), float(g.std()), edge_density(g), edge_density(g[: h // 2]), edge_density(g[h // 2 :]), w / max(1, h), counts.tolist()))
            new = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *new], names=[*keep, *(f.split()[0] for f in fields)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.drop("pixels").schema)
    return held.mapInArrow(run, f"{schema}, {FRAME_METRICS}")


def text_regions(images: DataFrame) -> DataFrame:
    """image_id and boxes, the stable regions of each picture of at least 8 by 8 pixels and at most 80 % of a side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = pa.list_(pa.struct([(c, pa.int32()) for c in ("x1", "y1", "x2", "y2")]))
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                w, h, data = r["width"] or 0, r["height"] or 0, r["pixels"] or b""
                own = stable_regions(np.frombuffer(data, dtype=np.uint8).reshape(h, w)) if w * h and len(data) == w * h else []
                found.append([dict(zip(("x1", "y1", "x2", "y2"), b, strict=True)) for b in own if 8 <= b[2] - b[0] <= 0.8 * w and 8 <= b[3] - b[1] <= 0.8 * h])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, box)], names=["image_id", "boxes"])

    return images.select("image_id", "width", "height", "pixels").mapInArrow(run, "image_id long, boxes array<struct<x1:int,y1:int,x2:int,y2:int>>")
