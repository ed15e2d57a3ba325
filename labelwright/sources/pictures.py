"""Pictures and videos: decoded images (S3, I1), a sink for images (S7), frames of uncompressed videos.

Bytes are read and written where the tasks run, through pyarrow's file systems, so any store that those know will do.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from labelwright.functions.pixels import MAGIC, decode_png, encode_png, png_size, shrunk

PIXELS = "width int, height int, pixels binary"


def filesystem(uri: str):
    """pyarrow's file system of a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if re.match(r"\w+:/", uri) else (fs.LocalFileSystem(), os.path.abspath(uri))


def decoded(files: DataFrame, content: str = "content", most_pixels: int = 1 << 26) -> DataFrame:
    """Adds width, height and pixels (a grey byte each) of PNG pictures; all null for what isn't one, or is too large.

    Batches are cut by bytes of pixels, which the heads tell, so a task holds few large pictures at a time. Null and empty
    contents have no picture; other columns pass through, but for those that have the names of the three results.
    """
    keep = [c for c in files.columns if c not in ("width", "height", "pixels")]
    held = files.select(*keep)
    at = keep.index(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, found = 0, 0, []
            for i, data in enumerate(batch.column(at)):
                row = _decode(data.as_py() or b"", most_pixels)
                found.append(row)
                size += len(row[2] or b"")
                if size > 16 << 20:
                    yield out(batch.slice(start, i + 1 - start), found)
                    start, size, found = i + 1, 0, []
            yield out(batch.slice(start), found)

    def out(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        new = [pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]
        return pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*keep, "width", "height", "pixels"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
    return held.mapInArrow(run, f"{schema}, {PIXELS}")


def _decode(data: bytes, most_pixels: int) -> tuple:
    try:
        if data.startswith(MAGIC):
            w, h = png_size(data)
            if w * h <= most_pixels:
                g = decode_png(data, most_pixels)
                return g.shape[1], g.shape[0], g.tobytes()
    except ValueError:
        pass
    return None, None, None


def _rows(batch: pa.RecordBatch, most: int = 64) -> Iterator[dict]:
    """The rows, of which only a few are copied at a time."""
    for i in range(0, batch.num_rows, most):
        yield from batch.slice(i, most).to_pylist()


@dataclass
class Written(WriterCommitMessage):
    """A task's folder and how many pictures it holds."""

    folder: str
    pictures: int


class PictureSink(DataSource):
    """``df.write.format("labelwright_pictures").option("path", ...)``: rows of name, width, height, pixels as PNG files.

    Each task writes into a folder of its own under a temporary name. When all have ended, the folders are renamed, one
    rename a task, and a manifest is written; what a failed task or job has written is deleted. Names must be single
    path segments; rows whose pixels don't fit their size fail the task.
    """

    @classmethod
    def name(cls) -> str:
        return "labelwright_pictures"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _PictureWriter(self.options["path"], overwrite)


class _PictureWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, top = filesystem(self.path)
        folder, n = f"_temporary/{self.job}/{uuid.uuid4().hex}", 0
        try:
            for batch in iterator:
                for r in _rows(batch.select(["name", "width", "height", "pixels"])):
                    if not re.fullmatch(r"[^/\\\0]+", r["name"] or "") or r["name"].startswith((".", "_")) or len(r["pixels"] or b"") != (r["width"] or 0) * (r["height"] or 0) or not r["pixels"]:
                        raise ValueError(f"no picture to write: {r['name']!r}")
                    if not n:
                        fs.create_dir(f"{top}/{folder}", recursive=True)
                    with fs.open_output_stream(f"{top}/{folder}/{r['name']}", compression=None) as out:
                        out.write(encode_png(np.frombuffer(r["pixels"], dtype=np.uint8).reshape(r["height"], r["width"])))
                    n += 1
        except BaseException:
            if n:
                fs.delete_dir(f"{top}/{folder}")
            raise
        return Written(folder, n)

    def commit(self, messages: list[Written | None]) -> None:
        import json

        from pyarrow.fs import FileType

        fs, top = filesystem(self.path)
        fs.create_dir(top, recursive=True)
        manifest = f"{top}/_manifest.json"
        old = []
        if fs.get_file_info(manifest).type == FileType.File:
            with fs.open_input_stream(manifest, compression=None) as f:
                old = json.loads(f.read())
        new = []
        for m in messages:
            if m and m.pictures:
                part = f"part-{m.folder.rsplit('/', 1)[1]}"
                fs.move(f"{top}/{m.folder}", f"{top}/{part}")
                new.append({"part": part, "pictures": m.pictures})
        with fs.open_output_stream(f"{manifest}.new", compression=None) as f:
            f.write(json.dumps((old if not self.overwrite else []) + new).encode())
        fs.move(f"{manifest}.new", manifest)
        if self.overwrite:
            for x in old:
                fs.delete_dir(f"{top}/{x['part']}")
        self._clear(fs, top)

    def abort(self, messages: list[Written | None]) -> None:
        fs, top = filesystem(self.path)
        self._clear(fs, top)

    def _clear(self, fs, top: str) -> None:
        from pyarrow.fs import FileType

        if fs.get_file_info(f"{top}/_temporary/{self.job}").type == FileType.Directory:
            fs.delete_dir(f"{top}/_temporary/{self.job}")


FRAMES = "video string, frame_num long, fps double, width int, height int, pixels binary"

#: Fixed value: wider frames are shrunk to this.
WIDEST = 1280

#: The samplings of colours.
SAMPLINGS = ("mono", "420", "411", "422", "444")


def y4m_head(head: bytes) -> tuple[int, int, float, int, int]:
    """Width, height, frames a second, bytes of the head with its end and bytes of a frame without its own."""
    line, end, _ = head.partition(b"\n")
    words = line.split(b" ")
    if words[0] != b"YUV4MPEG2" or not end:
        raise ValueError("no uncompressed video")
    tags = {w[:1]: w[1:].decode() for w in words[1:] if w}
    w, h = int(tags[b"W"]), int(tags[b"H"])
    up, down = (int(x) for x in tags.get(b"F", "25:1").split(":"))
    kind = next((k for k in SAMPLINGS if tags.get(b"C", "420").startswith(k)), None)
    if kind is None or "p1" in tags.get(b"C", "").replace("mpeg", "").replace("paldv", ""):
        raise ValueError("a sampling of another kind")
    half = {"420": lambda: 2 * (-(-w // 2)) * (-(-h // 2)), "411": lambda: 2 * (-(-w // 4)) * h, "422": lambda: 2 * (-(-w // 2)) * h, "444": lambda: 2 * w * h, "mono": lambda: 0}
    return w, h, (up / down if up > 0 and down > 0 else 25.0), len(line) + 1, w * h + half[kind]()


@dataclass
class FrameRange(InputPartition):
    """Sampled frames of one video: bytes from the first to beyond the last."""

    path: str
    first: int
    beyond: int
    step: int


class VideoSource(DataSource):
    """``spark.read.format("labelwright_video").option("path", ...)``: sampled frames of the uncompressed videos (Y4M) below
    a folder, in grey, about one and a half a second; wider ones are shrunk to 1,280 pixels.

    A video is cut into ranges of ``bytes`` (64 MB) of its frames; a task seeks to its range and reads the brightness of
    the frames it samples alone. Frames with parameters of their own, which would make their places unequal, are refused.
    """

    @classmethod
    def name(cls) -> str:
        return "labelwright_video"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        return _VideoReader(self.options["path"], int(self.options.get("bytes", 64 << 20)), float(self.options.get("per_second", 1.5)))


class _VideoReader(DataSourceReader):
    def __init__(self, path: str, size: int, per_second: float):
        self.path, self.size, self.per_second = path, size, per_second

    def partitions(self) -> list[FrameRange]:
        from pyarrow.fs import FileSelector, FileType

        fs, top = filesystem(self.path)
        info = fs.get_file_info(top)
        files = [info] if info.type == FileType.File else [x for x in fs.get_file_info(FileSelector(top, recursive=True)) if x.type == FileType.File and x.path.endswith(".y4m")]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            with fs.open_input_file(f.path) as data:
                _, _, fps, head, body = y4m_head(data.read(1024))
            n = (f.size - head) // (body + 6)
            step = max(1, int(fps / self.per_second))
            each = max(1, self.size // (body + 6) // step) * step
            out += [FrameRange(f.path, a, min(n, a + each), step) for a in range(0, n, each)]
        return out

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        types = (pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.binary())
        names = [x.split()[0] for x in FRAMES.split(", ")]
        video = partition.path.rsplit("/", 1)[-1].removesuffix(".y4m")
        with fs.open_input_file(partition.path) as data:
            w, h, fps, head, body = y4m_head(data.read(1024))
            rows: list[tuple] = []
            for k in range(partition.first, partition.beyond, partition.step):
                data.seek(head + k * (body + 6))
                frame = data.read(6 + w * h)
                if not frame.startswith(b"FRAME\n"):
                    raise ValueError(f"{partition.path}: frame {k} is not where it should be")
                if w > WIDEST:
                    g = shrunk(np.frombuffer(frame[6:], dtype=np.uint8).reshape(h, w), WIDEST, int(h * (WIDEST / w)))
                    rows.append((video, k, fps, g.shape[1], g.shape[0], g.tobytes()))
                else:
                    rows.append((video, k, fps, w, h, frame[6:]))
                if len(rows) * w * h > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def write_videos(frames: DataFrame, path: str, fps: tuple[int, int] = (25, 1)) -> DataFrame:
    """Writes frames (video, frame_num, width, height, pixels) as one grey Y4M file a video, of the first frame's size;
    video and frames of each. Frames are sorted by Spark and pass through one at a time; a file gets its name when whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(path)
        fs.create_dir(top, recursive=True)
        done, now, out, held, n, size = [], None, None, "", 0, None

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(f"{top}/{held}", f"{top}/{now}.y4m")
                done.append((now, n))

        for batch in batches:
            for r in batch.to_pylist():
                if r["video"] != now:
                    close()
                    now, held, n, size = r["video"], f".{uuid.uuid4().hex}", 0, (r["width"], r["height"])
                    out = fs.open_output_stream(f"{top}/{held}", compression=None)
                    out.write(b"YUV4MPEG2 W%d H%d F%d:%d Cmono\n" % (*size, *fps))
                if (r["width"], r["height"]) != size or len(r["pixels"]) != size[0] * size[1]:
                    raise ValueError(f"a frame of {now} has another size")
                out.write(b"FRAME\n" + r["pixels"])
                n += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["video", "frames"])

    held = frames.select(frames["video"].cast("string").alias("video"), "frame_num", "width", "height", "pixels")
    return held.repartition("video").sortWithinPartitions("video", "frame_num").mapInArrow(run, "video string, frames long")
