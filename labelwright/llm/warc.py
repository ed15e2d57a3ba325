"""A deterministic sharded WARC writer and its reader.

Records are range-partitioned and sorted by page; bounds come from a sample that a hash of the page id draws, so the
same table gives the same shards whichever tasks run where. A shard's task writes gzip members to files under temporary
names, rolls them by compressed size, and reports a manifest row for each; only rows of attempts that Spark committed
are then renamed to their final names, and the manifest is written last. A reader believes the manifest alone, so files
of lost or repeated attempts are never seen.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, ship, sized

#: The namespace of record ids, the profile of revisits, the stated date of records without one.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:labelwright:warc")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

MANIFEST = "shard int, part int, path string, records long, bytes long, sha256 string, first_page long, last_page long"


def filesystem(uri: str):
    """pyarrow's file system of a URI (file, s3, gs, hdfs) and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _b32(digest: bytes) -> str:
    return "sha256:" + base64.b32encode(digest).decode().rstrip("=")


def _bounds(pages: DataFrame, page_id: str, n_shards: int, rows: int) -> list[int]:
    """Split points between shards: quantiles of ids whose hash falls below a rate that yields about 32 for each shard."""
    if n_shards == 1:
        return []
    rate = min(1.0, 32 * n_shards / max(1, rows))
    draw = F.pmod(F.xxhash64(page_id, F.lit("bounds")), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)) + 1)
    drawn = np.sort(pages.filter(F.col(page_id).isNotNull() & draw).select(F.col(page_id).cast("long")).toArrow().column(0).to_numpy())
    return sorted({int(drawn[len(drawn) * i // n_shards]) for i in range(1, n_shards)}) if len(drawn) else []


def _payloads(pages: DataFrame, page_id: str, url: str, payload: str) -> DataFrame:
    """page_id, url, payload, digest of every row."""
    held = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].alias("url"), F.coalesce(pages[payload], F.lit("")).cast("binary").alias("payload"))
    return held.withColumn("digest", F.unhex(F.sha2("payload", 256)))


def _records(held: DataFrame, narrow: DataFrame, least: int) -> DataFrame:
    """The payloads, and first_page where an equal payload of at least ``least`` bytes has a smaller id; narrow: page_id,
    digest and size of every row, written.

    The smallest id of each repeated digest is found over narrow rows, by partial sums; payloads are not moved for it.
    """
    narrow = narrow.filter(F.col("size") >= least)
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # Written first: small ones are broadcast, and beyond that a digest with very many rows can be split in the join.
    firsts = sized(materialize(firsts, "firsts"))
    later = narrow.join(firsts, "digest").select("page_id", "digest", "first_page").distinct()
    blank = lambda c, t: F.lit(None).cast(t).alias(c)
    notes = later.select("page_id", blank("url", "string"), blank("payload", "binary"), "digest", "first_page", F.lit(0).alias("kind"))
    return held.select("page_id", "url", "payload", "digest", blank("first_page", "long"), F.lit(1).alias("kind")).unionByName(notes)


class _Roller:
    """Writes gzip members to temporary files, a new one when the next would begin beyond the limit."""

    def __init__(self, base: str, shard: int, limit: int, level: int):
        self.fs, self.base = filesystem(base)
        self.shard, self.limit, self.level, self.part, self.out = shard, limit, level, 0, None
        self.rows: list[tuple] = []

    def add(self, record: bytes, page: int | None) -> None:
        if self.out is None:
            self.path = f"_temporary/{self.shard:05d}-{self.part:05d}-{uuid.uuid4().hex}.warc.gz"
            self.fs.create_dir(f"{self.base}/_temporary", recursive=True)
            self.out, self.sha, self.n, self.size, self.first = self.fs.open_output_stream(f"{self.base}/{self.path}", compression=None), hashlib.sha256(), 0, 0, page
        z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = z.compress(record) + z.flush()
        self.out.write(member)
        self.sha.update(member)
        self.n, self.size, self.last = self.n + 1, self.size + len(member), page
        if self.size >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append((self.shard, self.part, self.path, self.n, self.size, self.sha.hexdigest(), self.first, self.last))
            self.part, self.out = self.part + 1, None


def record(page: int | None, nth: int, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, revisit: bool, size: int) -> bytes:
    """One WARC record: a response with its HTTP head and payload, or a revisit with the head alone."""
    block = HTTP % size + (b"" if revisit else payload)
    key = lambda p, n: f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{p}/{n}/{digest.hex()}')}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {key(page, nth)}", f"WARC-Date: {EPOCH}",
        f"WARC-Target-URI: {''.join((url or '').split()) or 'urn:unknown'}", f"WARC-Payload-Digest: {_b32(digest)}", f"WARC-Block-Digest: {_b32(hashlib.sha256(block).digest())}",
        "Content-Type: application/http; msgtype=response", f"X-Page-ID: {'' if page is None else page}", f"X-Payload-Length: {size}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {key(refers_to, 0)}", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def write(pages: DataFrame, base: str, roll_bytes: int = 256 << 20, shard_rows: int = 100_000, level: int = 5, revisit_from: int = 100, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes every row as a record below ``base`` and returns the manifest.

    Shards hold about ``shard_rows`` records each; small tables are cut into up to 64 of at least 256, so that cores
    have work. The number depends on the table alone.

    Of rows with equal payloads of at least ``revisit_from`` bytes the one with the smallest id is the response and the
    others revisit it; of repeated rows of one id one is. A null payload is empty. Null ids are dealt to shards by digest
    and come first there, by digest and URL; of rows with a null id and equal payloads one is the response, unless a row
    with an id is. Null URLs are unknown. Long payloads pass through one at a time; extra columns are ignored, whatever
    their names; an empty table writes no archive and an empty manifest.
    """
    spark = pages.sparkSession
    ship(spark)
    held = _payloads(pages, page_id, url, payload)
    narrow = materialize(held.select("page_id", "digest", F.octet_length("payload").alias("size")), "payload-digests")
    rows = narrow.count()
    n_shards = max(-(-rows // shard_rows), min(64, rows // 256 + 1))
    bounds = np.array(_bounds(narrow, "page_id", n_shards, rows), dtype=np.int64)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy().astype(np.int64), side="right").astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, noted, last, nth = None, {}, None, 0
        done: list[tuple] = []
        for batch in batches:
            for x in batch.to_pylist():
                if roller is None or roller.shard != x["shard"]:
                    if roller:
                        roller.close()
                        done += roller.rows
                    roller, last = _Roller(base, x["shard"], roll_bytes, level), None
                key = x["page_id"], x["digest"]
                if key != last:
                    last, nth, noted = key, 0, {}
                if x["kind"] == 0:
                    noted[key] = x["first_page"]
                    continue
                revisit = key in noted and (noted[key] != x["page_id"] or nth > 0)
                roller.add(record(x["page_id"], nth, x["url"], x["payload"], x["digest"], noted.get(key), revisit, len(x["payload"])), x["page_id"])
                nth += 1
        if roller:
            roller.close()
            done += roller.rows
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names=[f.split()[0] for f in MANIFEST.split(", ")])

    known = shard_of(F.coalesce("page_id", F.lit(0)))
    shard = F.when(F.col("page_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(n_shards)).cast("int")).otherwise(known)
    records = _records(held, narrow, revisit_from).withColumn("shard", shard)
    sorted_ = records.repartitionById(n_shards, "shard").sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    sorted_.mapInArrow(run, MANIFEST).write.parquet(f"{base}/_attempts")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(base)
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                name = f"{x['shard']:05d}-{x['part']:05d}.warc.gz"
                # A repeated attempt finds its file already under the final name.
                if fs.get_file_info(f"{top}/{x['path']}").is_file:
                    fs.move(f"{top}/{x['path']}", f"{top}/{name}")
                out.append(x | {"path": name})
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    committed = spark.read.schema(MANIFEST).parquet(f"{base}/_attempts")
    committed.mapInArrow(commit, MANIFEST).write.parquet(f"{base}/_manifest")
    fs, top = filesystem(base)
    if fs.get_file_info(f"{top}/_temporary").type.name == "Directory":
        fs.delete_dir(f"{top}/_temporary")
    return spark.read.schema(MANIFEST).parquet(f"{base}/_manifest")


def _members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The members of a gzip file, one at a time."""
    data, z, parts = b"", zlib.decompressobj(31), []
    while True:
        if not data and not (data := stream.read(chunk)):
            if parts or not z.eof and z.unconsumed_tail:
                raise EOFError("an archive ends inside a record")
            return
        parts.append(z.decompress(data))
        data = b""
        if z.eof:
            yield b"".join(parts)
            data, z, parts = z.unused_data, zlib.decompressobj(31), []


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers, by lower-case name, and its block; lengths and digests must agree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if fields.get("warc-block-digest") not in (None, _b32(hashlib.sha256(block).digest())):
        raise ValueError(f"block digest differs: {fields.get('warc-record-id')}")
    return fields, block


READ = T.StructType([T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("url", T.StringType()), ("record_type", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("refers_to", T.LongType()), ("payload", T.BinaryType()))])


def read(spark: SparkSession, base: str, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives that the manifest below ``base`` names; a task per file, a record at a time.

    Digests and lengths of responses are taken from the payload that is read and must agree with the headers; those of
    revisits are the headers', which state the full payload's.
    """
    ship(spark)
    schema = READ if with_payload else T.StructType(READ.fields[:-1])
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()][: len(schema)]

    def rows(path: str) -> Iterator[tuple]:
        fs, top = filesystem(base)
        number = lambda s: int(s) if s else None
        with fs.open_input_stream(f"{top}/{path}", compression=None) as stream:
            for raw in _members(stream):
                h, block = parse(raw)
                payload = block.partition(b"\r\n\r\n")[2]
                stated = h["warc-payload-digest"].removeprefix("sha256:")
                digest = base64.b32decode(stated + "=" * (-len(stated) % 8))
                if revisit := h["warc-type"] == "revisit":
                    size = int(h["x-payload-length"])
                else:
                    size = len(payload)
                    if hashlib.sha256(payload).digest() != digest or size != int(h["x-payload-length"]):
                        raise ValueError(f"payload digest differs: {h['warc-record-id']}")
                yield number(h["x-page-id"]), h["warc-target-uri"], h["warc-type"], size, digest.hex(), number(h.get("x-refers-to-page")) if revisit else None, None if revisit else payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += row[3]
                    if size > 8 << 20 or len(held) >= 4096:
                        yield pack_rows(held)
                        held, size = [], 0
                yield pack_rows(held)

    def pack_rows(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names=[f.name for f in schema])

    manifest = spark.read.schema(MANIFEST).parquet(f"{base}/_manifest")
    files = max(1, manifest.count())
    # Dealt one by one, so that each task has a file.
    return manifest.select("path").repartition(files).mapInArrow(run, schema)
