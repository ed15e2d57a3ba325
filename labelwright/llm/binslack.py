"""Best-fit packing by minimum bin slack: a subset-sum search finds each sequence's fullest combination of lengths.

Only lengths matter to packing, and there are no more of them than a sequence has tokens. So the corpus is counted by
length, the plan is made over those counts, and each piece finds its place from its length and its rank among pieces of
that length. What is planned in one place is bounded by the capacity; what grows with the corpus stays distributed.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, lodged, materialize, ship, sized

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class ByteEncoder:
    """Ids of texts by a byte-level vocabulary, as the tokenizers library gives them.

    The vocabulary numbers its tokens in the order of their merges, as tiktoken's loop expects; that loop is several times
    as fast. Texts that it gives up on, with a million blanks in a row, go through the tokenizers library itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}
        special = {t["content"]: t["id"] for t in held["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in held["model"]["vocab"].items() if t not in special}
        self.path, self.special = path, set(special)
        self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special=self.special)
        except ValueError:
            from tokenizers import Tokenizer

            return np.array(Tokenizer.from_file(self.path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)


_encoders: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    """One per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


def forget() -> None:
    """Drops a worker's tokenizers."""
    _encoders.clear()


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, but the first where they don't come out even."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece of each row's ids and end id; a null text is the end id alone."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).ids
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(t) if t else np.empty(0, np.uint32), end_id).astype("<u4")
                for k, (at, n) in enumerate(cuts(len(ids), capacity)):
                    for column, x in zip(out, (key, k, at, n, zlib.crc32(ids[at : at + n])), strict=True):
                        column.append(x)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(lodged("binslack", forget, run), PIECE)


def fullest(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """length: times of the fullest sequence that holds the longest length left; counts: pieces left of each length.

    The sums that can be reached are the bits of one integer. Lengths come longest first, each as often as it is there, in
    powers of two; the search ends when the sequence is full. Of equally full ones that with longer pieces is found.
    """
    there = np.flatnonzero(counts)[::-1].tolist()
    first = there[0]
    room = capacity - first
    mask, reach = (1 << room + 1) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in there:
        left = min(int(counts[length]) - (length == first), room // length)
        times = 1
        while left > 0 and not reach >> room:
            took = min(times, left)
            new = (reach | reach << length * took) & mask
            if new != reach:
                steps.append((length, took, reach))
                reach = new
            left -= took
            times *= 2
        if reach >> room:
            break
    total, found = reach.bit_length() - 1, {first: 1}
    for length, took, before in reversed(steps):
        if not before >> total & 1:
            total -= length * took
            found[length] = found.get(length, 0) + took
    return found


def plan(counts: np.ndarray, capacity: int) -> np.ndarray:
    """(length, rank, times, sequence, offset) rows, sorted: from that rank on, pieces of a length stand ``times`` together
    in sequences counted from that one, from that offset on.

    A combination is taken as long as all of its lengths are there, which its searches one by one would find as full.
    Every one of them uses a length up, or leaves fewer than a sequence holds; so their number is bounded by the capacity.
    """
    left, used = counts.astype(np.int64), np.zeros(len(counts), dtype=np.int64)
    rows, sequence = [], 0
    while left.any():
        found = fullest(left, capacity)
        often = min(int(left[x]) // n for x, n in found.items())
        offset = 0
        for length, times in found.items():
            rows.append((length, used[length], times, sequence, offset))
            offset += length * times
            used[length] += often * times
            left[length] -= often * times
        sequence += often
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def place(rows: DataFrame, planned: np.ndarray) -> DataFrame:
    """Adds sequence_id and offset to rows with a length and a rank, by the plan."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("rank").schema)
    keys = planned[:, 0] << 44 | planned[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            _, since, times, sequence, offset = planned[np.searchsorted(keys, length << 44 | rank, side="right") - 1].T
            out = batch.drop_columns(["rank"])
            out = out.append_column("sequence_id", pa.array(sequence + (rank - since) // times, pa.int64()))
            yield out.append_column("offset", pa.array(offset + (rank - since) % times * length, pa.int64()))

    return rows.mapInArrow(lodged("binslack", forget, run), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, bucket_rows: int = 1 << 12, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Sequences of at most ``capacity`` ids, as few as the method finds: a row per piece, its sequence and its offset there.

    Pieces of one length are numbered in buckets of about ``bucket_rows``, drawn by hash, so that one length may hold any
    share of the rows; the buckets' counts add up to ranks. Null and empty texts are the end id alone; very long texts are
    cut, the first piece being the shorter one; null ids stay null; of equally long pieces of a bucket the one with the
    smaller id, then piece, comes first; repeated rows are packed each and, being equal, may stand for each other; extra
    columns are ignored, whatever their names; an empty table gives no rows. The result follows from the rows alone.
    """
    made = materialize(pieces(docs, vocabulary, capacity, doc_id=doc_id, text=text), "slack-pieces")
    key = ["doc_id", "piece", "start", "ids_crc32"]
    counts = np.zeros(capacity + 1, dtype=np.int64)
    # No more rows than the capacity has lengths.
    for r in made.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    buckets = F.array(*(F.lit(int(x)) for x in np.maximum(1, -(-counts // bucket_rows)))).cast("array<long>")
    drawn = made.withColumn("bucket", F.pmod(F.xxhash64(*key), F.get(buckets, F.col("length").cast("int"))))
    held = materialize(drawn.groupBy("length", "bucket").count(), "slack-counts")
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    since = materialize(held.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("since")), "slack-ranks")
    discard(held)
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*(F.col(k).asc_nulls_last() for k in key)))
    ranked = drawn.withColumn("own", own).join(sized(since), ["length", "bucket"])
    return place(ranked.select(*key[:3], "length", "ids_crc32", (F.col("since") + F.col("own") - 1).alias("rank")), plan(counts, capacity))
