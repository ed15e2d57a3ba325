"""Packing into training sequences: first-fit decreasing on a tournament tree, in randomised groups of documents.

Tokens are made where the text is read; what is shuffled is a row of numbers per piece. A group is a random draw of
documents, so its pieces have the corpus's mix of lengths whatever the order of the input, every group is of bounded
expected size, and groups pack independently.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lodged, ship

#: Bytes of a generation of a worker's cache, about; two generations at most are held.
CACHE_BYTES = 24 << 20

NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "draw")


def windows(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes that end between chunks, so that a long one isn't split all at once."""
    at = 0
    while len(text) - at > size:
        end = next((m.end() for m in _SPACE.finditer(text, at + size)), len(text))
        yield text[at:end]
        at = end
    yield text[at:] if at else text


_SPACE = re.compile(rb"\s")


#: Stands for a word's end inside :class:`Merges`; no printable character.
END = b"\x01"


class Merges:
    """The vocabulary's merges over many words at once, in tiktoken's merge loop.

    A word's pieces are its UTF-8 bytes and an end mark, which joins the last byte first, as its token is older than any
    merge. The tokenizers library numbers tokens in order of their merges, so the older token is the one to merge. That
    this holds, and that both give the same ids, is checked on the vocabulary's own words when it is loaded.
    """

    def __init__(self, path: str, whole):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        ranks: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            body, last = token.removesuffix("</w>"), token.endswith("</w>")
            if all(c in byte for c in body):
                ranks[bytes(byte[c] for c in body) + END * last] = i
        self.encode = tiktoken.Encoding("words", pat_str=r"[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        self.final = np.zeros(max(model["vocab"].values()) + 1, dtype=bool)
        self.final[[i for t, i in model["vocab"].items() if t.endswith("</w>")]] = True
        words = [w for a, b in merges[:: max(1, len(merges) // 2000)] if (w := (a + b).removesuffix("</w>")).isascii() and w.isalpha()]
        words += [a + b for a, b in zip(words, words[1:], strict=False)]
        same = self.ids([w.encode() for w in words], [1] * len(words)) == [np.array([t.id for t in whole.model.tokenize(w)], dtype="<u4").tobytes() for w in words]
        if made != sorted(made) or not same:
            raise ValueError(f"the merges of {path} are not in the order of its tokens")

    def ids(self, words: list[bytes], counts: list[int]) -> list[bytes]:
        """Little-endian ids of each run of so many words; ASCII letters are lowered."""
        found = self.encode(END.join([*words, b""]).lower().decode(), disallowed_special=()).astype("<u4", copy=False)
        ends = np.flatnonzero(self.final[found]) + 1
        at = [0, *(4 * ends[np.cumsum(counts) - 1]).tolist()]
        data = found.tobytes()
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


class ChunkEncoder(dict):
    """Ids of each run of bytes between white space, as little-endian bytes; itself the cache of those of under 64 bytes.

    The word tokenizer drops white space, so a text's ids are its chunks' ids in order. Chunks of printable ASCII and
    Latin-1 letters are cut by the tokenizer's own word pattern, those of ASCII letters and stops without it, and all new
    ones of a text are merged at once; any other chunk goes through the whole tokenizer.

    What is met a second time is stored, as most chunks come once. The cache has two generations: when the young one is
    full it becomes the old one, and what is asked for again moves up.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.merges = Merges(path, self.whole)
        self.plain = regex.compile(r"[\x21-\x7e¡-¬®-ÿ]+").fullmatch
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.old: dict[bytes, bytes] = {}
        self.held = 0
        self.met, self.marked = bytearray(1 << 21), 0

    def learn(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks that are not in the young generation."""
        out: dict[bytes, bytes] = {}
        plain, words, counts = [], [], []
        for c in chunks:
            if (ids := self.old.get(c)) is not None:
                out[c] = ids
                continue
            if c.isalpha():
                words.append(c)
                counts.append(1)
            elif (body := c.rstrip(b".,;:!?")).isalpha():
                words += (body, c[len(body) :])
                counts.append(2)
            elif self.plain(s := c.decode("utf-8", "replace")) and "<|" not in s:
                own = self.split(s.lower())
                words += [w.encode() for w in own]
                counts.append(len(own))
            else:
                out[c] = np.array(self.whole.encode(s, add_special_tokens=False).ids, dtype="<u4").tobytes()
                continue
            plain.append(c)
        if plain:
            out.update(zip(plain, self.merges.ids(words, counts), strict=True))
        return out

    def keep(self, found: dict[bytes, bytes]) -> None:
        """Stores short chunks that were met before, as far as a table of hashes can tell."""
        if self.held > CACHE_BYTES:
            self.old = dict(self)
            self.clear()
            self.held = 0
        if self.marked > len(self.met) // 2:
            self.met, self.marked = bytearray(len(self.met)), 0
        met, mask = self.met, len(self.met) - 1
        for c, ids in found.items():
            if met[at := hash(c) & mask]:
                if len(c) < 64:
                    self[c] = ids
                    self.held += 200 + len(c) + len(ids)
            else:
                met[at] = 1
                self.marked += 1

    def ids(self, text: bytes) -> bytes:
        return self._ids(text) if len(text) <= 1 << 20 else b"".join(map(self._ids, windows(text)))

    def _ids(self, text: bytes) -> bytes:
        chunks = text.split()
        out = list(map(self.get, chunks))
        if None in out:
            at = [i for i, x in enumerate(out) if x is None]
            found = self.learn({chunks[i] for i in at})
            for i in at:
                out[i] = found[chunks[i]]
            self.keep(found)
        return b"".join(out)


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def forget() -> None:
    """Drops a worker's tokenizers and their caches."""
    _encoders.clear()


def pieces(docs: DataFrame, vocabulary: str, n_groups: int, capacity: int = 2048, end_id: int = 1, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece of at most ``capacity`` ids of each row's text and end id; with_ids adds the ids themselves.

    A null text is empty: the end id alone. The group is drawn by a hash of the id, the text and, among repeated rows,
    a running number; so it follows from the rows alone, however they are read, and repeated rows spread like any others.
    """
    ship(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).ids
        for batch in batches:
            out: list[list] = [[] for _ in range(6 + with_ids)]
            for key, data, draw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = encode(data or b"") + end
                for at in range(0, len(ids), 4 * capacity):
                    own = ids[at : at + 4 * capacity]
                    for column, x in zip(out, (key, at // 4, len(own) // 4, zlib.crc32(own), len(ids) // 4, draw, own), strict=False):
                        column.append(np.frombuffer(own, "<u4").astype("i4") if column is out[-1] and with_ids else x)
            types = [pa.int64()] * 6 + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[*NAMES, *["ids"] * with_ids])

    draw = F.xxhash64(docs[doc_id].cast("long"), F.coalesce(docs[text], F.lit("")))
    held = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("binary").alias("text"), draw.alias("draw"))
    made = held.mapInArrow(lodged("packing", forget, run), ", ".join(f"{x} long" for x in NAMES) + ", ids array<int>" * with_ids)
    # Repeated rows make equal pieces: they are counted, and told apart by their number.
    counted = made.groupBy(*made.columns).agg(F.count(F.lit(1)).alias("copies"))
    copies = counted.select(*made.columns, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return copies.withColumn("group_id", F.pmod(F.xxhash64("draw", "copy"), F.lit(n_groups).cast("long"))).drop("draw", "copy")


class Bins:
    """A tournament tree over bins: each inner node holds the largest room below it, so the first bin with room is one descent."""

    def __init__(self, n: int, capacity: int):
        self.size = 1 << max(0, n - 1).bit_length()
        self.room = [capacity] * (2 * self.size)

    def place(self, length: int) -> tuple[int, int]:
        """Takes the first bin with room; returns it and its room before."""
        room, i = self.room, 1
        while i < self.size:
            i *= 2
            if room[i] < length:
                i += 1
        before = room[i]
        room[i] -= length
        at = i - self.size
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        return at, before


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, in the order given; longest first, ties by place."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    full = [i for i in order if lengths[i] == capacity]
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for k, i in enumerate(full):
        out[i] = (k, 0)
    bins = Bins(max(1, len(order) - len(full)), capacity)
    for i in order[len(full) :]:
        b, before = bins.place(lengths[i])
        out[i] = (len(full) + b, capacity - before)
    return out


def pack(parts: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces; each group is packed by itself, longest pieces first, ties by id, start and digest."""
    order = [("length", "descending"), *((x, "ascending") for x in ("doc_id", "start", "ids_crc32", "doc_tokens"))]

    def run(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, sort_keys=order, null_placement="at_end"))
        placed = np.array(first_fit_decreasing(group.column("length").to_pylist(), capacity), dtype=np.int64).reshape(-1, 2)
        sequence = (group.column("group_id").to_numpy() << 32) + placed[:, 0]
        return group.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(placed[:, 1], pa.int64()))

    return parts.groupBy("group_id").applyInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, group_docs: int = 2048, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Sequences of at most ``capacity`` ids: a row per piece with its sequence and offset, gapless from 0.

    Groups hold about ``group_docs`` documents each. Null texts and empty texts are one end id; very long texts are cut
    into pieces; null ids stay null; of equally long pieces the one with the smaller id, then start, comes first; repeated
    rows are packed each; extra columns are ignored, whatever their names; an empty table gives no rows. The result
    follows from the rows alone, not from how they are split or ordered.
    """
    n_groups = max(1, -(-docs.count() // group_docs))
    return pack(pieces(docs, vocabulary, n_groups, capacity, with_ids=with_ids, doc_id=doc_id, text=text), capacity)


def sequences(packed: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids: the packed ids in order (pieces made with_ids), padded to the capacity unless their number is a power of two."""
    rows = packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    n = F.size("ids")
    whole = n.bitwiseAND(n - 1) == 0
    return rows.select("sequence_id", F.when(whole, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(capacity) - n))).alias("ids"))
