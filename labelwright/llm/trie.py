"""The trie of conversation prefixes: polynomial prefix fingerprints, verified turn by turn, rolled up to the parents.

A prefix's fingerprint is the sum of its turns' hashes times powers of a base, so it is a prefix sum: numpy scans compute
it over sorted turns, block by block, and the sums of earlier blocks are added after. Rows of one depth and fingerprint
are a group of candidates. A turn is told by its SHA-256, and every member of a group must have the turn of the group's
representative, the smallest conversation. Those that don't are split off, with all their longer prefixes.

As the last turns of a group are equal, so are the fingerprints one turn before; equal groups at every depth are
therefore equal prefixes. A node is owned by its smallest member, and what lies below a node is what its members own
from its depth on. So the rollup is a sum over members, with partial aggregation, however deep or wide the trie is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, lodged, materialize, nothing, ship, sized

#: Two primes and bases; the two residues side by side are a fingerprint of 62 bits.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_664_525_103)
#: Turns of a conversation that are scanned together.
BLOCK = 1 << 16


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds pos, each row's place among the rows of its key, from 0; of the columns of the order only the last stays.

    Rows are sorted over all partitions by key and order, so a key may hold any share of them; each partition numbers its
    own, and the numbers of a key that spans several go on from one to the next.
    """
    cut = rows.repartitionByRange(key, *(F.col(c).asc_nulls_first() for c in order))
    held = cut.sortWithinPartitions(F.col(key), *(F.col(c).asc_nulls_first() for c in order)).withColumn("part", F.spark_partition_id())
    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            k = batch.column(at).to_numpy()
            if not len(k):
                continue
            new = np.append(True, k[1:] != k[:-1])
            new[0] = last is None or k[0] != last
            i = np.arange(len(k))
            since = np.maximum.accumulate(np.where(new, i, 0))
            pos = i - since + np.where(since == 0, 0 if new[0] else n, 0)
            last, n = k[-1], int(pos[-1]) + 1
            yield batch.append_column("pos", pa.array(pos, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
    local = materialize(held.mapInArrow(lodged("trie", nothing, run), f"{schema}, pos long").drop(*order[:-1]), "turns")
    counts = local.groupBy(key, "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # Only keys over several partitions: a row for each of these at most.
    later = materialize(counts.select(key, "part", before.alias("since")).filter("since is not null"), "turn-starts")
    if later.isEmpty():
        discard(later)
        return local
    out = materialize(local.join(sized(later), [key, "part"], "left").withColumn("pos", F.col("pos") + F.coalesce("since", F.lit(0))).drop("since"), "turns")
    discard(local, later)
    return out


def digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; the role's length keeps it apart from the text."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def rebuilt(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Written tables of the rebuilt turns (conv_id, depth from 1, digest, size) and of all conversations (conv_id, length)."""
    role_, text_ = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in (role, text))
    rows = conversations.filter(conversations[conv_id].isNotNull()).select(conversations[conv_id].cast("long").alias("conv_id"), conversations[turn].alias("turn"), digest(role_, text_).alias("digest"), F.octet_length(text_).cast("long").alias("size"))
    turns = numbered(rows, "conv_id", ["turn", "digest"])
    base = F.col("conv_id") - F.col("conv_id") % family
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")).select("conv_id", "turns", base.alias("base"), head.alias("head"))
    # A conversation's first turns, fewer than ``heads``, are a short list in its row.
    firsts = turns.filter(F.col("pos") < heads - 1).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "size"))).alias("firsts"))
    taken = own.join(firsts.select(F.col("conv_id").alias("base"), "firsts"), "base", "left").withColumn("firsts", F.slice(F.coalesce("firsts", F.array()), F.lit(1), F.col("head").cast("int")))
    taken = materialize(taken.withColumn("taken", F.size("firsts").cast("long")), "heads")
    given = taken.select("conv_id", F.posexplode("firsts").alias("pos", "x")).select("conv_id", (F.col("pos") + 1).cast("long").alias("depth"), "x.digest", "x.size")
    # Conversations that lead their own family, or skip no turn, keep every turn where it is.
    kept = turns.join(sized(taken.select("conv_id", "head", "taken")), "conv_id").filter(F.col("pos") >= F.col("head"))
    kept = kept.select("conv_id", (F.col("pos") - F.col("head") + F.col("taken") + 1).alias("depth"), "digest", "size")
    out = materialize(given.unionByName(kept), "rebuilt")
    lengths = materialize(taken.select("conv_id", (F.col("taken") + F.greatest(F.col("turns") - F.col("head"), F.lit(0))).alias("length")), "lengths")
    discard(turns, taken)
    return out, lengths


def powers(base: int, prime: int, at: np.ndarray) -> np.ndarray:
    """base ** at modulo the prime, by repeated squaring over all of them."""
    out, square, at = np.ones(len(at), dtype=np.uint64), np.uint64(base), at.astype(np.uint64)
    while at.any():
        out = np.where(at & np.uint64(1) == 1, out * square % np.uint64(prime), out)
        square, at = square * square % np.uint64(prime), at >> np.uint64(1)
    return out


def prefix_sums(start: np.ndarray, values: np.ndarray, carried: int) -> np.ndarray:
    """Running sums that begin anew where ``start`` is true; ``carried`` goes before the first row, if it isn't a start."""
    total = np.cumsum(values, dtype=values.dtype)
    at = np.maximum.accumulate(np.where(start, np.arange(len(values)), -1))
    before = np.where(at > 0, total[np.maximum(at - 1, 0)], 0).astype(values.dtype)
    return total - before + np.where(at < 0, values.dtype.type(carried), values.dtype.type(0))


def _terms(digests: pa.Array, depth: np.ndarray, bits: int) -> list[np.ndarray]:
    """What a turn adds to the two residues of the fingerprints of its depth and beyond."""
    words = np.frombuffer(b"".join(digests.to_pylist()), dtype="<u8").reshape(-1, 4)[:, :2] >> np.uint64(64 - bits)
    return [words[:, k] % np.uint64(p) * powers(b, p, depth) % np.uint64(p) for k, (p, b) in enumerate(zip(PRIMES, BASES, strict=True))]


def _blocks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / BLOCK)).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "depth")


def fingerprinted(turns: DataFrame, bits: int = 62) -> DataFrame:
    """A written table of conv_id, depth, print, digest, size, and splits, which is empty.

    ``bits`` is the width of the turns' hashes; a small one makes collisions, for tests.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, [0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, block, depth = (batch.column(i).to_numpy() for i in range(3))
            new = np.append(True, (conv[1:] != conv[:-1]) | (block[1:] != block[:-1]))
            new[0] = last != (conv[0], block[0])
            sums = [prefix_sums(new, x, carried[k]) % np.uint64(PRIMES[k]) for k, x in enumerate(_terms(batch.column(3), depth, bits))]
            last, carried = (conv[-1], block[-1]), [int(x[-1]) for x in sums]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x.astype(np.int64)) for x in sums)], names=["conv_id", "block", "depth", "digest", "size", "sum0", "sum1"])

    scanned = _blocks(turns).select("conv_id", "block", "depth", "digest", "size")
    schema = "conv_id long, block long, depth long, digest binary, size long, sum0 long, sum1 long"
    local = materialize(scanned.mapInArrow(lodged("trie", nothing, run), schema), "scans")
    ends = local.groupBy("conv_id", "block").agg(F.max_by("sum0", "depth").alias("sum0"), F.max_by("sum1", "depth").alias("sum1"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    later = ends.select("conv_id", "block", F.sum("sum0").over(earlier).alias("past0"), F.sum("sum1").over(earlier).alias("past1")).filter("past0 is not null")
    later = materialize(later, "scan-starts")
    whole = local.join(sized(later), ["conv_id", "block"], "left") if not later.isEmpty() else local.withColumn("past0", F.lit(0)).withColumn("past1", F.lit(0))
    at = [F.pmod(F.col(f"sum{k}") + F.coalesce(F.col(f"past{k}"), F.lit(0)), F.lit(PRIMES[k])) for k in range(2)]
    both = F.shiftleft(at[0].cast("long"), 31) + at[1].cast("long")
    out = materialize(whole.select("conv_id", "depth", both.alias("print"), "digest", "size", F.lit("").alias("splits")), "prints")
    discard(local, later)
    return out


def verified(prints: DataFrame) -> DataFrame:
    """The table, or one written in its place, with splits filled in: groups of equal depth, print and splits are equal prefixes.

    Each member's turn is compared with that of its group's representative. One that differs gets a split, its depth and
    turn, which it carries from there on; the shallowest of each conversation at once, until no group has two turns.
    """
    now = prints
    key = ["depth", "print", "splits"]
    while True:
        groups = now.groupBy(*key).agg(F.min("digest").alias("a"), F.max("digest").alias("b"), F.min_by("digest", "conv_id").alias("turn"))
        mixed = materialize(groups.filter("a <> b").select(*key, "turn"), "collisions")
        if mixed.isEmpty():
            discard(mixed)
            return now
        apart = now.join(sized(mixed), key).filter(F.col("digest") != F.col("turn")).groupBy("conv_id").agg(F.min(F.struct("depth", "digest")).alias("x"))
        apart = materialize(apart.select("conv_id", F.col("x.depth").alias("since"), F.concat(F.col("x.depth").cast("string"), F.lit(":"), F.hex("x.digest")).alias("more")), "splits")
        grown = F.when(F.col("since") <= F.col("depth"), F.array_join(F.array_sort(F.split(F.ltrim(F.concat_ws(" ", "splits", "more")), " ")), " ")).otherwise(F.col("splits"))
        before, now = now, materialize(now.join(sized(apart), "conv_id", "left").withColumn("splits", grown).drop("since", "more"), "candidates")
        discard(before, mixed, apart)


def end_digests(ends: DataFrame, chunk: int = 4096) -> DataFrame:
    """conv_id, depth, ends_sha256: the hash of each node's ends (conv_id, depth, member), joined by commas in their order.

    Ends are sorted over all partitions and joined into texts of ``chunk`` of them; a node's texts then pass through one
    hash in their order, a batch at a time, as SHA-256 can't be computed in parts. No node is ever held whole.
    """
    order = ["conv_id", "depth", "member"]
    held = ends.repartitionByRange(*order).sortWithinPartitions(*order).select(*order)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, first = None, [], 0

        def out(rows: list) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["conv_id", "depth", "first", "members"])

        for batch in batches:
            rows = []
            for c, d, m in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if key != (c, d) or len(members) >= chunk:
                    if members:
                        rows.append((*key, first, ",".join(members)))
                    key, members, first = (c, d), [], m
                members.append(str(m))
            if rows:
                yield out(rows)
        yield out([(*key, first, ",".join(members))] if members else [])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None

        def out(rows: list) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["conv_id", "depth", "ends_sha256"])

        for batch in batches:
            rows = []
            for c, d, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key != (c, d):
                    if key:
                        rows.append((*key, own.hexdigest()))
                    key, own = (c, d), hashlib.sha256(text.encode())
                else:
                    own.update(b"," + text.encode())
            yield out(rows)
        yield out([(*key, own.hexdigest())] if key else [])

    texts = held.mapInArrow(lodged("trie", nothing, joined), "conv_id long, depth long, first long, members string")
    sorted_ = texts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").select("conv_id", "depth", "members")
    return sorted_.mapInArrow(lodged("trie", nothing, hashed), "conv_id long, depth long, ends_sha256 string")


def owned_below(owned: DataFrame) -> DataFrame:
    """Adds below, the sum of ``saved`` over a conversation's rows from each one's depth on (conv_id, depth, length, saved)."""
    # A suffix sum is the whole less the prefix before; blocks are scanned as for fingerprints.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, block, saved = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("conv_id", "block", "saved"))
            new = np.append(True, (conv[1:] != conv[:-1]) | (block[1:] != block[:-1]))
            new[0] = last != (conv[0], block[0])
            upto = prefix_sums(new, saved, carried)
            last, carried = (conv[-1], block[-1]), int(upto[-1])
            yield batch.append_column("upto", pa.array(upto))

    dealt = _blocks(owned)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    local = materialize(dealt.mapInArrow(lodged("trie", nothing, run), f"{schema}, upto long"), "owned-scans")
    totals = local.groupBy("conv_id", "block").agg(F.sum("saved").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    # Conversations that own nothing to save have sums of 0 and stay out.
    sums = totals.select("conv_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("past"), F.sum("n").over(whole).alias("all")).filter(F.col("all") > 0)
    sums = materialize(sums, "owned-sums")
    out = local.join(sized(sums), ["conv_id", "block"], "left").withColumn("below", F.coalesce(F.col("all") - F.col("past") - F.col("upto") + F.col("saved"), F.lit(0))).drop("block", "upto", "past", "all")
    out = materialize(out, "owned")
    discard(local, sums)
    return out


def prefix_trie(conversations: DataFrame, bits: int = 62, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first, ties by their digests. Null roles and texts are empty. Rows without a conv_id
    belong to no conversation and are left out. Repeated rows are turns each. A conversation of any length and texts of any
    length count whole; extra columns are ignored, whatever their names; an empty table gives no rows, not even a root.
    """
    ship(conversations.sparkSession)
    turns, lengths = rebuilt(conversations, conv_id, turn, role, text)
    prints = fingerprinted(turns, bits)
    discard(turns)
    rows = verified(prints)
    key = ["depth", "print", "splits"]
    # The root: every conversation at depth 0, whose fingerprint is 0.
    root = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("print"), F.lit("").alias("splits"), F.lit(0).cast("long").alias("size"), "length")
    long_ = rows.select("conv_id", "depth", "print", "splits", "size").join(sized(lengths), "conv_id")
    paths = materialize(root.unionByName(long_), "paths")
    discard(rows)
    nodes = paths.groupBy(*key).agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.max("length").alias("deepest"))
    nodes = materialize(nodes, "nodes")
    # Each row learns its node; minima stand in one row for each node, and beyond broadcast size the join has its own stage.
    placed = materialize(paths.join(sized(nodes), key).select("conv_id", "depth", "length", "node", (F.col("n_convs") - 1).alias("more"), "size", "deepest"), "placed")
    discard(paths)
    mine = F.col("conv_id") == F.col("node")
    owned = placed.select("conv_id", "depth", "length", "node", "deepest", F.when(mine, F.col("more") * F.col("size")).otherwise(0).cast("long").alias("saved"))
    owned = owned_below(owned)
    leaf = F.when((F.col("depth") == F.col("length")) & mine & (F.col("deepest") == F.col("depth")), F.col("conv_id"))
    leaves = owned.select("conv_id", "depth", leaf.alias("leaf")).filter("leaf is not null").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    rolled = owned.join(sized(materialize(leaves, "leaves")), "conv_id", "left").groupBy("node", "depth").agg(F.sum("below").alias("saved_tokens"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"))
    rolled = materialize(rolled, "rolled")
    # A node's parent holds the same conversation one turn earlier.
    steps = placed.filter(mine).select(F.col("conv_id").alias("node"), "depth")
    parents = placed.select(F.col("conv_id").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    parents = materialize(steps.join(parents, ["node", "depth"], "left"), "parents")
    children = materialize(parents.filter("parent is not null").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children")), "children")
    ends = materialize(end_digests(placed.filter("depth = length").select(F.col("node").alias("conv_id"), "depth", F.col("conv_id").alias("member"))), "ends")
    at = ["node", "depth"]
    out = nodes.select("node", "depth", "n_convs").join(rolled, at).join(parents, at).join(children, at, "left").join(ends.withColumnRenamed("conv_id", "node"), at, "left")
    out = materialize(out, "trie")
    discard(lengths, nodes, placed, owned, rolled, parents, children, ends)
    none = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
