"""Prefix trie of conversations from vertical bitmaps.

Turns are named by the MD5 of role and text, so every step after the first works on rows of fixed size. Conversations
are cut into blocks of BLOCK turns; at most SHARD blocks form a shard. A shard holds, for each (position, turn), the
bitset of its rows that have this turn there; going depth first, the bitset of a node and the postings of the next
position give its children, whose popcounts, smallest members and lists of ended conversations are summed over shards
by node. A node is named by a digest chained along its path, so shards need not hold all of a node's members, and a
very common first turn or a very long conversation is dealt over many of them.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

BLOCK = 256
SHARD = 4096
HEAD = 9  # a conversation takes fewer than so many turns from the first of its five
ROOT = hashlib.md5(b"root").digest()


def turns(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) to (conv_id, turn, digest, bytes); null role or text is empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    return rows.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", named.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def _rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """turns() to the rebuilt (conv_id, pos, digest, bytes), with the conversations and the table to discard. The place
    of a turn comes from one range sort of all turns and the number of a conversation's turns in earlier partitions, so
    no task holds a whole conversation."""
    order = ["conv_id", "turn", "digest"]
    ranged = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id()), "turns")
    ranged = ranged.withColumn("part", F.shiftright("m", 33))
    runs = ranged.groupBy("conv_id", "part").agg(F.min("m").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    convs = runs.groupBy("conv_id").agg(F.sum("n").alias("own")).select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).alias("h"))
    convs = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "h", "k"), "convs")
    runs = runs.select("conv_id", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift")).join(convs.select("conv_id", "h", "k"), "conv_id")
    placed = ranged.join(runs, ["conv_id", "part"]).withColumn("pos", F.col("m") + F.col("shift"))
    own = placed.where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "digest", "bytes")
    heads = placed.where(F.col("pos") < HEAD - 1).select(F.col("conv_id").alias("base"), "pos", "digest", "bytes")
    lent = heads.join(convs.select("conv_id", "base", F.col("h").alias("upto")), "base").where("pos < upto").select("conv_id", "pos", "digest", "bytes")
    return own.unionByName(lent), convs, ranged


def _blocks(rebuilt: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """One row per conversation and block of turns, with the name of the prefix before it, the turns and bytes before
    it, and the conversation's length; a conversation without turns has one empty block."""
    none = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("bytes"))
    cell = F.when(F.col("digest").isNotNull(), F.struct("pos", "digest", "bytes"))
    b = rebuilt.unionByName(none).groupBy("conv_id", F.floor(F.col("pos") / block).cast("long").alias("b")).agg(F.sort_array(F.collect_list(cell)).alias("c"))
    b = written(b.select("conv_id", "b", F.col("c.digest").alias("digests"), F.col("c.bytes").alias("bytes")), "blocks")
    # Only full blocks have a block after them; their digests are chained to name the prefix before each.
    full = b.where(F.size("digests") == block).select("conv_id", "b", F.unhex(F.md5(F.array_join(F.transform("digests", F.hex), "").cast("binary"))).alias("d"))
    chain = full.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("b", "d"))).alias("l"))
    steps = F.aggregate("l", F.array(F.lit(ROOT)), lambda a, x: F.array_append(a, F.unhex(F.md5(F.concat(F.element_at(a, -1), x["d"])))))
    starts = chain.select("conv_id", F.posexplode(steps).alias("b", "start")).where("b > 0").select("conv_id", F.col("b").cast("long").alias("b"), "start")
    w = Window.partitionBy("conv_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    total = F.aggregate("bytes", F.lit(0).cast("long"), lambda a, x: a + x)
    out = b.join(starts, ["conv_id", "b"], "left").withColumn("start", F.coalesce("start", F.lit(ROOT)))
    out = out.withColumn("bytes_before", F.coalesce(F.sum(total).over(w), F.lit(0)))
    return out.withColumn("turns_in_all", F.sum(F.size("digests")).over(Window.partitionBy("conv_id")))


def walk(rows: list[tuple[int, int, bytes, list[bytes]]], lengths: list[int], block: int) -> Iterator[tuple[bytes, bytes | None, int, int, int, int]]:
    """rows (conv_id, b, start, digests) of a shard and their conversations' lengths to its nodes: name, parent's name,
    depth, turns within the block, bitset of members, bitset of those that end there."""
    postings: dict[tuple[int, bytes], int] = defaultdict(int)
    longer = [0] * (block + 1)
    ended: dict[int, int] = defaultdict(int)
    roots: dict[tuple[int, bytes], int] = defaultdict(int)
    for i, (_, b, start, digests) in enumerate(rows):
        bit = 1 << i
        roots[b, start] |= bit
        for p, d in enumerate(digests):
            postings[p, d] |= bit
            longer[p] |= bit
        if lengths[i] == b * block + len(digests):
            ended[len(digests)] |= bit
    for (b, start), bits in roots.items():
        stack = [(start, None, 0, bits)]
        while stack:
            name, parent, p, bits = stack.pop()
            if p or not b:
                yield name, parent, b * block + p, p, bits, bits & ended.get(p, 0)
            more = bits & longer[p]
            while more:
                first = rows[(more & -more).bit_length() - 1][3]
                child = more & postings[p, first[p]]
                more ^= child
                if p + 1 < block:
                    made = hashlib.blake2b(name + first[p], digest_size=16).digest()
                else:
                    made = hashlib.md5(start + hashlib.md5(b"".join(first).hex().upper().encode()).digest()).digest()
                stack.append((made, name, p + 1, child))


def _members(bits: int) -> np.ndarray:
    raw = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def _shards(batches: Iterator[pa.RecordBatch], shard: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, shard):
            yield batch.slice(a, shard)


def _local(shard: int, block: int):
    """Nodes of each shard, whose rows come in order of block and conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["name", "parent", "depth", "conv_id", "n_convs", "n_ends", "first_end", "ends"]
        types = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for part in _shards(batches, shard):
            cols = part.select(["conv_id", "b", "start", "digests", "turns_in_all"]).to_pydict()
            ids = cols["conv_id"]
            rows = list(zip(ids, cols["b"], cols["start"], cols["digests"], strict=True))
            out: list[tuple] = []
            for name, parent, depth, _, bits, ends in walk(rows, cols["turns_in_all"], block):
                members = [ids[i] for i in _members(ends)] if ends else []
                out.append((name, parent, depth, ids[(bits & -bits).bit_length() - 1], bits.bit_count(), len(members), members[0] if members else None, ",".join(map(str, members)) if members else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def _sums(shard: int, block: int):
    """What members add to each node: owned leaves, owned children, saved bytes (see trie())."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["name", "leaves", "children", "saved"], [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        for part in _shards(batches, shard):
            cols = part.to_pydict()
            rows = list(zip(cols["conv_id"], cols["b"], cols["start"], cols["digests"], strict=True))
            leaf, owns = np.array(cols["leaf"], np.int64), np.array(cols["owns_from"], np.int64)
            length, till = np.array(cols["turns_in_all"], np.int64), np.array(cols["bytes_till"], np.int64)
            # Bytes before turn p of each row's block, all rows one after the other.
            at = np.cumsum([0] + [len(x) + 1 for x in cols["bytes"]])
            before = np.concatenate([np.cumsum([x, *y]) for x, y in zip(cols["bytes_before"], cols["bytes"], strict=True)])
            out: list[tuple] = []
            for name, _, depth, p, bits, _ in walk(rows, cols["turns_in_all"], block):
                m = _members(bits)
                saved = till[m] - (before[at[m] + p - 1] if p else 0)
                out.append((name, int(leaf[m].sum()), int(((owns[m] <= depth + 1) & (depth < length[m])).sum()), int(np.maximum(saved, 0).sum())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of one node come in ascending order; their hash is carried on, the whole list is never held."""
    name, sha, out = None, None, []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.string())], ["name", "ends_sha256"])

    for batch in batches:
        for n, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if n != name:
                if sha is not None:
                    out.append((name, sha.hexdigest()))
                name, sha = n, hashlib.sha256(ends.encode())
            else:
                sha.update(f",{ends}".encode())
        if len(out) > 10_000:
            yield made()
            out = []
    if sha is not None:
        out.append((name, sha.hexdigest()))
    if out:
        yield made()


def trie(rows: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, as the digest columns of the query.

    A conversation owns the nodes whose smallest member it is: those from some depth on, along its own turns. So a
    node's leaves are its members that own a childless node, its children are its members that own a node one deeper,
    and each member saves the bytes of its turns from the node's own down to the last that it does not own. All three
    are sums over members, made per shard from the bitsets and added up by node.

    Rows without conv_id are no conversation. Equal turn numbers are ordered by the digest of role and text; repeated
    rows are turns of their own; null turns come first. An empty table has no node, not even a root. Other columns are
    ignored. One task hashes the ended conversations of a node, as a stream."""
    rebuilt, convs, ranged = _rebuilt(turns(rows))
    spark = rows.sparkSession
    made = _blocks(rebuilt, convs, block)
    blocks = written(made, "blocks")
    for t in (ranged, convs):
        discard(t)
    deal = max(spark.sparkContext.defaultParallelism, -(-blocks.count() // (4 * shard)))
    ordered = blocks.repartitionByRange(deal, "b", "conv_id").sortWithinPartitions("b", "conv_id")
    local = written(ordered.mapInArrow(_local(shard, block), "name binary, parent binary, depth long, conv_id long, n_convs long, n_ends long, first_end long, ends string"), "nodes")
    nodes = local.groupBy("name").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_ends").alias("n_ends"))
    nodes = written(nodes, "nodes")
    owners = nodes.groupBy("conv_id").agg(F.min("depth").alias("owns_from"), F.max_by(F.col("n_convs") == F.col("n_ends"), "depth").alias("leaf"))
    known = blocks.join(owners, "conv_id", "left").withColumn("owns_from", F.coalesce("owns_from", F.col("turns_in_all") + 1)).withColumn("leaf", F.coalesce("leaf", F.lit(False)).cast("long"))
    here = F.least(F.greatest(F.col("owns_from") - 1 - F.col("b") * block, F.lit(0)), F.lit(block)).cast("int")
    part = F.aggregate(F.slice("bytes", F.lit(1), here), F.lit(0).cast("long"), lambda a, x: a + x)
    known = known.withColumn("bytes_till", F.sum(part).over(Window.partitionBy("conv_id")))
    sums = known.mapInArrow(_sums(shard, block), "name binary, leaves long, children long, saved long").groupBy("name")
    sums = sums.agg(F.sum("leaves").alias("n_leaves"), F.sum("children").alias("n_children"), F.sum("saved").alias("saved_tokens"))
    ends = local.where("n_ends > 0").select("name", "ends", "first_end").repartition("name").sortWithinPartitions("name", "first_end")
    ends = ends.select("name", "ends").mapInArrow(_hashed_ends, "name binary, ends_sha256 string")
    # The root is the parent of very many nodes and is joined as one row; other parents by name.
    first = nodes.where("depth = 0").select(F.lit(1).cast("long").alias("depth"), F.col("conv_id").alias("_root"))
    up = nodes.join(nodes.where("depth > 0").select(F.col("name").alias("parent"), F.col("conv_id").alias("_up")), "parent", "left").join(F.broadcast(first), "depth", "left")
    got = up.join(sums, "name").join(ends, "name", "left")
    return got.select(
        "conv_id", "depth", F.coalesce("_up", "_root").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
