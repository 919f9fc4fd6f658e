"""SimHash near-duplicates: fingerprints linked by BK-trees, groups as connected components.

Fingerprints are first reduced to distinct values, so copies cost one row. Two fingerprints within three bits agree
on one of four 16-bit blocks, and on one of four 12-bit blocks of the rest: each fingerprint goes to those 16 shards
of 28 agreed bits, and a BK-tree of each shard (children keyed by Hamming distance to the parent) is searched,
following only edges within the radius. A tree lives where its shard's queries lie after the shuffle: to broadcast
trees of all fingerprints would grow with the input. Of a shard only a spanning forest leaves, never its pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .graph import components

RADIUS = 3
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_STEP = 1 << 16
_BATCH = 200_000


def majority(pieces: Iterable[np.ndarray]) -> int:
    """64 majority bits of hashes, given piece by piece; 0 of none."""
    ones, n = np.zeros(64, np.int64), 0
    for h in pieces:
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, size: int = 3) -> int:
    """64 majority bits of the shingles' hashes; 0 for a text without words. Long texts are summed piece by piece."""
    w = _WORD.findall((text or "").translate(_LOWER))
    if not w:
        return 0
    n = max(1, len(w) - size + 1)
    return majority(np.fromiter((xxhash.xxh64_intdigest(" ".join(w[i : i + size]), 42) for i in range(a, min(n, a + _STEP))), "<u8") for a in range(0, n, _STEP))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, f): f is the fingerprint's 64 bits as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(t.as_py(), size) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f)], ["id", "f"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, f long")


def grow(shard: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BK-trees of all shards at once; each item is a node. Returns the sorted keys node * 65 + distance and their
    children. Items sink level by level: of those that meet at one edge the first becomes the child."""
    _, root = np.unique(shard, return_index=True)
    at = root[np.searchsorted(shard[root], shard)] if len(shard) else root
    left = np.setdiff1d(np.arange(len(f)), root)
    keys, kids = [], []
    while len(left):
        key = at[left] * 65 + np.bitwise_count(f[left] ^ f[at[left]])
        k, first = np.unique(key, return_index=True)
        keys.append(k)
        kids.append(left[first])
        at[left] = left[first][np.searchsorted(k, key)]
        left = np.delete(left, first)
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(kids)
    o = np.argsort(k)
    return k[o], c[o]


def search(shard: np.ndarray, f: np.ndarray, keys: np.ndarray, kids: np.ndarray, block: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) within RADIUS, from blocks of queries. An edge of distance e under a node at distance d
    can hold a partner only if |e - d| <= RADIUS; children of a node are neighbours in the sorted keys."""
    _, root = np.unique(shard, return_index=True)
    for a in range(0, len(f), block):
        q = np.arange(a, min(len(f), a + block))
        node = root[np.searchsorted(shard[root], shard[q])]
        while len(q):
            d = np.bitwise_count(f[q] ^ f[node]).astype(np.int64)
            near = (d <= RADIUS) & (q != node)
            if near.any():
                yield q[near], node[near]
            lo = np.searchsorted(keys, node * 65 + np.maximum(d - RADIUS, 0))
            n = np.searchsorted(keys, node * 65 + np.minimum(d + RADIUS, 64), side="right") - lo
            q = np.repeat(q, n)
            node = kids[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(q))]


def forest(shard: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint that has links in its shard, with a representative of its component there."""
    keys, kids = grow(shard, f)
    up = np.arange(len(f))
    for a, b in search(shard, f, keys, kids):
        while True:
            ra, rb = up[a], up[b]
            if (ra == rb).all():
                break
            np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))
            while (up[up] != up).any():
                up = up[up]
    moved = up != np.arange(len(f))
    return f[moved], f[up[moved]]


def _keys():
    """The 16 shards of f: 16-bit block k, 12-bit block j of the other 48 bits, and their values."""
    out = []
    for k in range(4):
        rest = [b for b in range(64) if b // 16 != k]
        part = lambda bits: sum((1 << b) for b in bits)
        for j in range(4):
            mask = part(range(16 * k, 16 * k + 16)) | part(rest[12 * j : 12 * j + 12])
            out.append(F.xxhash64(F.lit(4 * k + j), F.col("f").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*out)


def links(distinct: DataFrame) -> DataFrame:
    """(f) distinct fingerprints to (u, v): a spanning forest of every shard's links within RADIUS bits."""
    sent = distinct.select(F.explode(_keys()).alias("shard"), "f").repartition("shard").sortWithinPartitions("shard")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(s, f):
            u, v = forest(s, f.view(np.uint64))
            e = pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)}).drop_duplicates()
            return e

        hs, hf = np.empty(0, np.int64), np.empty(0, np.int64)
        for x in frames:
            hs, hf = np.append(hs, x["shard"].to_numpy()), np.append(hf, x["f"].to_numpy())
            cut = int(np.searchsorted(hs, hs[-1])) if len(hs) else 0
            if cut >= _BATCH:
                yield done(hs[:cut], hf[:cut])
                hs, hf = hs[cut:], hf[cut:]
        if len(hs):
            yield done(hs, hf)

    return sent.mapInPandas(run, "u long, v long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, f, component): component is the smallest id reachable by links of 3 bits or fewer. Null and empty texts
    have fingerprint 0 and link like any other; a null id is its own row of the group and never its smallest."""
    fp = written(fingerprints(docs, id_col, text_col, size), "fingerprints")
    own = written(fp.groupBy("f").agg(F.min("id").alias("least")), "distinct")
    root = components(links(own.select("f")))
    rooted = own.join(root, own["f"] == root["node"], "left").select(own["f"], "least", F.coalesce("root", own["f"]).alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = written(rooted.join(best, "root").select("f", "component"), "named")
    return fp.join(named, "f").select("id", "f", "component")
