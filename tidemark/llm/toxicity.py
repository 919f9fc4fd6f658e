"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted lists.

The classifier is fitted on at most EXAMPLES labelled rows, those with the smallest hash of their id; of these every
term counts. A term's weight is its inverse document frequency times its relevance, FLOOR plus the square of its
chi-squared against the label over CHI2, at most 1: without it the many topical words of a text drown the few that tell.
Examples lie in blocks, toxic ones first; a block's largest weight per term bounds its cosines, and only blocks whose
bound reaches the K-th best cosine are read; where most blocks do, a term's whole list is read at once. Votes weighted by squared cosine are calibrated by a logistic curve fitted
to the leave-one-out votes of all examples, which Spark computes like any other score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXAMPLES = 4096  # most labelled rows held: the bound of everything that is collected or broadcast here
FLOOR, CHI2 = 0.005, 200.0
BLOCK = 64
FIRST_BLOCKS = 4
WHOLE = 0.5  # share of the blocks from which all are read at once
K = 15
_TERM = re.compile(r"[a-zß-ɏ]+")


def _counts(text: str | None) -> Counter:
    return Counter(_TERM.findall((text or "").lower()))


class Index:
    """names, labels and terms of examples: term i of which occurs n[i] times in example d[i], d not falling."""

    def __init__(self, names: list, labels: np.ndarray, terms: list[str], d: np.ndarray, n: np.ndarray):
        order = np.argsort(-labels, kind="stable")  # toxic examples first, so that blocks hold one label
        self.names, self.labels = [names[i] for i in order], labels[order].astype(float)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        m, pos = len(labels), float(labels.sum())
        self.number = {t: i for i, t in enumerate(dict.fromkeys(terms))}
        t, d = np.fromiter(map(self.number.__getitem__, terms), np.int64, len(terms)), place[d]
        v = len(self.number)
        c, a = np.bincount(t, minlength=v).astype(float), np.bincount(t, weights=self.labels[d], minlength=v)
        gap = a * m - c * pos
        chi2 = gap * gap * m / (c * (m - c) * pos * (m - pos) + 1e-9)
        self.weight = np.log((m + 1) / (c + 0.5)) * (FLOOR + np.minimum(1, (chi2 / CHI2) ** 2))
        self.unseen = np.log((m + 1) / 0.5) * FLOOR
        x = (1 + np.log(n)) * self.weight[t]
        x /= np.sqrt(np.bincount(d, weights=x * x, minlength=m))[d]
        o = np.lexsort((d, t))
        self.example, self.x, t = d[o], x[o], t[o]
        # An entry is a run of one term's postings in one block.
        block = self.example // BLOCK
        head = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (block[1:] != block[:-1])])) if len(t) else np.empty(0, np.int64)
        self.entry_at, self.entry_block = np.append(head, len(t)), block[head]
        self.entry_most = np.maximum.reduceat(self.x, head) if len(head) else np.empty(0)
        self.term_at = np.searchsorted(t[head], np.arange(v + 1))
        self.blocks = -(-m // BLOCK)
        self.rate = (pos + 0.5) / (m + 5)
        self.a, self.b = 6.0, -3.0

    def weigh(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the known terms and their weights; unknown terms count in the length of the vector."""
        t = np.fromiter(map(self.number.get, counts, repeat(-1)), np.int64, len(counts))
        x = 1 + np.log(np.fromiter(counts.values(), float, len(counts)))
        x *= np.where(t >= 0, self.weight[np.maximum(t, 0)] if len(self.weight) else 0.0, self.unseen)
        norm = np.sqrt((x * x).sum())
        known = t >= 0
        return t[known], x[known] / norm if norm else x[known]

    def part(self, take: np.ndarray, entry: np.ndarray, block: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sums for the examples in the blocks take, from the query's entries with their blocks and weights."""
        chosen = np.zeros(self.blocks, bool)
        chosen[take] = True
        e = chosen[block]
        at, w = self.entry_at[entry[e]], weight[e]
        n = self.entry_at[entry[e] + 1] - at
        p = np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.example[p], weights=np.repeat(w, n) * self.x[p], minlength=len(self.labels))

    def whole(self, t: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Sums for all examples, from terms and their weights, added in the same order as in part()."""
        at, end = self.entry_at[self.term_at[t]], self.entry_at[self.term_at[t + 1]]
        pieces = list(map(slice, at.tolist(), end.tolist()))
        values = np.concatenate([self.x[p] for p in pieces])
        values *= np.repeat(x, end - at)
        return np.bincount(np.concatenate([self.example[p] for p in pieces]), weights=values, minlength=len(self.labels))

    def nearest(self, counts: Counter, skip=None) -> tuple[np.ndarray, np.ndarray]:
        """The K nearest examples and their cosines, ties by the smaller number; none of cosine 0, nor that named skip."""
        t, x = self.weigh(counts)
        lo, hi = self.term_at[t], self.term_at[t + 1]
        size = hi - lo
        entry = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        weight, block = np.repeat(x, size), self.entry_block[entry]
        bound = np.bincount(block, weights=weight * self.entry_most[entry], minlength=self.blocks)
        best, cosine = np.empty(0, np.int64), np.empty(0)
        left = np.argsort(-bound, kind="stable")
        left = left[bound[left] > 0]
        step = FIRST_BLOCKS
        while len(left):
            if len(best) == K and len(left) > WHOLE * self.blocks:
                # Too few blocks fall away: whole lists, which lie in one piece each, are read in less time than their parts.
                best, cosine, left = np.empty(0, np.int64), np.empty(0), left[:0]
                sums = self.whole(t, x)
            else:
                take, left = left[:step], left[step:]
                sums = self.part(take, entry, block, weight)
            new = np.flatnonzero(sums)
            if skip is not None:
                new = new[[self.names[i] != skip for i in new]]
            best, cosine = np.concatenate([best, new]), np.concatenate([cosine, sums[new]])
            o = np.lexsort((best, -np.round(cosine, 12)))[:K]
            best, cosine = best[o], cosine[o]
            if len(best) == K:
                left = left[bound[left] >= cosine[-1] - 1e-9]
            step *= 2
        return best, cosine

    def vote(self, counts: Counter, skip=None) -> tuple[float, np.ndarray]:
        best, cosine = self.nearest(counts, skip)
        w = cosine**2
        return float((w @ self.labels[best] + 1e-3 * self.rate) / (w.sum() + 1e-3)), best

    def score(self, vote):
        return 1 / (1 + np.exp(-(self.a * vote + self.b)))


def _logistic(x: np.ndarray, y: np.ndarray, a: float, b: float) -> tuple[float, float]:
    """Newton steps of a logistic curve with a small penalty on its slope."""
    z = np.stack([x, np.ones_like(x)], 1)
    w = np.array([a, b])
    ridge = np.diag([1e-4 * len(x), 1e-9])
    for _ in range(25):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES) -> Index:
    """The index from docs (id, text) and labels (id, label 0 or 1); rows without id or label are left out. Ids are
    chosen from the labels alone, so that no other text moves. Repeated rows are examples each; without rows of both labels
    the curve stays as it is set, and without any every text gets the same score."""
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where("_id IS NOT NULL AND y IN (0, 1)")
    picked = rows.orderBy(F.xxhash64("_id"), "_id", "y").limit(examples)
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), F.col("id") == F.col("_id"))
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_counts(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([list(g) for g in got], pa.list_(pa.string())), pa.array([list(g.values()) for g in got], pa.list_(pa.int64()))], ["id", "y", "t", "n"])

    got = held.select("id", "text", "y").mapInArrow(count, f"id {kind}, y int, t array<string>, n array<long>").sort("id", "y", F.hash("t")).limit(examples).toArrow()
    t, n = got["t"].combine_chunks(), got["n"].combine_chunks()
    size = np.array([len(x) for x in t], np.int64)
    index = Index(got["id"].to_pylist(), got["y"].to_numpy(), t.flatten().to_pylist(), np.repeat(np.arange(len(size)), size), n.flatten().to_numpy(zero_copy_only=False).astype(float))
    out = _votes(held.select("id", "text", "y"), index, True).toArrow()
    x, y = out["vote"].to_numpy(), out["y"].to_numpy()
    if len(np.unique(y)) == 2:
        index.a, index.b = _logistic(x, y.astype(float), index.a, index.b)
    return index


def _votes(rows: DataFrame, index: Index, leave_out: bool) -> DataFrame:
    """rows (id, text, ...) to those columns but text, vote and evidence. With leave_out an example of the row's id
    does not vote."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(index)
    keep = [c for c in rows.columns if c != "text"]
    place = rows.columns.index("text")
    id_type = rows.schema["id"].dataType.simpleString()
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = held.value
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                b = whole.slice(a, 512)
                ids = b.column(b.schema.get_field_index("id")).to_pylist() if leave_out else [None] * b.num_rows
                got = [ix.vote(_counts(x), i) for x, i in zip(b.column(place).to_pylist(), ids, strict=True)]
                own = [c for j, c in enumerate(b.columns) if j != place]
                named = pa.array([[ix.names[j] for j in e[:3]] for _, e in got], pa.list_(b.schema.field("id").type))
                yield pa.RecordBatch.from_arrays([*own, pa.array([v for v, _ in got], pa.float64()), named], [*keep, "vote", "evidence"])

    return rows.mapInArrow(run, f"{kinds}, vote double, evidence array<{id_type}>")


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, evidence): evidence is the ids of the nearest three examples. A text without terms of the examples, such
    as an empty or null one, has no neighbour and gets the score of the examples' rate. Every row is scored by itself:
    repeated rows and null ids are kept; other columns are left out."""
    got = _votes(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), index, False)
    return got.select("id", (1 / (1 + F.exp(-(F.lit(index.a) * F.col("vote") + F.lit(index.b))))).alias("score"), "evidence")
