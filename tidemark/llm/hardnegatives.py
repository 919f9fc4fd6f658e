"""Hard negatives by inner product, from STR-packed R-trees.

Rows are dealt to cells by ranges of their first components; within a cell they are tiled by sorting along one
component after the other into slabs (sort-tile-recursive), down to leaves of LEAF rows, each with its minimum bounding
box. Per component a box gives an interval of products with the query, and their sums bound the inner product of every
row inside. A queue visits the box of the largest bound first; boxes outside of all score windows, or strictly below
the kth score found, are pruned. Queries go to the cells whose boxes meet their windows, in rounds of ever more
cells, each with the kth scores of the rounds before.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEAF = 64
FAN = 16
CELL = 65_536  # rows in a cell, about: one cell is in a task's memory
GROWTH = 8
SCALE = 256
_LEAVES = "cell long, n int, cell_lo array<long>, cell_hi array<long>, lo binary, hi binary, vectors binary, labels binary, ids binary, rows binary"
_FOUND = "q long, w int, score long, id long, r long"


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """rows (id, label, v: array of numbers, anchor) less those with a null id, label, vector or component or one that
    is not finite, with components floor(scale * x), numbered by r. Vectors are filled up with zeros to the longest, so
    that scores are those of the components both have; components are held within what keeps scores whole numbers."""
    valid = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    kept = rows.where(valid & ~bad)
    width = kept.agg(F.max(F.size("v"))).first()[0] or 0
    most = float(int((2**60 / max(1, width) / 100) ** 0.5))
    step = lambda x: F.floor(F.least(F.greatest(scale * x.cast("double"), F.lit(-most)), F.lit(most))).cast("long")
    v = F.concat(F.transform("v", step), F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))
    label = F.col("label").cast("long") if rows.schema["label"].dataType.typeName() in ("byte", "short", "integer", "long") else F.xxhash64("label")
    return written(kept.select(F.monotonically_increasing_id().alias("r"), F.col("id").cast("long").alias("id"), label.alias("label"), v.alias("v"), F.coalesce("anchor", F.lit(False)).alias("anchor")), "vectors")


def tiles(v: np.ndarray, leaf: int = LEAF) -> Iterator[np.ndarray]:
    """Row numbers of the leaves, in tiling order: sort along a component, cut into slabs, go on with the next
    component, those of the largest spread first."""
    count = -(-len(v) // leaf)
    dims = list(np.argsort(-v.std(0), kind="stable")[: max(1, int(np.log2(max(2, count))))]) if v.shape[1] else []

    def tile(rows: np.ndarray, dims: list[int]) -> Iterator[np.ndarray]:
        parts = -(-len(rows) // leaf)
        if parts <= 1 or not dims:
            yield from (rows[a : a + leaf] for a in range(0, len(rows), leaf))
            return
        slabs = int(np.ceil(parts ** (1 / len(dims))))
        size = -(-parts // slabs) * leaf
        rows = rows[np.argsort(v[rows, dims[0]], kind="stable")]
        for a in range(0, len(rows), size):
            yield from tile(rows[a : a + size], dims[1:])

    yield from tile(np.arange(len(v)), dims)


def _matrix(column: pa.ListArray, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got).combine_chunks()
    r, ids, labels = (t.column(c).to_numpy() for c in ("r", "id", "label"))
    v = _matrix(t.column("v").chunk(0), len(r))
    cell, low, high = TaskContext.get().partitionId(), v.min(0).tolist(), v.max(0).tolist()
    names = [x.split()[0] for x in _LEAVES.split(", ")]
    types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * 6]
    out: list[tuple] = []
    for k, rows in enumerate(tiles(v)):
        x = v[rows]
        out.append((cell, len(rows), None if k else low, None if k else high, x.min(0).tobytes(), x.max(0).tobytes(), x.tobytes(), labels[rows].tobytes(), ids[rows].tobytes(), r[rows].tobytes()))
        if len(out) == 256:
            yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*out, strict=True), types, strict=True)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*out, strict=True), types, strict=True)], names)


def cells(rows: DataFrame, cell_rows: int = CELL) -> tuple[DataFrame, int]:
    """quantised() rows to one row per leaf. Equal vectors are told apart by a hash of their number, so that a group of
    copies is dealt over cells like other rows."""
    total = rows.count()
    n = max(1, -(-total // cell_rows), min(2 * rows.sparkSession.sparkContext.defaultParallelism, total // (8 * LEAF)))
    order = [F.get("v", F.lit(0)), F.get("v", F.lit(1)), F.xxhash64("r")]
    dealt = rows.select("r", "id", "label", "v").repartitionByRange(n, *order)
    leaves = written(dealt.mapInArrow(_build, _LEAVES), "leaves")
    return leaves, (leaves.agg(F.max("cell")).first()[0] or 0) + 1


class Tree:
    """The R-tree of one cell, from its leaves' boxes upwards."""

    def __init__(self, leaves: list[dict]):
        self.leaves = [{k: np.frombuffer(x[k], np.int64) for k in ("labels", "ids", "rows")} | {"vectors": np.frombuffer(x["vectors"], np.int64).reshape(x["n"], -1)} for x in leaves]
        boxes = [np.stack([np.frombuffer(x[k], np.int64) for x in leaves]) for k in ("lo", "hi")]
        for x in self.leaves:
            x["vectors"] = x["vectors"].astype(np.float64)
        self.largest = max((int(np.abs(b).max()) if b.size else 0) for b in boxes)
        self.levels = [tuple(b.astype(np.float64) for b in boxes)]
        while len(self.levels[-1][0]) > 1:
            lo, hi = self.levels[-1]
            at = range(0, len(lo), FAN)
            self.levels.append((np.stack([lo[a : a + FAN].min(0) for a in at]), np.stack([hi[a : a + FAN].max(0) for a in at])))

    def search(self, vector: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, admits) -> list[list[tuple[int, int, int]]]:
        """Per window low..high the first k (-score, id, row) of the rows that admits(leaf) lets through."""
        # Doubles multiply faster, and are exact as long as no sum of products passes 2^53.
        kind = np.float64 if int(np.abs(vector).max(initial=0)) * self.largest * len(vector) < 2**53 else np.int64
        a = vector.astype(kind)
        up, down = np.maximum(a, 0), np.minimum(a, 0)
        best: list[list[tuple[int, int, int]]] = [[] for _ in low]
        need, high = low.copy(), high.copy()
        queue: list[tuple] = []

        def push(level: int, start: int, stop: int) -> None:
            lo, hi = (b[start:stop].astype(kind, copy=False) for b in self.levels[level])
            most, least = hi @ up + lo @ down, lo @ up + hi @ down
            useful = ((most[:, None] >= need) & (least[:, None] <= high)).any(1)
            for i in np.flatnonzero(useful).tolist():
                heapq.heappush(queue, (-most[i], least[i], level, start + i))

        push(len(self.levels) - 1, 0, 1)
        while queue:
            most, least, level, i = heapq.heappop(queue)
            open_ = (-most >= need) & (least <= high)
            if not open_.any():
                if (-most < need).all():
                    break
                continue
            if level:
                push(level - 1, i * FAN, min((i + 1) * FAN, len(self.levels[level - 1][0])))
                continue
            leaf = self.leaves[i]
            scores = leaf["vectors"].astype(kind, copy=False) @ a
            fits = admits(leaf)
            for w in np.flatnonzero(open_).tolist():
                hits = np.flatnonzero(fits & (scores >= need[w]) & (scores <= high[w]))
                if len(hits):
                    found = zip((-scores[hits]).astype(np.int64).tolist(), leaf["ids"][hits].tolist(), leaf["rows"][hits].tolist(), strict=True)
                    best[w] = sorted([*best[w], *found])[:k]
                    if len(best[w]) == k:
                        need[w] = -best[w][-1][0]
        return best


def _search(k: int, same: bool):
    """Leaves of a cell come before the queries on it; one tree is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves: list[dict] = []
        tree, cell, out = None, None, []

        def made() -> pa.RecordBatch:
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            cols = zip(*out, strict=True) if out else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["q", "w", "score", "id", "r"])

        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                for x in whole.slice(a, 512).to_pylist():
                    if x["cell"] != cell:
                        leaves, tree, cell = [], None, x["cell"]
                    if x["q"] is None:
                        leaves.append(x)
                        continue
                    if tree is None:
                        if not leaves:
                            continue
                        tree, leaves = Tree(leaves), []
                    q, label = x["q"], x["label"]
                    admits = (lambda leaf, q=q, label=label: (leaf["labels"] == label) & (leaf["rows"] != q)) if same else (lambda leaf, label=label: leaf["labels"] != label)
                    got = tree.search(np.array(x["v"], np.int64), np.array(x["low"], np.int64), np.array(x["high"], np.int64), k, admits)
                    out += [(q, w, -s, i, r) for w, top in enumerate(got) for s, i, r in top]
                if len(out) > 10_000:
                    yield made()
                    out = []
        yield made()

    return run


def _asked(queries: DataFrame, leaves: DataFrame, start: int, stop: int, k: int, same: bool) -> DataFrame:
    """What the cells start..stop - 1 answer to the queries whose windows their boxes meet."""
    box = leaves.where("cell_lo IS NOT NULL").select("cell", "cell_lo", "cell_hi")
    asked = queries.withColumn("cell", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(stop - 1).cast("long")))).join(box, "cell")
    ends = F.arrays_zip("v", "cell_lo", "cell_hi")
    zero = F.lit(0).cast("long")
    most = F.aggregate(ends, zero, lambda s, x: s + F.greatest(x["v"] * x["cell_lo"], x["v"] * x["cell_hi"]))
    least = F.aggregate(ends, zero, lambda s, x: s + F.least(x["v"] * x["cell_lo"], x["v"] * x["cell_hi"]))
    asked = asked.withColumns({"most": most, "least": least}).where(F.exists(F.arrays_zip("low", "high"), lambda w: (w["low"] <= F.col("most")) & (w["high"] >= F.col("least"))))
    here = leaves.where(F.col("cell").between(start, stop - 1)).drop("cell_lo", "cell_hi")
    both = here.unionByName(asked.select("cell", "q", "label", "v", "low", "high"), allowMissingColumns=True)
    n = stop - start
    both = both.repartition(min(4 * n, max(n, 4096)), "cell").sortWithinPartitions(F.col("cell"), F.col("q").asc_nulls_first())
    return both.mapInArrow(_search(k, same), _FOUND)


def _best(queries: DataFrame, leaves: DataFrame, n: int, k: int, same: bool) -> DataFrame:
    """queries (q, label, v, low, high: bounds of windows) to their first k rows per window, ranked. Cells are asked in
    rounds, each of GROWTH times as many as before: the kth score of all earlier rounds raises a window's lower bound,
    so that a round answers with about GROWTH times k rows for a window instead of k for each cell."""
    w = Window.partitionBy("q", "w").orderBy(F.desc("score"), "id", "r")
    found, stop, asked = None, 0, queries
    while True:
        start, stop = stop, min(n, max(1, GROWTH * stop))
        part = _asked(asked, leaves, start, stop, k, same)
        both = part if found is None else found.select(part.columns).unionByName(part)
        best = both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        if stop == n:
            return best
        found = written(best, "found")
        kth = found.groupBy("q", "w").agg(F.min("score").alias("kth"), F.count("*").alias("c")).where(F.col("c") == k)
        kth = kth.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("kth"))
        raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.element_at("kth", i), x)))
        asked = queries.join(kth, "q", "left").withColumn("low", raised).drop("kth")


def mine(rows: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = SCALE, cell_rows: int = CELL) -> DataFrame:
    """rows (id, label, v, anchor) to (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its first rows of the same label by score, then id, the anchor's own row left out; for
    each the first rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score are
    its negatives. Rows with a null id, label or vector, or with a component that is null or not finite, take no part;
    see quantised() for vectors of several lengths. Repeated rows are rows of their own, and so are their anchors. An
    empty table, an anchor without positives and a positive without negatives give no rows; other columns are ignored.
    Queries are ever to be compared with all rows: each cell is read once, a query goes to each cell once at most."""
    kept = quantised(rows.select("id", "label", "v", "anchor"), scale)
    leaves, n = cells(kept, cell_rows)
    every = lambda x: F.array(F.lit(x).cast("long"))
    anchors = kept.where("anchor").select(F.col("r").alias("q"), F.col("id").alias("anchor_id"), "label", "v")
    first = _best(anchors.drop("anchor_id").withColumns({"low": every(-(2**62)), "high": every(2**62)}), leaves, n, positives, True)
    first = written(first.select("q", "rank", F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "positives")
    least = F.transform("p", lambda x: F.negate(_floordiv(F.negate(x["positive_score"]) * low, 100)))
    most = F.transform("p", lambda x: _floordiv(x["positive_score"] * high, 100))
    windows = first.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score", "positive_id"))).alias("p"))
    asked = anchors.join(windows, "q").select("q", "anchor_id", "label", "v", least.alias("low"), most.alias("high"))
    found = _best(asked.drop("anchor_id"), leaves, n, negatives, False)
    named = first.join(anchors.select("q", "anchor_id"), "q").select("q", (F.col("rank") - 1).alias("w"), "anchor_id", "positive_id", "positive_score")
    return found.join(named, ["q", "w"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _floordiv(x: Column, n: int) -> Column:
    """In whole numbers, as scores may be beyond those that a double holds."""
    return F.call_function("div", x - F.pmod(x, F.lit(n).cast("long")), F.lit(n).cast("long"))
