"""Repeated passages by level-wise doubling: windows of 5 words that repeat are extended to 10, those to 20.

Only windows at minimizers take part in the short levels: of the sixteen 5-word windows inside a 20-word window the
one with the least hash is chosen, alike in every copy, so no repeat is lost. A minimizer is extended to the right,
or to the left where the right would leave the 20-word window. The 20-word windows of one extended minimizer follow one
another; they are sent as one row, by the hash of its 10 words, with a hash of 64 bits each, so that windows are compared
by 128 bits in all. Where a 10-word window is found more than HOT times, each 20-word window is a row by itself, so
that no task holds more than one window's hash of it. Texts are read whole, one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, release, written

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(31)
SIZE = 20
HOT = 4096


def _mix(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    x = (a * _A) ^ ((b + np.uint64(seed)) * _B)
    x ^= x >> _C
    x *= _A
    return x ^ (x >> _C)


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of 5 and of 10 words."""
    h1 = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    h2 = _mix(h1[:-1], h1[1:])
    h5 = _mix(_mix(h2[:-3], h2[2:-1]), h1[4:])
    return h5, _mix(h5[:-5], h5[5:])


def chosen(h5: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 20-word window the place of its minimizer, and whether that is extended to the right."""
    at = np.lib.stride_tricks.sliding_window_view(h5, 16).argmin(1)
    return np.arange(len(at)) + at, at <= 10


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _same(value: pa.Scalar, n: int) -> pa.Array:
    return pa.repeat(value, n)


def _each(batches, first) -> Iterator[tuple]:
    for b in batches:
        for r in range(b.num_rows):
            yield (*[c[r] for c in b.columns[:first]], _WORD.findall(b.column(first)[r].as_py() or ""))


def _gathered(rows: Iterator[pa.RecordBatch], least: int = 50_000) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer, larger batches."""
    held, n = [], 0
    for b in rows:
        held.append(b)
        n += b.num_rows
        if n >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept): kept is the remaining words joined by spaces. A word goes if a window of SIZE
    words over it also starts earlier (smaller id, or same id and further left). Null and empty texts have no words.
    Rows equal in id and text are one document and fare alike; rows with one id but different texts are told apart, in the
    order of a hash of the text; a null id comes first. Other columns are left out."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.hash(text_col).alias("t"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def short(batches):
        def rows():
            for doc, t, w in _each(batches, 2):
                if len(w) >= SIZE:
                    h5, h10 = windows(w)
                    p, right = chosen(h5)
                    head = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
                    last = np.append(head[1:], len(p)) - 1
                    p, left, right = p[head], ~right[head], right[last]
                    hr = pa.array(h10[np.where(right, p, 0)].view(np.int64), mask=~right)
                    hl = pa.array(h10[np.where(left, p - 5, 0)].view(np.int64), mask=~left)
                    yield pa.RecordBatch.from_arrays([_long(h5[p]), _same(doc, len(p)), _same(t, len(p)), pa.array(p.astype(np.int32)), hr, hl], ["h5", "id", "t", "p", "hr", "hl"])

        yield from _gathered(rows())

    def repeated(df: DataFrame, key: str) -> DataFrame:
        return df.withColumn("c", F.count("*").over(Window.partitionBy(key))).where("c > 1")

    five = written(repeated(src.mapInArrow(short, f"h5 long, id {kind}, t int, p int, hr long, hl long"), "h5").select("id", "t", "p", "hr", "hl"), "h5")
    release(spark)
    sides = F.explode(F.array(F.struct(F.col("hr").alias("h"), F.lit(True).alias("r")), F.struct(F.col("hl").alias("h"), F.lit(False).alias("r"))))
    ten = written(repeated(five.select("id", "t", "p", sides.alias("x")).where("x.h IS NOT NULL").select("id", "t", "p", "x.h", "x.r"), "h").select("id", "t", (F.col("p") * 2 + F.col("r").cast("int")).alias("spot"), (F.col("c") > HOT).alias("hot")), "h10")
    discard(five)
    release(spark)
    spots = ten.groupBy(F.col("id").alias("_id"), F.col("t").alias("_t")).agg(F.collect_set(F.when(~F.col("hot"), F.col("spot"))).alias("some"), F.collect_set(F.when(F.col("hot"), F.col("spot"))).alias("many"))

    def full(batches):
        def rows():
            for doc, t, some, many, w in _each(batches, 4):
                h5, h10 = windows(w)
                p, right = chosen(h5)
                code = p * 2 + right
                a, g = _mix(h10[:-10], h10[10:], 7), h10[np.where(right, p, p - 5)]
                some, many = np.array(some.as_py(), np.int64), np.array(many.as_py(), np.int64)
                head = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
                end = np.append(head[1:], len(code))
                live = np.isin(code[head], some)
                head, end = head[live], end[live]
                body = a.tobytes()
                blobs = [body[8 * i : 8 * j] for i, j in zip(head.tolist(), end.tolist(), strict=True)]
                each = np.flatnonzero(np.isin(code, many)) if len(many) else np.empty(0, np.int64)
                key = np.concatenate([g[head], _mix(g[each], a[each], 9)])
                at = np.concatenate([head, each]).astype(np.int32)
                blobs += [body[8 * i : 8 * i + 8] for i in each.tolist()]
                yield pa.RecordBatch.from_arrays([_long(key), _same(doc, len(at)), _same(t, len(at)), pa.array(at), pa.array(blobs, pa.binary())], ["g", "id", "t", "i", "a"])

        yield from _gathered(rows(), 20_000)

    on = F.col("id").eqNullSafe(F.col("_id")) & F.col("t").eqNullSafe(F.col("_t"))
    twenty = src.join(spots, on).select("id", "t", "some", "many", "text").mapInArrow(full, f"g long, id {kind}, t int, i int, a binary")

    def later(batches):
        """Rows sorted by g, then by document and place: of the windows of a row those seen before, as bits. The rows of
        one window in equal documents say the same."""
        g_now, seen = None, {}
        for b in batches:
            out_id, out = [], []
            ids, ts, at, blobs = b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()
            for r, g in enumerate(b.column(0).to_pylist()):
                if g != g_now:
                    g_now, seen = g, {}
                mask, place = 0, (ids[r], ts[r], at[r])
                for k in range(0, len(blobs[r]), 8):
                    a = blobs[r][k : k + 8]
                    if seen.setdefault(a, (*place, k)) != (*place, k):
                        mask |= 1 << (k >> 3)
                if mask:
                    out_id.append(r)
                    out.append(mask)
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(out_id, pa.int64())), b.column(2).take(pa.array(out_id, pa.int64())), b.column(3).take(pa.array(out_id, pa.int64())), pa.array(out, pa.int32())], ["id", "t", "i", "mask"])

    sent = twenty.repartition("g").sortWithinPartitions("g", "id", "t", "i").select("g", "id", "t", "i", "a")
    gone = written(sent.mapInArrow(later, f"id {kind}, t int, i int, mask int"), "gone")
    discard(ten)
    release(spark)
    gone = gone.groupBy(F.col("id").alias("_id"), F.col("t").alias("_t")).agg(F.collect_list(F.struct("i", "mask")).alias("gone"))

    def cut(batches):
        for b in batches:
            out = []
            for doc, gone, w in _each([b], 2):
                hit = np.zeros(len(w) + 1, np.int64)
                left = w
                if gone.is_valid:
                    i = gone.values.field(0).to_numpy()
                    mask = gone.values.field(1).to_numpy()
                    for k in range(16):
                        s = i[(mask >> k) & 1 == 1] + k
                        np.add.at(hit, s, 1)
                        np.add.at(hit, s + SIZE, -1)
                    stays = np.cumsum(hit[:-1]) == 0
                    left = [w[j] for j in np.flatnonzero(stays).tolist()]
                out.append((len(w), len(w) - len(left), " ".join(left)))
            n, m, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    return src.join(gone, on, "left").select("id", "gone", "text").mapInArrow(cut, f"id {kind}, n_words long, n_removed long, kept string")
