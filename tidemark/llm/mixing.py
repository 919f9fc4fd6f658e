"""Language-model scoring by online logistic context mixing over hashed-context bit predictors.

Every byte is eight binary decisions. For each context, the last 1, 2, 3 or 4 bytes, the training texts give how often
each byte followed; sums over the bytes that agree with the bits so far predict the next bit, as a logit whose size
grows with the counts. The logits are mixed by weights gated by the bit's number and by how well the longer contexts
are known, one set for the whole corpus. They are learned online from every byte of every training text, each without its
own count: a block takes its different contexts, with how often each occurs in its texts, in slices dealt by a hash, and the
weights of all blocks are averaged by the bytes behind them. A second layer takes the mixed logit: along each text its scale and offset are refined by gradient steps for each bit, once per SEGMENT of bytes.

The counts are a Spark table that grows with the corpus and is never held whole: documents are dealt into blocks of about
BLOCK bytes, a block states which contexts it holds, and a join gives it the counts of those alone. Word counts of the
base score go the same way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, release, written

ORDERS = (1, 2, 3, 4)
K = len(ORDERS)
BLOCK = 12 << 20  # bytes of text in a block, on average
CHUNK = 3 << 20  # bytes worked on at a time
SEGMENT = 64
SIDE = 128  # texts side by side in the second layer, so that its arrays stay small
RATE, FINE = 0.5, 0.001
LEVELS = 3
SLICES, ROUNDS = 48, 3  # gradient steps in a round over a block's contexts, and rounds; the last round's weights are averaged
START = (0.2, 0.25, 0.3, 0.4)
PRIOR = 0.4
WORD_ROW, NEED_ROW = -1, -2
#: The bits of each byte as signs.
SIGN = np.where((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1 == 1, np.float32(1), np.float32(-1))
END = b" "  # the end token: a blank, which no word holds


def _low(text: str | None) -> bytes:
    """UTF-8 with A to Z in lower case."""
    return (text or "").encode("utf-8", "replace").lower()


def _bytes(low: bytes) -> np.ndarray:
    """Closed by a zero byte, so that the probabilities of all texts add up to one at most."""
    return np.frombuffer(low + b"\0", np.uint8)


def _tokens(low: bytes) -> Counter:
    """bytes.split() cuts at the blank and the control characters 9 to 13, no others."""
    return Counter([*low.split(), END])


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and for each value its place among them. Few are different, so they are told
    apart by hashing and only these sorted."""
    codes, u = pd.factorize(values)
    o = np.argsort(u)
    place = np.empty(len(u), np.int64)
    place[o] = np.arange(len(u))
    return u[o], place[codes]


def longest(x: np.ndarray) -> np.ndarray:
    """For each byte of x the number made of the four bytes before it, zeros at the start, and itself."""
    c = x.astype(np.uint64)
    out = c.copy()
    for j in range(1, 5):
        out[j:] |= c[: len(c) - j] << np.uint64(8 * j) if len(c) > j else np.uint64(0)
    return out


def key(longs: np.ndarray, k: int) -> np.ndarray:
    """The last k bytes and the byte itself, marked with k."""
    return (longs & np.uint64((1 << 8 * (k + 1)) - 1)) | np.uint64(k << 40)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    if not len(k):
        return k, n
    o = np.argsort(k)
    k, n = k[o], n[o]
    head = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[head], np.add.reduceat(n, head)


def _parts(rows: pa.Table) -> Iterator[tuple[list[int], list[bytes]]]:
    """Numbers and lower-cased texts of about CHUNK bytes at a time, long texts first."""
    texts = [_low(t) for t in rows["text"].to_pylist()]
    at, size = [], 0
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        at.append(i)
        size += len(texts[i]) + 1
        if size >= CHUNK:
            yield at, [texts[j] for j in at]
            at, size = [], 0
    if at:
        yield at, [texts[j] for j in at]


def gather(rows: pa.Table) -> pa.Table:
    """One block's rows (ctx, next, n, block): counts of its training texts, words as next = WORD_ROW, and rows with
    next = NEED_ROW for its contexts and for the words of its other texts."""
    block, held = rows["block"][0].as_py(), rows["held_out"].to_numpy(zero_copy_only=False)
    keys, counts, others, words, known = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)], Counter(), set()
    for at, texts in _parts(rows):
        learn, other = [], []
        for i, low in zip(at, texts, strict=True):
            (other if held[i] else learn).append(longest(_bytes(low)))
            if held[i]:
                known.update(_tokens(low))
            else:
                words.update(low.split())
                words[END] += 1
        if learn:
            u, back = _numbered(np.concatenate(learn))
            keys.append(u)
            counts.append(np.bincount(back, minlength=len(u)))
        if other:
            others.append(pd.unique(np.concatenate(other)))
    longs, many = _summed(keys, counts)
    level = [_summed([key(longs, k)], [many]) for k in ORDERS]
    k, n = np.concatenate([u for u, _ in level]), np.concatenate([c for _, c in level])
    every = np.unique(np.concatenate([longs, *others]))
    need = np.unique(np.concatenate([key(every, j) >> np.uint64(8) for j in ORDERS]))
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    known.difference_update(words)
    seen = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
    ctx = np.concatenate([k >> np.uint64(8), own, need, seen]).view(np.int64)
    nxt = np.concatenate([(k & np.uint64(255)).astype(np.int16), np.full(len(own), WORD_ROW, np.int16), np.full(len(need) + len(seen), NEED_ROW, np.int16)])
    many = np.concatenate([n, np.fromiter(words.values(), np.int64, len(words)), np.zeros(len(need) + len(seen), np.int64)])
    return pa.table({"ctx": ctx, "next": nxt, "n": many, "block": pa.array(np.full(len(ctx), block, np.int32))})


class Model:
    """Counts of the contexts of one block."""

    def __init__(self, ctx: np.ndarray, nxt: np.ndarray, n: np.ndarray):
        o = np.argsort((ctx << np.uint64(8)) | nxt.astype(np.uint64))
        self.key = ((ctx << np.uint64(8)) | nxt.astype(np.uint64))[o]
        n = n[o].astype(np.float32)
        # sums[j]: the counts of all bytes after this context that agree with this one in their first j bits.
        self.sums = np.empty((9, len(n)), np.float32)
        for j in range(9):
            p = self.key >> np.uint64(8 - j)
            head = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else np.empty(0, np.int64)
            self.sums[j] = np.repeat(np.add.reduceat(n, head), np.diff(np.append(head, len(p)))) if len(p) else n

    def logits(self, keys: np.ndarray, less: float) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted keys: logits (keys, 8) of the bits taken, and the total count of the context. less is taken off the
        counts along each key's own path: 1 leaves the text at hand out."""
        s = np.zeros((9, len(keys)), np.float32)
        if len(self.key):
            at = np.searchsorted(self.key, keys)
            after, before = np.minimum(at, len(self.key) - 1), np.maximum(at - 1, 0)
            for j in range(9):
                shift = np.uint64(8 - j)
                p = keys >> shift
                s[j] = np.where(self.key[after] >> shift == p, self.sums[j][after], np.where(self.key[before] >> shift == p, self.sums[j][before], 0))
        if less:
            s = np.maximum(s - np.float32(less), 0)
        taken, other = s[1:], s[:-1] - s[1:]
        return np.log((taken + PRIOR) / (other + PRIOR)).T.astype(np.float32), s[0]


class Mixer:
    """Weights by level, bit and input."""

    def __init__(self):
        self.w = np.tile(np.array(START, np.float32), (LEVELS, 8, 1))

    def learn(self, x: np.ndarray, level: np.ndarray, n: np.ndarray) -> None:
        """Gradient steps over slices of rows that occur n times each; x (u, 8, K) are logits of the bits taken, so the
        target is always 1."""
        last = np.zeros_like(self.w)
        for step in range(SLICES * ROUNDS):
            at = slice(step % SLICES, None, SLICES)
            xs, lv, m = x[at], level[at], n[at].astype(np.float32)
            error = m[:, None] / (1 + np.exp(np.clip(np.einsum("njk,njk->nj", xs, self.w[lv]), -10, 10)))
            for v in range(LEVELS):
                of = lv == v
                if of.any():
                    self.w[v] = np.clip(self.w[v] + RATE * np.einsum("nj,njk->jk", error[of], xs[of]) / m.sum(), -2, 2)
            if step >= SLICES * (ROUNDS - 1):
                last += self.w / SLICES
        self.w = last

    def costs(self, x: np.ndarray, level: np.ndarray, backs: list[np.ndarray]) -> np.ndarray:
        """Bits to code each text, long ones first. The mix is made once for each different row of x."""
        mixed = np.einsum("njk,njk->nj", x, self.w[level]).astype(np.float32)
        return np.concatenate([np.empty(0), *[self._refined(mixed, backs[i : i + SIDE]) for i in range(0, len(backs), SIDE)]])

    def _refined(self, mixed: np.ndarray, backs: list[np.ndarray]) -> np.ndarray:
        size = np.array([len(b) for b in backs])
        flat, start, step = np.concatenate(backs), (np.cumsum(size) - size)[:, None], np.arange(SEGMENT)
        spent = np.zeros(len(backs))
        scale, offset = np.ones((len(backs), 1, 8), np.float32), np.zeros((len(backs), 1, 8), np.float32)
        # The bit taken is always the target 1, so the offset acts with the sign of the bit itself.
        for a in range(0, int(size[0]), SEGMENT):
            m = int((size > a).sum())
            full = size[m - 1] >= a + SEGMENT
            # Past the end of a text its last byte stands, which counts for nothing.
            at = flat.take(start[:m] + (a + step if full else np.minimum(a + step, size[:m, None] - 1)))
            d, sign = mixed.take(at, 0), SIGN.take(self.byte.take(at), 0)
            e = scale[:m] * d
            e += offset[:m] * sign
            np.clip(e, -10, 10, out=e)
            np.negative(e, out=e)
            np.exp(e, out=e)
            q = e + 1
            bits = q.reshape(-1, 8).T
            whole = bits[0] * bits[1]
            for j in range(2, 8):
                whole *= bits[j]
            bits = np.log2(whole).reshape(m, SEGMENT)
            e /= q
            if not full:
                there = a + step < size[:m, None]
                bits *= there
                e *= there[:, :, None]
            spent[:m] += bits.sum(1, dtype=np.float64)
            scale[:m, 0] = np.clip(scale[:m, 0] + FINE * np.einsum("msj,msj->mj", e, d), 0.25, 4)
            offset[:m, 0] = np.clip(offset[:m, 0] + FINE * np.einsum("msj,msj->mj", e, sign), -4, 4)
        return spent


def _prepared(model: Model, mixer: Mixer, texts: list[bytes], less: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Logits and levels of the different longest contexts with their byte, and for each text the places of its own."""
    longs = [longest(_bytes(t)) for t in texts]
    u, back = _numbered(np.concatenate(longs))
    x, seen = _inputs(model, u, less)
    mixer.byte = (u & np.uint64(255)).astype(np.uint8)
    return x, seen, np.split(back, np.cumsum([len(v) for v in longs])[:-1])


def _inputs(model: Model, u: np.ndarray, less: float) -> tuple[np.ndarray, np.ndarray]:
    """Logits and levels of longest contexts with their byte."""
    x, seen = np.empty((len(u), 8, K), np.float32), np.zeros(len(u), np.int8)
    for j, k in enumerate(ORDERS):
        of = key(u, k)
        o = np.argsort(of)
        of = of[o]
        head = np.append(True, of[1:] != of[:-1])
        logits, total = model.logits(of[head], less)
        place = np.cumsum(head) - 1
        x[o, :, j] = logits[place]
        if k >= 3:
            seen[o] += (total > 2)[place]
    return x, seen


def packed() -> Column:
    """next and n in one number, for what is shuffled by block: a column less is a good part of the bytes."""
    return F.shiftleft("n", 9).bitwiseOR(F.col("next").cast("long") + 1).alias("m")


def unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ctx, next and n of rows (ctx, m)."""
    m = rows["m"].to_numpy()
    return rows["ctx"].to_numpy().view(np.uint64), (m & 511).astype(np.int16) - np.int16(1), m >> 9


def taught(own: pa.Table, look: pa.Table) -> pa.Table:
    """One block's weights (place, w, n): own is what gather() made of its longest contexts, n the training bytes behind
    a weight."""
    ctx, nxt, n = unpacked(look)
    of = nxt != WORD_ROW
    at, byte, many = unpacked(own)
    u = ((at & np.uint64((1 << 32) - 1)) << np.uint64(8)) | byte.astype(np.uint64)
    o = np.argsort(u * np.uint64(0x9E3779B97F4A7C15))
    u, many = u[o], many[o]
    mixer = Mixer()
    if len(u):
        x, level = _inputs(Model(ctx[of], nxt[of], n[of]), u, 1.0)
        mixer.learn(x, level, many)
        behind = np.bincount(level, many, LEVELS).astype(np.int64)
    else:
        behind = np.zeros(LEVELS, np.int64)
    w = mixer.w.reshape(-1).astype(float)
    return pa.table({"place": pa.array(np.arange(len(w), dtype=np.int32)), "w": w, "n": np.repeat(behind, len(w) // LEVELS)})


def _weights(gathered: DataFrame, looked: DataFrame) -> np.ndarray:
    """The weights of all blocks averaged, START where no training text reaches."""
    own = gathered.where((F.col("next") >= 0) & (F.shiftright("ctx", 32) == ORDERS[-1])).select("block", "ctx", packed())
    each = own.groupBy("block").cogroup(looked.groupBy("block")).applyInArrow(taught, "place int, w double, n long")
    w = Mixer().w.reshape(-1)
    for r in each.where("n > 0").groupBy("place").agg(F.round(F.sum(F.col("w") * F.col("n")) / F.sum("n"), 6).alias("w")).collect():
        w[r["place"]] = r["w"]
    return w.reshape(LEVELS, 8, K)


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), a row for each of docs.
    held_out is a Boolean column of docs; its rows are scored but not learned from. Null texts are empty: one end token.
    Every row is scored by itself, so ids may be null or repeated; other columns are left out. Words are
    told apart by hashes of 64 bits."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out.alias("held_out"))
    total = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK))
    src = src.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int"))
    row = "ctx long, next short, n long, block int"
    gathered = written(src.groupBy("block").applyInArrow(gather, row), "gathered", "zstd")
    release(spark)
    counts = written(gathered.where(F.col("next") != NEED_ROW).repartition("ctx").groupBy("ctx", "next").agg(F.sum("n").alias("n")), "counts", "zstd")
    release(spark)
    sums = counts.where(F.col("next") == WORD_ROW).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_all, n_words = int(sums[0]), int(sums[1])
    need = gathered.where(F.col("next") < 0).select("ctx", "block")
    looked = written(need.join(counts, "ctx").select("block", "ctx", packed()), "looked", "zstd")
    discard(counts)
    release(spark)
    weights = _weights(gathered, looked)
    discard(gathered)
    release(spark)
    kind = src.schema["id"].dataType.simpleString()

    def run(rows: pa.Table, look: pa.Table) -> pa.Table:
        ctx, nxt, n = unpacked(look)
        word = nxt == WORD_ROW
        count = dict(zip(ctx[word].tolist(), n[word].tolist(), strict=True))
        model, mixer = Model(ctx[~word], nxt[~word], n[~word]), Mixer()
        mixer.w = weights
        seen: dict[bytes, int] = {}  # of the block's words
        out = np.zeros((rows.num_rows, 5))
        for at, texts in _parts(rows):
            out[at, 4] = [len(_bytes(t)) for t in texts]
            out[at, 3] = mixer.costs(*_prepared(model, mixer, texts, 0.0))
            for i, low in zip(at, texts, strict=True):
                tokens = _tokens(low)
                m = np.fromiter(tokens.values(), float, len(tokens))
                for w in tokens:
                    if w not in seen:
                        seen[w] = count.get(xxhash.xxh64_intdigest(w), 0)
                c = np.fromiter(map(seen.__getitem__, tokens), float, len(tokens))
                out[i, :3] = m.sum(), m[c > 0].sum(), (m * np.log10((c + 1) / (n_all + n_words + 1))).sum()
        return pa.table({
            "id": rows["id"], "held_out": rows["held_out"], "n_tokens": out[:, 0].astype(np.int64), "n_known": out[:, 1].astype(np.int64),
            "train_tokens": np.full(rows.num_rows, n_all, np.int64), "base_score": out[:, 2], "score": -out[:, 3] * np.log10(2.0), "bits_per_byte": out[:, 3] / out[:, 4],
        })

    made = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    done = written(src.groupBy("block").cogroup(looked.groupBy("block")).applyInArrow(run, made), "scores")
    discard(looked)
    return done
