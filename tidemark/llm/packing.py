"""Best-fit packing of token sequences: hierarchical residual packing.

Every partition packs its own pieces by best fit, longest first, and emits bins that are nearly full; the underfull
bins go on as items, merged eight partitions to one, and are packed again, until they fit LAST_ROWS to a task or a
round no longer lowers their number by a thousandth. A bin carries the list of its members, at most as many as the
capacity has tokens, so a row's size is bounded.

Ids of a text are those of its words one after the other, since the tokenizer merges within words only. So each task
encodes a word once and keeps its ids (the last CACHE to 2 * CACHE words it met, so that frequent ones stay); texts with
characters that its normalizer or word pattern treats in ways not followed here go through the tokenizer whole.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

CAPACITY = 4096
END_ID = 1
FULL = 0.999  # a bin this full leaves the tree at once
FAN_IN = 8
LAST_ROWS = 500_000
CACHE = 400_000
#: Characters outside of these are left to the tokenizer itself: so are strings of its special tokens, which begin with _MARK.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\u012f\u0131-\u017f‘’“”–—…€]")
_MARK = "<|"
#: Words of the tokenizer's pre-tokenizer, in lower-case texts without such: letters, contractions, single digits, all
#: else. Fixed values.
_WORDS = re.compile("[a-z\xdf-\xf6\xf8-\u017f]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\\s0-9a-z\xdf-\xf6\xf8-\u017f]+")
MEMBER = "struct<doc_id:{kind},piece:int,start:long,length:long,ids_crc32:long>"


class Encoder:
    """Little-endian unsigned 32-bit ids of whole texts, as the tokenizer of the file gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        # Each word ends with one token that carries the vocabulary's mark of word ends.
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def learn(self, words: list[str]) -> None:
        texts = [" ".join(words[a : a + 500]) for a in range(0, len(words), 500)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(words):
            body, at = ids.tobytes(), (ends * 4).tolist()
            self.known.update(zip(words, [body[a:z] for a, z in zip([0, *at[:-1]], at, strict=True)], strict=True))
        else:
            for w in words:
                self.known[w] = np.array(self.tok.encode(w, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split: list[list[str] | None] = []
        new: set[str] = set()
        for t in texts:
            if _MARK in t or _OTHER.search(t):
                split.append(None)
                continue
            words = _WORDS.findall((t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)).lower())
            split.append(words)
            new.update(words)
        self.learn_new(new)
        get = self.known.__getitem__
        return [np.array(self.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if w is None else b"".join(map(get, w)) for t, w in zip(texts, split, strict=True)]

    def learn_new(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.before, self.known = self.known, {}
            new = list(words)
        if self.before:
            old = self.before
            self.known.update((w, old[w]) for w in new if w in old)
            new = [w for w in new if w not in old]
        for a in range(0, len(new), 20_000):
            self.learn(new[a : a + 20_000])


@functools.lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One per worker process, which serves one task after the other: neither the file nor known words are read again."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece. tokenizer is the file's path on the executors; None asks the installed tokenizer package.
    A null text is empty: its piece is the end id alone. Repeated rows are packed each; a null id is kept as it is."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = _encoder(tokenizer or public_tokenizers.path("word_bpe_49k.json"))
        end = np.array([END_ID], "<u4").tobytes()
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                b = whole.slice(a, 512)
                out: list[list] = [[], [], [], [], []]
                for doc, body in zip(b.column(0).to_pylist(), encoder.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                    ids = body + end
                    for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[s : s + 4 * capacity]
                        for col, x in zip(out, (doc, k, s // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            col.append(x)
                types = (whole.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers. Free space is a small whole number, so bins are kept by it, and a bit set of the
    spaces in use finds the tightest one."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    by_free: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    used = 0
    bins = []
    for i in order:
        n = lengths[i]
        m = used >> n
        if m:
            free = (m & -m).bit_length() - 1 + n
            b = by_free[free].pop()
            if not by_free[free]:
                used &= ~(1 << free)
        else:
            free, b = capacity, []
            bins.append(b)
        b.append(i)
        if free > n:
            by_free[free - n].append(b)
            used |= 1 << (free - n)
    return bins


def pack(items: DataFrame, capacity: int = CAPACITY, full: float = FULL, fan_in: int = FAN_IN) -> DataFrame:
    """pieces to (doc_id, piece, start, length, ids_crc32, sequence_id, offset). Ties in length may go either way; an
    empty table gives no rows. Each round is written, so a lost executor repeats one round only."""
    kind = items.schema["doc_id"].dataType.simpleString()
    rest = items.select(F.col("length").alias("fill"), F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32")).alias("members"))
    n = max(1, items.rdd.getNumPartitions())
    done: list[DataFrame] = []

    def run_in(last: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got = [x for x in frames if len(x)]
            if not got:
                return
            x = pd.concat(got, ignore_index=True)
            fill, members = x["fill"].to_numpy(), x["members"].to_numpy()
            bins = best_fit(fill.tolist(), capacity)
            for a in range(0, len(bins), 2000):
                part = bins[a : a + 2000]
                f = [int(fill[b].sum()) for b in part]
                yield pd.DataFrame({"fill": f, "members": [[m for i in b for m in members[i]] for b in part], "out": [last or v >= full * capacity for v in f]})

        return run

    before = None
    while True:
        level = written(rest.mapInPandas(run_in(n == 1), f"fill long, members array<{MEMBER.format(kind=kind)}>, out boolean"), "bins")
        done.append(level.where("out"))
        if n == 1:
            break
        left = level.where(~F.col("out")).count()
        few = max(1, -(-left // LAST_ROWS))
        if n <= few and before is not None and left > before * 0.999:
            done.append(level.where(~F.col("out")))
            break
        before = left
        n = max(few, -(-n // fan_in)) if few > 1 or n > fan_in else 1
        rest = level.where(~F.col("out")).select("fill", "members").repartition(n)
    bins = done[0]
    for more in done[1:]:
        bins = bins.unionByName(more)
    bins = bins.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    # Offsets by one pass over the members: a running sum at the end of the list built so far.
    step = "aggregate(members, array(0L), (a, m) -> array_append(a, element_at(a, -1) + m.length))"
    return bins.select("sequence_id", "members", F.expr(step).alias("at")).select("sequence_id", F.posexplode("members").alias("i", "m"), "at").select("m.*", "sequence_id", F.get("at", F.col("i")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(written(pieces(docs, tokenizer, capacity), "pieces"), capacity)
