"""Online packing by the sum of squares.

Every partition keeps an array with the number of partially filled windows at each fill level. A document's last piece
(whole windows leave at once) goes to the level that makes the sum of the squared numbers smallest, the fullest of
equals; a window that becomes full leaves. What is still open at a partition's end meets the open windows of other
partitions as items of a second pass, and what that leaves is poured: cut into full windows one after the other, the
last of a task into windows of a power of two, which need no padding. So every id is packed and no window is padded.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

CAPACITY = 1024
END_ID = 0
OPEN = 20_000  # so many open windows, with their ids, are in a task's memory at most
LAST_ROWS = 2_000  # open windows to a task of the second pass
#: Texts with characters outside of these, special tokens, or very long runs go through the tokenizer itself.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa0-\xac\xae-ɏΑ-ΡΣ-ώА-я‐-‧€ぁ-ゖァ-ヺ一-龥]|<\\||\\S{2000}|\\s{2000}")


class Encoder:
    """Little-endian unsigned 32-bit ids of whole texts, as the tokenizer of the file gives them. ranks names the file
    of the same vocabulary as ranks, whose library is faster and gives the same ids for common characters."""

    def __init__(self, path: str, ranks: str | None):
        import base64

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is None or _OTHER.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


@functools.lru_cache(1)
def _encoder(path: str, ranks: str | None) -> Encoder:
    return Encoder(path, ranks)


class Levels:
    """The open windows of a task by fill level. An item is (members, ids), a member (doc_id, start, length, crc,
    doc_tokens)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.windows: list[list] = [[] for _ in range(capacity)]
        self.open = 0

    def level(self, size: int) -> int:
        """The fill level to put an item on, 0 for a new window. Moving a window from h to h + size changes the sum of
        squares by 2 (N(h + size) - N(h)) + 2, filling one up by 1 - 2 N(h), a new one by 2 N(size) + 1."""
        n, cap = self.counts, self.capacity
        best, change = 0, 2 * n[size] + 1
        if cap - size >= 1 and self.open:
            from_, to = n[1 : cap - size + 1], n[1 + size : cap + 1]
            delta = 2 * (to - from_) + 2
            delta[-1] -= 1
            delta[from_ == 0] = np.iinfo(np.int64).max
            h = len(delta) - 1 - int(np.argmin(delta[::-1]))
            if delta[h] <= change:
                best = h + 1
        return best

    def add(self, size: int, members: list, ids: bytes) -> tuple[list, bytes] | None:
        """The window that the item fills up, if it does."""
        h = self.level(size)
        if h:
            had, old = self.windows[h].pop()
            members, ids = had + members, old + ids
            self.counts[h] -= 1
            self.open -= 1
        if h + size == self.capacity:
            return members, ids
        self.windows[h + size].append((members, ids))
        self.counts[h + size] += 1
        self.open += 1
        return None

    def rest(self) -> Iterator[tuple[list, bytes]]:
        for level in reversed(self.windows):
            yield from level
        self.__init__(self.capacity)


def cut(members: list, ids: bytes, sizes: Iterator[int]) -> Iterator[list]:
    """Members, in their order, cut into windows of the given sizes; their checksums are made anew where they are cut."""
    at, left, window = 0, next(sizes), []
    for doc, start, length, crc, total in members:
        done = 0
        while done < length:
            take = min(left, length - done)
            part = ids[4 * (at + done) : 4 * (at + done + take)]
            window.append((doc, start + done, take, crc if take == length else zlib.crc32(part), total))
            done, left = done + take, left - take
            if not left:
                yield window
                window, left = [], next(sizes, 0)
        at += length
    if window:
        yield window


def sizes(total: int, capacity: int) -> Iterator[int]:
    """Full windows, then powers of two."""
    while total:
        n = capacity if total >= capacity else 1 << (total.bit_length() - 1)
        yield n
        total -= n


class _Rows:
    """Windows on their way out, as batches of bounded bytes."""

    def __init__(self, kind: pa.DataType):
        self.member = pa.struct([("doc_id", kind), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64())])
        self.windows: list[list] = []
        self.ids: list[bytes | None] = []
        self.size = 0

    def add(self, members: list, ids: bytes | None = None) -> None:
        self.windows.append(members)
        self.ids.append(ids)
        self.size += 40 * len(members) + len(ids or b"")

    def batches(self, least: int = 1 << 22) -> Iterator[pa.RecordBatch]:
        if self.windows and self.size >= least:
            names = [f.name for f in self.member]
            rows = [[dict(zip(names, (*m, at), strict=True)) for m, at in zip(w, accumulate((m[2] for m in w), initial=0))] for w in self.windows]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(self.member)), pa.array(self.ids, pa.binary())], ["members", "ids"])
            self.windows, self.ids, self.size = [], [], 0


def _first(tokenizer: str | None, ranks: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        if tokenizer:
            encoder = _encoder(tokenizer, ranks)
        else:
            encoder = _encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
        end, levels, out = np.array([END_ID], "<u4").tobytes(), Levels(capacity), None
        for batch in batches:
            out = out or _Rows(batch.schema.field(0).type)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                total = len(ids) // 4
                for s in range(0, total, capacity):
                    part = ids[4 * s : 4 * (s + capacity)]
                    size = len(part) // 4
                    piece = [(doc, s, size, zlib.crc32(part), total)]
                    full = (piece, part) if size == capacity else levels.add(size, piece, part)
                    if full:
                        out.add(full[0])
                    if levels.open > OPEN:
                        for members, rest in levels.rest():
                            out.add(members, rest)
                yield from out.batches()
        if out:
            for members, rest in levels.rest():
                out.add(members, rest)
                yield from out.batches()
            yield from out.batches(0)

    return run


def _second(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, out = Levels(capacity), None

        def pour() -> Iterator[pa.RecordBatch]:
            rest = list(levels.rest())
            members, ids = [m for w, _ in rest for m in w], b"".join(x for _, x in rest)
            for window in cut(members, ids, sizes(len(ids) // 4, capacity)):
                out.add(window)
                yield from out.batches()

        for batch in batches:
            out = out or _Rows(batch.schema.field(0).type.value_type.field(0).type)
            for window, ids in zip(batch.column(0), batch.column(1), strict=True):
                members, ids = [tuple(m.values())[:5] for m in window.as_py()], ids.as_py()
                full = levels.add(len(ids) // 4, members, ids)
                if full:
                    out.add(full[0])
                if levels.open > OPEN:
                    yield from pour()
            yield from out.batches()
        if out:
            yield from pour()
            yield from out.batches(0)

    return run


def pack_documents(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer and ranks are paths on the executors; without them the installed tokenizer package is asked. capacity
    should be a power of two. A null text is empty, its piece being the end id alone; a null id is kept as it is;
    repeated rows are packed each; an empty table gives no rows; a text of any length leaves as whole windows and one
    last piece; other columns are ignored. A text is cut at multiples of the capacity and where its window is poured."""
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"members array<struct<doc_id:{kind},start:long,length:long,ids_crc32:long,doc_tokens:long,offset:long>>, ids binary"
    first = written(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(_first(tokenizer, ranks, capacity), shape), "windows")
    left = first.where("ids IS NOT NULL")
    tasks = max(1, -(-left.count() // LAST_ROWS))
    poured = written(left.repartition(tasks).mapInArrow(_second(capacity), shape), "windows")
    done = first.where("ids IS NULL").select("members").unionByName(poured.select("members")).withColumn("sequence_id", F.monotonically_increasing_id())
    return done.select("sequence_id", F.explode("members").alias("m")).select("m.doc_id", "m.start", "m.length", "m.ids_crc32", "m.doc_tokens", "sequence_id", "m.offset")
