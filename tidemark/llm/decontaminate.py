"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Words become lower case without punctuation; numbers, units after numbers, and names (capitalised words that do not
begin a sentence, a run of them as one) become typed placeholders. Windows of eight template words are hash-joined
with the benchmark's, and so are windows of the plain lower-case words, which find copies in any case of letters; items
shorter than a window are sought by windows of their own length. Along one alignment of a document with an item the
slots of windows with new values must be consistent: a value of the item always stands for the same value of the
document. A question asked anew with other numbers or names is so found as well as a copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW = 8
BLOCK = 4  # 2 * BLOCK - 1 <= WINDOW
MIN_LITERALS = 3
MIN_WINDOWS = 4
MIN_SHARE = 50  # per cent of an item's windows that suffices below MIN_WINDOWS
BROADCAST_ROWS = 2_000_000
#: Characters taken off both ends of a word. Fixed values.
PUNCTUATION = "!\"#$&'()*+,-./:;<=>?@[\\]^_`{|}~“”„‟‘’‚‛«»‹›–—―…·•¿¡§¶†‡°′″"


def _class(chars: str) -> str:
    """A pattern of one of chars that tells letters apart in few steps: Java tests each character beyond Latin-1 of a
    class by itself, so they are named by their range less its others."""
    code = lambda c: f"\\x{{{c:x}}}"
    high = {ord(c) for c in chars if c > "\xff"}
    others = "".join(code(c) for c in range(min(high), max(high)) if c not in high)
    return f"[{''.join(code(ord(c)) for c in chars if c <= chr(255))}[{code(min(high))}-{code(max(high))}&&[^{others}]]]"


#: Spaces that are not one blank; runs of punctuation at either end of words that one blank divides, others as group 1.
_SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
_ENDS = "(?<![^ ])P++|P++(?![^ ])|(P{2,}+)".replace("P", _class(PUNCTUATION))
#: Marks of slots, their ends and of the next word; _NAME begins a name.
_NEXT, _SLOT, _END = "\x01", "\x02", "\x04"
_NAME = f"<p>{_SLOT}"
#: Units that follow a number. Fixed values.
UNITS = ("%", "mm", "cm", "m", "km", "g", "kg", "mg", "ml", "l", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months", "years", "miles", "feet", "inches", "dollars", "euros", "usd", "eur", "meters", "metres", "pounds", "degrees")


def _sequences(df: DataFrame, id_col: str, text_col: str, out: str, slots: bool = True) -> DataFrame:
    """(out, x, r): x has the words of each text, a run of names as one, with their template hash k (of the lower-case
    word or its placeholder), whether they are a slot, and the hashed value v; r has the hashes of the lower-case words
    alone. Without slots x has the template hashes only. What can be done to a whole text by one pattern is not done to
    its words, and cheap comparisons stand before each pattern, since this sees every word."""
    # One blank between words, so that the words of both texts, of which b has no punctuation at their ends, lie alike.
    t = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), _SPACES, " "))
    df = df.select(F.col(id_col).alias(out), t.alias("t")).withColumn("u", F.regexp_replace("t", _ENDS, "$1"))
    df = df.select(out, F.split("t", " ").alias("w"), F.split("u", " ").alias("b"), F.split(F.lower("u"), " ").alias("l"))
    w, b, low = F.col("w"), F.col("b"), F.col("l")
    number = lambda x: (x >= "0") & (x < ":") & x.rlike(r"^[0-9][0-9.,]*%?$")
    units = F.array(*[F.lit(u) for u in UNITS])

    def item(x, i):
        y = F.get(low, i)
        name = (x != y) & x.rlike(r"^\p{Lu}") & (i > 0) & ~F.coalesce(F.get(w, i - 1).rlike(r"[.!?:][^\p{L}\p{N}]*$"), F.lit(True))
        unit = F.coalesce(number(F.get(b, i - 1)), F.lit(False)) & F.array_contains(units, y)
        as_slot = F.when(number(x), F.concat(F.lit(f"<n>{_SLOT}"), x)).when(unit, F.concat(F.lit(f"<u>{_SLOT}"), y)).when(name, F.concat(F.lit(_NAME), y, F.lit(_END)))
        return F.when(x != "", F.coalesce(as_slot, y))

    # Neighbouring names are joined in the text of all marked words, which takes one pass. array_join() leaves nulls out.
    one = F.replace(F.array_join(F.transform(b, item), _NEXT), F.lit(_END + _NEXT + _NAME), F.lit(" "))
    raw = F.transform(F.array_remove(low, ""), lambda x: F.xxhash64(x))
    df = df.select(out, one.alias("one"), raw.alias("r"))
    df = df.select(out, "r", F.when(F.col("one") != "", F.split("one", _NEXT)).otherwise(F.array().cast("array<string>")).alias("one"))
    slot = lambda y: (y >= "<") & (y < "=") & (F.substring(y, 4, 1) == _SLOT)
    k = lambda y: F.xxhash64(F.when(slot(y), F.substring(y, 1, 3)).otherwise(y))
    if not slots:
        return df.select(out, F.transform("one", k).alias("x"), "r")
    return df.select(out, F.transform("one", lambda y: F.struct(k(y).alias("k"), slot(y).alias("slot"), F.xxhash64(y).alias("v"))).alias("x"), "r")


def _cut(seq, of, lengths: list[int] | None):
    """of(start, length) for every window of the array seq: of each of the lengths; with None, of WINDOW words or, in a
    shorter text, of all its words."""
    n = F.size(seq)
    none = F.array().cast("array<int>")
    if lengths is None:
        return F.transform(F.when(n >= WINDOW, F.sequence(F.lit(1), n - WINDOW + 1)).when(n > 0, F.array(F.lit(1))).otherwise(none), lambda i: of(i, WINDOW))

    def each(size):
        return F.transform(F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(none), lambda i: of(i, size))

    return F.concat(*[each(size) for size in lengths])


def block_hashes(df: DataFrame, id_col: str, text_col: str, out: str, short: tuple[list[int], list[int]], step: int = BLOCK) -> DataFrame:
    """(out, h) of the blocks of BLOCK words at every step-th word, of templates and of plain words, and of all windows of
    the short lengths. Every window of WINDOW words holds one whole block of those at every BLOCK-th word, so a document
    that shares no block with any block of the benchmark shares no window: this is all that it ever costs."""
    df = _sequences(df, id_col, text_col, out, False).withColumnRenamed("x", "k")

    def hashes(c, lengths):
        seq = F.col(c)
        starts = F.when(F.size(seq) >= BLOCK, F.sequence(F.lit(1), F.size(seq) - BLOCK + 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        blocks = F.transform(starts, lambda i: F.xxhash64(F.slice(seq, i, BLOCK)))
        return F.concat(blocks, _cut(seq, lambda i, size: F.xxhash64(F.slice(seq, i, size)), lengths)) if lengths else blocks

    return df.select(out, F.explode_outer(F.concat(*[hashes(c, at) for c, at in zip(("k", "r"), short, strict=True)])).alias("h"))


def templates(df: DataFrame, id_col: str, text_col: str, out: str, lengths: tuple[list[int] | None, list[int] | None] = (None, None)) -> DataFrame:
    """(out, plain, pos, h, slots, size) per window that has enough literal words, of templates and of plain lower-case
    words. slots are the hashed values of the window's placeholders, in order; plain windows have none."""
    df = _sequences(df, id_col, text_col, out)

    def template(i, size):
        part = F.slice("x", i, size)
        return F.struct(
            F.lit(False).alias("plain"),
            i.alias("pos"),
            F.xxhash64(F.transform(part, lambda y: y["k"])).alias("h"),
            F.transform(F.filter(part, lambda y: y["slot"]), lambda y: y["v"]).alias("slots"),
            F.size(F.filter(part, lambda y: ~y["slot"])).alias("lit"),
            F.size(part).alias("size"),
        )

    def plain(i, size):
        part = F.slice("r", i, size)
        return F.struct(F.lit(True).alias("plain"), i.alias("pos"), F.xxhash64(part).alias("h"), F.array().cast("array<bigint>").alias("slots"), F.size(part).alias("lit"), F.size(part).alias("size"))

    # The outer form: Spark infers no filter from it, which would evaluate all of the above again per window.
    both = F.concat(_cut(F.col("x"), template, lengths[0]), _cut(F.col("r"), plain, lengths[1]))
    return df.select(out, F.explode_outer(both).alias("z")).where(F.col("z.lit") >= MIN_LITERALS).select(out, "z.plain", "z.pos", "z.h", "z.slots", "z.size")


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc, item, windows, share): contaminated pairs, once per alignment of templates and once for plain words. A
    first pass over all documents computes hashes of blocks alone; only documents that share one with the benchmark are
    aligned."""
    bench = written(templates(benchmark.select(item_col, item_text).distinct(), item_col, item_text, "item"), "bench")
    short = {(r["plain"], r["size"]) for r in bench.where(F.col("size") < WINDOW).select("plain", "size").distinct().collect()}
    lengths = tuple([WINDOW, *sorted(n for p, n in short if p == plain)] for plain in (False, True))
    bench = bench.drop("size").withColumnsRenamed({"pos": "ipos", "slots": "islots"})
    small = bench.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    held = F.broadcast if small else lambda df: df
    sizes = bench.groupBy("item", "plain").agg(F.countDistinct("ipos").alias("n")).withColumnsRenamed({"item": "si", "plain": "sp"})
    # Windows of the short lengths are sought among the benchmark's windows, blocks among its blocks.
    blocks = block_hashes(benchmark, item_col, item_text, "item", ([], []), 1).select("h").unionByName(bench.select("h")).where("h IS NOT NULL")
    meets = block_hashes(docs, id_col, text_col, "_met", tuple(n[1:] for n in lengths)).join(held(blocks.distinct()), "h", "left_semi")
    met = written(meets.select("_met").distinct(), "met")
    near = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(met, F.col("_id").eqNullSafe(F.col("_met")), "left_semi")
    seen = templates(near, "_id", "_text", "doc", lengths)
    # Plain windows have no slots and need no alignment: those of both sides of an insertion add up.
    diag = F.when(~F.col("plain"), F.col("pos") - F.col("ipos")).otherwise(0)
    hit = written(seen.join(held(bench), ["h", "plain"]).withColumn("diag", diag).withColumn("changed", F.col("slots") != F.col("islots")), "hits")
    key = ["doc", "item", "diag"]
    # Slots: in windows with new values, each value of the item must stand for one value along the alignment. Where it
    # does not, those windows go; the others of the alignment stay.
    pairs = hit.where("changed").select(*key, F.explode(F.arrays_zip(F.col("islots").alias("i"), F.col("slots").alias("d"))).alias("p"))
    bad = pairs.groupBy(*key, F.col("p.i").alias("i")).agg(F.min("p.d").alias("lo"), F.max("p.d").alias("hi")).where("lo <> hi").select(*key).distinct()
    bad = bad.withColumnsRenamed({"doc": "bd", "item": "bi", "diag": "bg"})
    good = hit.join(bad, F.col("changed") & F.col("doc").eqNullSafe(F.col("bd")) & F.col("item").eqNullSafe(F.col("bi")) & (F.col("diag") == F.col("bg")), "left_anti")
    good = good.groupBy(*key, "plain").agg(F.countDistinct("ipos").alias("windows"))
    good = good.join(held(sizes), F.col("item").eqNullSafe(F.col("si")) & (F.col("plain") == F.col("sp")))
    return good.where((F.col("windows") >= MIN_WINDOWS) | (100 * F.col("windows") >= MIN_SHARE * F.col("n"))).select("doc", "item", "windows", (F.col("windows") / F.col("n")).alias("share"))


def flag(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with contaminated, item_ids, leak_windows and leak_share. Null and empty texts match nothing; rows with
    one id count as one document; columns named like the new ones are replaced."""
    per = matches(docs, benchmark, id_col, text_col, item_col, item_text).groupBy("doc").agg(F.array_sort(F.collect_set("item")).alias("item_ids"), F.max("windows").alias("leak_windows"), F.max("share").alias("leak_share"))
    out = docs.drop("contaminated", "item_ids", "leak_windows", "leak_share").join(per.withColumnRenamed("doc", "_doc"), F.col(id_col).eqNullSafe(F.col("_doc")), "left")
    return out.withColumns({
        "contaminated": F.col("leak_windows").isNotNull(),
        "item_ids": F.coalesce("item_ids", F.array().cast(per.schema["item_ids"].dataType)),
        "leak_windows": F.coalesce("leak_windows", F.lit(0)).cast("long"),
        "leak_share": F.coalesce("leak_share", F.lit(0.0)),
    }).drop("_doc")
