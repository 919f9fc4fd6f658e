"""Near-duplicate lines: an exact set-similarity join over lines, with DataFrame functions only.

A line is the set of its lower-cased words as hashes of 63 bits. Lines with equal sets form a class, held by a hash of 128
bits, and classes are joined by setjoin.py. Its keys are shares of the hash space and need no counts of words. They are
made from the upper half of the hashes, which also settles all candidates but those close to the threshold; for these the
sets are read again from their documents.

A line goes for one earlier similar line, so not all pairs of a large group of similar lines are needed: each class is
first compared with the earliest two and the nearest two before it under a few pairs of its numbers, and only classes that
found none there are compared with all before them, under all keys. Rows of keys are the bulk of the work: they are never
written, only shuffled, one part of the keys after the other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import setjoin
from .common import discard, release, written

MIN_WORDS = 5  # by default; the queries take every line with a word
RARE = 6  # bytes
FLAG = 63 - setjoin.NUMBER_BITS  # of the numbers, the lowest bit of those that make keys
_FROM, _TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: Column) -> Column:
    """A to Z in lower case. translate() takes its time with every letter, so it is left to texts where lower() would
    change other letters as well."""
    plain = (F.length(text) == F.octet_length(text)) | ~text.rlike(r"[\p{Lu}\p{Lt}&&[^A-Z]]")
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _FROM, _TO))


def _words(text: Column) -> Column:
    """Its lower-cased words. Splitting at one character needs no pattern."""
    text = _lower(text)
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _rarity(docs: DataFrame, text_col: str) -> Column:
    """The least length in bytes of words that count as rare. Any measure that all lines share is exact, and this one
    needs no count, so docs is not read."""
    return F.lit(RARE)


def _set(line: Column, table: Column) -> Column:
    """The line's words as sorted hashes of 63 bits, of which bit FLAG tells the rare ones."""
    h = lambda w: F.shiftrightunsigned(F.xxhash64(w), 1)
    number = lambda w: F.when(F.octet_length(w) >= table, h(w).bitwiseOR(F.lit(1 << FLAG))).otherwise(h(w).bitwiseAND(F.lit(~(1 << FLAG))))
    return F.sort_array(F.array_distinct(F.transform(_words(line), number)))


def _classes(docs: DataFrame, table: Column, least: int) -> DataFrame:
    """docs (id, t, text) to (first, size, b1, b2, keys, exact), one row for each set of words. keys are the upper bits of
    the numbers, from which setjoin.py makes keys when it needs them: all keys together would take more room. exact has the
    numbers of small sets."""
    cut = docs.select("id", "t", F.posexplode(F.split("text", "\n")).alias("n", "l"))
    # The outer forms: Spark infers no filter from them, which would evaluate the sets again.
    sets = cut.select("id", "t", "n", F.explode_outer(F.array(_set(F.col("l"), table))).alias("s")).where(F.size("s") >= least)
    b1, b2 = setjoin.signature(F.col("s"))
    full = sets.select("id", "t", "n", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(7), F.col("s")).alias("h2"), F.size("s").alias("size"), b1.alias("b1"), b2.alias("b2"), F.transform("s", lambda v: F.shiftright(v, FLAG).cast("int")).alias("keys"), F.when(F.size("s") < setjoin.EXACT, F.col("s")).otherwise(F.array().cast("array<bigint>")).alias("exact"))
    return full.groupBy("h1", "h2").agg(F.min(F.struct("id", "t", "n")).alias("first"), *[F.first(c).alias(c) for c in ("size", "b1", "b2", "keys", "exact")]).drop("h1", "h2")


def _sets_of(docs: DataFrame, firsts: DataFrame, table: Column) -> DataFrame:
    """(cid, s) of the classes firsts (cid, first), read from the documents of their first lines."""
    spots = written(firsts.groupBy(F.col("first.id").alias("_id"), F.col("first.t").alias("_t")).agg(F.collect_list(F.struct(F.col("first.n").alias("n"), "cid")).alias("spots")), "spots")
    met = docs.join(spots, F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))).dropDuplicates(["id", "t"])
    picked = met.select(F.explode("spots").alias("x"), F.split("text", "\n").alias("ls")).select("x.cid", F.element_at("ls", F.col("x.n") + 1).alias("l"))
    return written(picked.select("cid", _set(F.col("l"), table).alias("s")), "sets")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """docs with text_col less its repeated lines, and n_lines, n_removed and n_similar as new columns.

    A line goes if a line before it (smaller id, or same id and higher up) has a similarity of 0.8 or more, both
    judged on the input. Lines of fewer than least different words stay, so with 1 only blank ones. n_similar counts
    those that go for a similar line although no line before them has the same words. Null and empty texts stay as they
    are. Rows equal in id and text are one document and fare alike; rows with one id but different texts are told apart, in
    the order of a hash of the text; rows with a null id come first. Other columns pass through; those named like new
    ones are replaced."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.coalesce(text_col, F.lit("")).alias("text"))
    table = _rarity(docs, text_col)
    # Classes are told by a number and ordered by their first lines. They are not sorted: that would write them twice.
    classes = written(_classes(src, table, least).select(F.monotonically_increasing_id().alias("cid"), "*"), "classes")
    release(spark)
    firsts = written(classes.select("cid", "first"), "firsts")

    def judged(of: DataFrame, parts: list[DataFrame]) -> DataFrame:
        """The candidates (a, b) that can be similar, and whether it is sure."""
        found = []
        for part in parts:
            found.append(written(part, "candidates"))
            release(spark)
        out = setjoin.judged(of, reduce(DataFrame.unionByName, found).distinct())
        for df in (of, *found):
            discard(df)
        release(spark)
        return out

    gone = lambda pairs: pairs.select(F.col("b").alias("gone")).distinct()
    hubs = written(setjoin.hub_candidates(classes), "candidates")
    release(spark)
    met = setjoin.judged(classes, hubs)
    near = written(gone(met.where("sure")), "gone")
    release(spark)
    signed = written(setjoin.signed(classes, near), "signed")
    for df in (classes, hubs, met):
        discard(df)
    release(spark)
    met = judged(signed, [setjoin.later_candidates(signed, part) for part in range(setjoin.PARTS)])
    # Texts are read again for what keys leave open only.
    sure = written(gone(met.where("sure")), "gone")
    left = written(met.where("NOT sure").select("a", "b").join(sure, F.col("b") == F.col("gone"), "left_anti"), "candidates")
    discard(met)
    sets = _sets_of(src, firsts.join(left.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "cid"), table)
    close = written(gone(setjoin.similar(sets, left)), "gone")
    for df in (sets, left):
        discard(df)
    release(spark)
    rest = sure.unionByName(close)
    led = firsts.join(near.unionByName(rest), F.col("cid") == F.col("gone"), "left").withColumn("gone", F.col("gone").isNotNull())
    kept = led.groupBy(F.col("first.id").alias("_id"), F.col("first.t").alias("_t")).agg(F.collect_list(F.when(~F.col("gone"), F.col("first.n"))).alias("_kept"), F.count_if("gone").alias("n_similar"))
    kept = written(kept, "kept")
    discard(firsts)
    release(spark)
    df = docs.drop("n_lines", "n_removed", "n_similar").withColumn("_t", F.xxhash64(text_col)).withColumn("_lines", F.split(text_col, "\n"))
    df = df.join(kept.withColumnRenamed("_t", "_u"), F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_u")), "left")
    # Kept places are looked up by number: one text may have very many lines.
    short = lambda l: F.size(F.array_distinct(_words(l))) < least if least > 1 else ~l.rlike(r"[^\x20\x09-\x0D]")
    numbered = F.filter(F.transform("_lines", lambda l, i: F.when(short(l), i)), lambda i: i.isNotNull())
    df = df.withColumn("_stay", F.sort_array(F.array_union(F.coalesce("_kept", F.array().cast("array<int>")), numbered)))
    df = df.withColumn("_left", F.when(F.size("_stay") == F.size("_lines"), F.col("_lines")).otherwise(F.transform("_stay", lambda i: F.get(F.col("_lines"), i))))
    return df.withColumns({
        text_col: F.when(F.col(text_col).isNotNull(), F.array_join("_left", "\n")),
        "n_lines": F.greatest(F.coalesce(F.size("_lines"), F.lit(0)), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.size("_lines") - F.size("_left"), F.lit(0)).cast("long"),
        "n_similar": F.coalesce("n_similar", F.lit(0)).cast("long"),
    }).drop("_kept", "_left", "_lines", "_stay", "_id", "_t", "_u")
