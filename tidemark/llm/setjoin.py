"""What the exact set-similarity joins share: prefix keys, candidate filters and verification, as DataFrame functions.

A set is an array of 63-bit numbers in one fixed order, rare ones first. Two sets of Jaccard similarity THRESHOLD or
more share their i-th common number within the first p + i - 1 of each, p being the length of the prefix. So it is
exact to take as keys the numbers of the prefix, and where such a number is frequent its pairs with those up to place
p + 1, and where it is very frequent triples up to p + 2: which of them is used depends on the number alone, alike in
all sets. Candidates pass filters by length, by position, and by a signature: each number flips one of 128 bits, so
two sets differ in at least as many numbers as their signatures in bits. Only what is left is verified.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

NUM, DEN = 4, 5  # the threshold: 0.8
LINK_LEAST = 4  # smaller sets reach the threshold only when equal
LONG = 40  # from this size on sets have keys by shares of the hash space, see long_keys_of()
SHARE_BITS = 38
NUMBER_BITS = 31  # of the numbers that share_rows() takes
BLOCK = 12  # differences to a block of shares
LOOKED_UP = 1024  # the spans of smaller sets are looked up by size
RARITY_SHIFT = 57  # the bits above hold the rarity class
SKETCH = 3  # pairs of numbers at either end of a class under which it looks for hubs
SPLITS = (8, 10, 12)  # spans at which the ranges of sizes change that are joined one after the other
PARTS = 2 * (len(SPLITS) + 1)  # even and odd spans of each range
EXACT = 24  # smaller sets are kept whole; of others, keys settle what is not close to the threshold
BACK = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512)  # places before a class where it looks for hubs
HUBS = 2  # links to hubs that a key gives at most
HOT, VERY_HOT = 20, 36  # rarity classes from about 1,000 and 260,000 occurrences


def rarity_class(count: int) -> int:
    """Two classes for each doubling of the count, 63 at most."""
    return min(63, int(2 * (count + 1).bit_length() - (2 if (count + 1) * 2 < 3 * (1 << (count + 1).bit_length() - 1) else 1)))


def keys_of(r: Column, size: Column) -> Column:
    """array<struct<key, pos>> of a set r in its order; pos is the place of the key's last number."""
    p = size - F.floor((size * NUM + (DEN - 1)) / DEN).cast("int") + 1
    rare = lambda v: F.shiftright(v, RARITY_SHIFT)
    item = lambda key, pos: F.struct(key.alias("key"), pos.cast("int").alias("pos"))

    def triples(v, i):
        seconds = F.slice(r, i + 2, p - i)
        return F.flatten(F.transform(seconds, lambda u, j: F.transform(F.slice(r, i + j + 3, p - i - j), lambda t, k: item(F.xxhash64(v, u, t), i + j + k + 2))))

    def of(v, i):
        pairs = F.transform(F.slice(r, i + 2, p - i), lambda u, j: item(F.xxhash64(v, u), i + j + 1))
        return F.when(rare(v) < HOT, F.array(item(v, i))).when(rare(v) < VERY_HOT, pairs).otherwise(triples(v, i))

    none = F.array().cast("array<struct<key:bigint,pos:int>>")
    return F.when(size >= LINK_LEAST, F.flatten(F.transform(F.slice(r, 1, p), of))).otherwise(none)


def _bounds(least: int = LONG) -> list[int]:
    """Least sizes of the spans of sets from least on; no set and its similar ones reach over more than two of them."""
    out = [least]
    while out[-1] < 1 << 27:
        out.append(-(-out[-1] * DEN // NUM))
    return out


def long_keys_of(s: Column, size: Column) -> Column:
    """array<bigint>, keys of sets of LONG numbers or more and of those similar to them; about half as many as numbers,
    where triples of a prefix would grow with the cube. Similar sets whose larger one lies in a span of sizes differ in
    fewer numbers than the span has shares of the hash space, so one share holds the same numbers of both, be it none."""
    bounds = F.array(*[F.lit(b) for b in _bounds()])
    bound = lambda x, f: F.get(F.transform(F.array(x), f), 0)  # noqa: E731  (x is evaluated once)

    def of(u, shares):
        share = lambda x: F.shiftright(x * shares, SHARE_BITS)
        begin = F.filter(F.transform(u, lambda x, i: F.when((i == 0) | (share(x) != share(F.get(u, i - 1))), i)), lambda i: i.isNotNull())
        held = lambda b: F.transform(b, lambda i, j: F.xxhash64(shares, share(F.get(u, i)), F.slice(u, i + 1, F.coalesce(F.get(b, j + 1), F.size(u)) - i)))
        none = lambda b: F.transform(F.array_except(F.sequence(F.lit(0).cast("long"), shares - 1), F.transform(b, lambda i: share(F.get(u, i)))), lambda q: F.xxhash64(shares, q))
        return bound(begin, lambda b: F.concat(held(b), none(b)))

    def spans(n):
        """The numbers of shares in n's own span and, where similar sets reach it, the next."""
        shares = lambda i: F.floor(2 * (F.get(bounds, i + 1) - 1) / (NUM + DEN)).cast("long") + 1
        both = bound(F.size(F.filter(bounds, lambda b: b <= n)), lambda i: F.array(F.when(i > 0, shares(i - 1)), F.when(n * DEN >= F.get(bounds, i) * NUM, shares(i))))
        return F.filter(both, lambda x: x.isNotNull())

    u = F.sort_array(F.transform(s, lambda v: F.xxhash64(v).bitwiseAND(F.lit((1 << SHARE_BITS) - 1))))
    keys = bound(u, lambda v: F.flatten(F.transform(spans(F.size(v)), lambda n: of(v, n))))
    return F.when(size * DEN >= LONG * NUM, keys).otherwise(F.array().cast("array<bigint>"))


def share_rows(classes: DataFrame, part: int, *also: str) -> DataFrame:
    """classes (size, keys) to (key, *also), a row for each of their keys in a part of PARTS. keys is a sorted array<int> of
    NUMBER_BITS bits for each word, odd for rare ones; those of different words may be equal, since similar sets differ the
    less. In all there are about two keys to three words, whatever the counts of words, so no table of counts is needed.

    Similar sets of sizes m and n differ in (m + n) / 9 numbers at most. For each span of sizes up to h, of which the
    larger of them lies in one, the hash space is cut into d + 2 g + 1 shares, d being 2 h / 9 and g a number of blocks of
    neighbouring shares. Each set leaves out (h - n) / 9 of its weak shares. So 2 g + 1 shares are left that hold the same
    numbers of both, three of them in one block. A share that holds a rare number or four numbers is a key. Others are
    weak, the more so the fewer numbers they hold, and are keys by pairs within a block, those of one number or none by
    threes. So few sets meet under a key, and each key is made in one part only: a set has one even and one odd span."""
    bounds = _bounds(LINK_LEAST + 1)
    lows, highs = F.array(*[F.lit(b) for b in bounds[:-1]]), F.array(*[F.lit(b - 1) for b in bounds[1:]])
    of_size = F.array(*[F.lit(sum(b <= n for b in bounds) - 1) for n in range(LOOKED_UP)])
    size, span, high = F.col("_size"), F.col("_span"), F.col("_high")
    df = classes.select("keys", *also, F.size("keys").alias("_size"))
    df = df.withColumn("_own", F.when(size < LOOKED_UP, F.get(of_size, size)).otherwise(F.size(F.filter(lows, lambda b: b <= size)) - 1))
    df = df.withColumn("_span", F.col("_own") + (F.col("_own") + part % 2).bitwiseAND(F.lit(1)))
    reached = (size >= LINK_LEAST) & ((span == F.col("_own")) | (size * DEN >= F.get(lows, span) * NUM))
    begin, end = [(0, *SPLITS, len(bounds))[part // 2 + k] for k in (0, 1)]
    df = df.where(reached & (span >= begin) & (span < end)).withColumn("_high", F.get(highs, span))
    df = df.withColumn("_d", F.floor(high * 2 / (NUM + DEN)).cast("int")).withColumn("_g", F.floor(F.col("_d") / BLOCK).cast("int") + 1)
    plan = F.struct((F.col("_d") + 2 * F.col("_g") + 1).cast("long").alias("shares"), F.col("_g").cast("long").alias("blocks"), F.floor((high - size) / (NUM + DEN)).cast("int").alias("spare"))
    # The outer explode: Spark would else evaluate the plan anew for every number.
    df = df.select("keys", *also, "_size", F.explode_outer(F.array(plan)).alias("_plan"))
    shares, blocks, spare = (F.col(f"_plan.{c}") for c in ("shares", "blocks", "spare"))
    e, held, marks, weak, w = (F.col(c) for c in ("_e", "_held", "_marks", "_weak", "_w"))
    one, none = F.lit(1).cast("long"), F.array().cast("array<bigint>")
    df = df.withColumn("_e", F.transform("keys", lambda v: F.shiftright(v * shares, NUMBER_BITS))).withColumn("_held", F.array_distinct(e))
    # The share itself where it is a key, and less than zero where it holds two numbers.
    df = df.withColumn("_marks", F.transform(e, lambda q, i: F.when((F.get("keys", i).bitwiseAND(F.lit(1)) == 1) | (F.get(e, i + 3) == q), q).when(F.get(e, i + 1) == q, -1 - q)))
    left = F.concat(F.array_except(F.sequence(F.lit(0).cast("long"), shares - 1), held), F.array_except(held, marks))
    df = df.withColumn("_weak", F.sort_array(F.slice(left, spare + 1, F.greatest("_size", shares.cast("int")))))
    # Twice the share, and one more where it holds more than one number.
    df = df.withColumn("_w", F.when(F.size(weak) > 1, F.transform(weak, lambda q: F.shiftleft(q, 1).bitwiseOR(F.coalesce(F.array_contains(marks, -1 - q), F.lit(False)).cast("long")))).otherwise(none))
    place = lambda x: F.shiftright(x, 1)
    block = lambda x: F.floor(place(x) * blocks / shares)
    together = lambda x, y: (blocks == 1) | (block(x) == block(y))
    near = lambda l, i: F.slice(l, i + 2, BLOCK + 3)
    # A unit is one share or up to three of a block: the number of the first, and the distances of the others in five bits each.
    pair = lambda a, b: F.shiftleft(place(a), 10).bitwiseOR(F.shiftleft(place(b) - place(a), 5))
    pairs = F.flatten(F.transform(w, lambda a, i: F.transform(F.filter(near(w, i), lambda b: (a.bitwiseOR(b).bitwiseAND(one) == 1) & together(a, b)), lambda b: pair(a, b))))
    threes = lambda z: F.flatten(F.transform(z, lambda a, i: F.flatten(F.transform(near(z, i), lambda b, j: F.transform(F.filter(near(z, i + j + 1), lambda c: together(a, c)), lambda c: pair(a, b).bitwiseOR(place(c) - place(a)))))))
    tiny = F.filter(w, lambda x: x.bitwiseAND(one) == 0)
    few = F.when(F.size(w) > 1, F.concat(pairs, F.get(F.transform(F.array(tiny), lambda z: F.when(F.size(z) > 2, threes(z)).otherwise(none)), 0))).otherwise(none)
    units = F.concat(F.transform(F.array_intersect(held, marks), lambda q: F.shiftleft(q, 10)), few)
    rows = df.select("keys", *also, "_size", "_e", "_held", shares.alias("_shares"), F.explode(units).alias("_unit"))
    bits = lambda n: F.shiftright("_unit", n).bitwiseAND(F.lit(31).cast("long"))
    rows = rows.withColumns({"_a": F.shiftright("_unit", 10), "_b": bits(5), "_c": bits(0)})

    def content(q):
        begin = F.array_position(e, q)
        end = F.coalesce(F.array_position(e, F.get(held, F.array_position(held, q).cast("int"))), size + 1)
        return F.when(begin > 0, F.slice("keys", begin.cast("int"), (end - begin).cast("int")))

    other = lambda c: F.when(F.col(c) > 0, F.xxhash64(F.col(c), content(F.col("_a") + F.col(c))))
    # 32 bits: keys that meet by chance give some more comparisons and no links.
    return rows.select(F.shiftright(F.xxhash64("_shares", "_a", content(F.col("_a")), other("_b"), other("_c")), 32).cast("int").alias("key"), *also)


def signature(s: Column) -> tuple[Column, Column]:
    seventh = lambda v: F.shiftrightunsigned(v, 6).bitwiseAND(F.lit(1).cast("long"))

    def half(bit) -> Column:
        return F.aggregate(s, F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(F.call_function("shiftleft", bit(v), v.bitwiseAND(F.lit(63)).cast("int"))))

    return half(seventh), half(lambda v: seventh(v).bitwiseXOR(F.lit(1).cast("long")))


def key_rows(classes: DataFrame, *also: str) -> DataFrame:
    """classes (cid, size, b1, b2, keys) to a row per key."""
    return classes.select("cid", "size", "b1", "b2", *also, F.explode("keys").alias("k")).select("k.key", "k.pos", "cid", "size", "b1", "b2", *also)


def most_apart(m: Column, n: Column) -> Column:
    """The most numbers in which sets of m and n numbers can differ and still reach the threshold."""
    return m + n - 2 * F.ceil((m + n) * NUM / (NUM + DEN))


def close(x: Callable[[str], Column], y: Callable[[str], Column], placed: bool = True) -> Column:
    """Whether two key rows, given as columns by name, can be similar; placed if they hold the places of their keys."""
    need = F.ceil((x("size") + y("size")) * NUM / (NUM + DEN))
    fits = (x("size") * DEN >= y("size") * NUM) & (y("size") * DEN >= x("size") * NUM)
    if placed:
        fits = fits & (F.least(x("pos"), y("pos")) + F.least(x("size") - x("pos"), y("size") - y("pos")) >= need)
    apart = F.bit_count(x("b1").bitwiseXOR(y("b1"))) + F.bit_count(x("b2").bitwiseXOR(y("b2")))
    return fits & (apart <= most_apart(x("size"), y("size")))


def candidates(left: DataFrame, right: DataFrame, also: Column | None = None) -> DataFrame:
    """(a, b) with a < b, distinct: classes that share a key of left and right (aliased x and y) and pass the filters;
    where left and right are one table, a comes from x."""
    order = F.col("x.cid") < F.col("y.cid") if left is right else F.col("x.cid") != F.col("y.cid")
    on = (F.col("x.key") == F.col("y.key")) & order & close(lambda n: F.col(f"x.{n}"), lambda n: F.col(f"y.{n}"))
    if also is not None:
        on = on & also
    return left.alias("x").join(right.alias("y"), on).select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()


def _near(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    """close() without places, in whole numbers: most_apart() is a ninth of both sizes or one less, and bits and sizes are
    even or odd alike."""
    apart = F.bit_count(x("b1").bitwiseXOR(y("b1"))) + F.bit_count(x("b2").bitwiseXOR(y("b2")))
    return (apart * (NUM + DEN) <= x("size") + y("size")) & (x("size") * DEN >= y("size") * NUM) & (y("size") * DEN >= x("size") * NUM)


def hub_candidates(classes: DataFrame) -> DataFrame:
    """(a, b) with a before b by first, distinct: of the classes before it each is compared, under each of SKETCH pairs of neighbours at
    either end of its sorted numbers, with the first two and those BACK places before it, and meets the first HUBS of them
    that can be similar. The numbers are hashes, so similar classes are likely to have such a pair in common. Hubs are
    spread over the whole of a large group, so that few of its classes find none. Nothing is lost where they do:
    later_candidates() looks under all keys."""
    w = Window.partitionBy("key").orderBy("first")
    row = F.struct("cid", "size", "b1", "b2")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    hubs = F.array(F.first(row).over(before), F.nth_value(row, 2).over(before), *[F.lag(row, n).over(w) for n in BACK])
    ends = [F.xxhash64(F.lit(i), F.try_element_at("keys", F.lit(i)), F.try_element_at("keys", F.lit(i + i // abs(i)))) for k in range(SKETCH) for i in (2 * k + 1, -2 * k - 1)]
    rows = classes.where(F.size("keys") >= LINK_LEAST).select(F.explode(F.array_distinct(F.array(*ends))).alias("key"), "cid", "first", "size", "b1", "b2")
    placed = rows.select("*", hubs.alias("hubs"))
    met = F.filter("hubs", lambda h: h.isNotNull() & _near(lambda n: h[n], F.col))
    # Most rows are the first of their key.
    near = F.when(F.get("hubs", 0).isNotNull(), F.slice(F.array_distinct(F.transform(met, lambda h: h["cid"])), 1, HUBS))
    return placed.select(F.explode(near).alias("a"), F.col("cid").alias("b")).distinct()


def signed(classes: DataFrame, gone: DataFrame) -> DataFrame:
    """classes for later_candidates(): the size of those in gone is negative."""
    out = gone.select(F.col("gone").alias("cid"), F.lit(True).alias("out"))
    return classes.join(out, "cid", "left").select("cid", F.when(F.col("out"), -F.col("size")).otherwise(F.col("size")).alias("size"), "b1", "b2", "first", "keys", "exact")


def later_candidates(classes: DataFrame, part: int) -> DataFrame:
    """(a, b) with a before b by first, distinct, for the classes b that are not gone: all others before them that share a key of this
    part of PARTS. Both sides are the same rows, so that Spark shuffles them once: what is gone is told by a negative size,
    which fits no class as a b, and not by a filter of one side."""
    rows = share_rows(classes, part, "cid", "first", "size", "b1", "b2")
    whole = lambda n: F.abs("x.size") if n == "size" else F.col(f"x.{n}")
    fits = (F.col("x.first") < F.col("y.first")) & _near(whole, lambda n: F.col(f"y.{n}"))
    return rows.alias("x").join(rows.alias("y"), (F.col("x.key") == F.col("y.key")) & fits).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()


def judged(classes: DataFrame, cand: DataFrame) -> DataFrame:
    """The candidates (a, b) that can be similar, and whether it is sure, told by exact of both classes, which holds sets
    smaller than EXACT, or else by keys. Words with equal keys that differ, about one in a million pairs of sets, can't make
    up for the numbers that are asked for besides."""
    of = lambda n: classes.select(F.col("cid").alias(n), F.col("keys").alias(f"k{n}"), F.col("exact").alias(f"e{n}"))
    m, n = F.size("ka"), F.size("kb")
    need = F.floor(((m + n) * NUM + NUM + DEN - 1) / (NUM + DEN))
    whole, common = (m < EXACT) & (n < EXACT), F.size(F.array_intersect("ka", "kb"))
    lost = m - F.size(F.array_distinct("ka"))
    both = cand.join(of("a"), "a").join(of("b"), "b").select("a", "b", (common - need).alias("over"), lost.alias("lost"), (F.greatest(m, n)).alias("most"), F.when(whole, F.size(F.array_intersect("ea", "eb")) >= need).alias("told"))
    sure = (F.col("most") < 500) & (F.col("over") >= F.when(F.col("most") < 64, 1).otherwise(2))
    return written(both.where(F.coalesce("told", F.col("over") + F.col("lost") >= 0)).select("a", "b", F.coalesce("told", sure).alias("sure")), "judged")


def similar(sets: DataFrame, cand: DataFrame) -> DataFrame:
    """The candidates (a, b) whose sets (cid, s) reach the threshold."""
    both = cand.join(sets.select(F.col("cid").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("cid").alias("b"), F.col("s").alias("sb")), "b")
    return written(both.where(F.size(F.array_intersect("sa", "sb")) * (NUM + DEN) >= (F.size("sa") + F.size("sb")) * NUM).select("a", "b"), "pairs")
