"""Calibrators of probabilities: isotonic pools, Platt's logistic, the switch between them, and their walk-forward use.

All take points (keys, p, n, positives): a row, or many rows of one probability counted together."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-6


def _clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def sigmoid(x: Column) -> Column:
    """Without overflow at either end."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def logit(p: Column, epsilon: float = EPSILON) -> Column:
    q = F.least(F.greatest(p, F.lit(epsilon)), F.lit(1 - epsilon))
    return F.log(q / (1 - q))


def _pooled(keys: int):
    """Adjacent violators of sorted points (keys, lower, upper, n, positives), each key's stack carried from batch to
    batch. Means are compared as fractions of whole numbers; pools of equal mean are one pool."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stack, schema, out = None, [], None, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            schema = schema or pa.schema([*batch.schema][: keys + 4])
            for row in zip(*(c.to_pylist() for c in batch.columns[: keys + 4]), strict=True):
                if row[:keys] != key:
                    out += [(*key, *x) for x in stack] if stack else []
                    key, stack = row[:keys], []
                low, high, n, s = row[keys:]
                while stack and stack[-1][3] * n >= s * stack[-1][2]:
                    low, _, m, t = stack.pop()
                    n, s = n + m, s + t
                stack.append((low, high, n, s))
            if len(out) > 20_000:
                yield made()
                out = []
        out += [(*key, *x) for x in stack] if stack else []
        if out:
            yield made()

    return run


def isotonic(points: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The pools of the isotonic fit of each key: (keys, lower, upper, n, positives, value), those of the sequential
    algorithm with pools of equal value made one. Points of equal p are taken in the given order, in none as one point.

    Ranges of (key, p) are pooled where they lie, then the pools, of which there are far fewer than points, are pooled
    again in order: a pool is only ever merged with its neighbours, so this equals one pass. A hot key is dealt over
    many ranges. Points without p or count take no part."""
    src = points.where("p IS NOT NULL AND n > 0").select(*keys, F.col("p").cast("double").alias("p"), *(order or []), F.col("n").cast("long").alias("n"), F.col("positives").cast("long").alias("positives"))
    if not order:
        src = src.groupBy(*keys, "p").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))
    by = [*keys, "p", *(order or [])]
    shape = ", ".join([*(f"{k} {src.schema[k].dataType.simpleString()}" for k in keys), "lower double", "upper double", "n long", "positives long"])
    sent = src.repartitionByRange(*by).sortWithinPartitions(*by).select(*keys, F.col("p").alias("lower"), F.col("p").alias("upper"), "n", "positives")
    # Where a range ends between points of one p, the pools on both sides begin at it; the range's number orders them.
    local = sent.mapInArrow(_pooled(len(keys)), shape).withColumn("part", F.monotonically_increasing_id())
    again = local.repartition(*keys) if keys else local.repartition(1)
    pools = again.sortWithinPartitions(*keys, "part").select(*keys, "lower", "upper", "n", "positives").mapInArrow(_pooled(len(keys)), shape)
    return pools.withColumn("value", F.col("positives") / F.col("n"))


def predict_isotonic(asked: DataFrame, pools: DataFrame, keys: list[str]) -> DataFrame:
    """asked (keys, p, different ones) with value: that of the first pool with p up to its end, beyond all that of the
    last; null for keys without pools. One sort per key from the largest p down, no pairs of points and pools."""
    marks = pools.select(*keys, F.lit(None).cast("double").alias("p"), _clamp(F.col("upper")).alias("x"), F.lit(1).alias("side"), _clamp(F.col("value")).alias("value"))
    points = asked.select(*keys, "p", _clamp(F.col("p")).alias("x"), F.lit(0).alias("side"), F.lit(None).cast("double").alias("value"))
    w = Window.partitionBy(*keys).orderBy(F.desc("x"), F.desc("side"), F.desc("value"))
    both = marks.unionByName(points).withColumn("found", F.last("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # Points above every pool come before all marks and take the largest value.
    return both.withColumn("most", F.max("value").over(Window.partitionBy(*keys))).where("side = 0").select(*keys, "p", F.coalesce("found", "most").alias("value"))


def platt(points: DataFrame, keys: list[str], iterations: int = 80, rate: float = 0.2, l2: float = 1e-3) -> DataFrame:
    """Slope and intercept per key from so many gradient steps, all taken within one aggregation: points of equal p are
    counted together first, so a key's row is as long as it has different probabilities."""
    x = logit(F.col("p").cast("double"))
    same = points.where("p IS NOT NULL AND n > 0").groupBy(*keys, x.alias("x")).agg(F.sum("n").cast("double").alias("n"), F.sum("positives").cast("double").alias("s"))
    per = same.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x", "n", "s"))).alias("l"), F.sum("n").alias("total"))

    def step(at: Column, _: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
        miss = lambda e: e["n"] * sigmoid(at["slope"] * e["x"] + at["intercept"]) - e["s"]
        g = F.aggregate("l", zero, lambda a, e: F.struct((a["a"] + miss(e) * e["x"]).alias("a"), (a["b"] + miss(e)).alias("b")))
        g = F.transform(F.array(g), lambda v: F.struct((at["slope"] - rate * (v["a"] / F.col("total") + l2 * at["slope"])).alias("slope"), (at["intercept"] - rate * v["b"] / F.col("total")).alias("intercept")))
        return F.element_at(g, 1)

    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), F.struct(F.lit(1.0).alias("slope"), F.lit(0.0).alias("intercept")), step)
    return per.select(*keys, fitted.alias("f")).select(*keys, "f.slope", "f.intercept")


def predict_platt(p: Column, slope: Column, intercept: Column) -> Column:
    return sigmoid(slope * logit(p) + intercept)


def calibrated(points: DataFrame, asked: DataFrame, keys: list[str], least: int = 30) -> DataFrame:
    """asked (keys, p, different ones) with kind and value by the calibrator fitted to the key's points: isotonic from
    `least` rows on, Platt's below, and p itself (held off 0 and 1) for a key without points."""
    total = points.where("p IS NOT NULL").groupBy(*keys).agg(F.sum("n").alias("_n"))
    sized = points.join(total, keys)
    many, few = sized.where(F.col("_n") >= least), sized.where(F.col("_n") < least)
    wanted = asked.join(total, keys, "left").withColumn("kind", F.when(F.col("_n") >= least, "isotonic").otherwise("platt")).drop("_n")
    high = predict_isotonic(wanted.where("kind = 'isotonic'").select(*keys, "p"), isotonic(many, keys), keys).withColumn("kind", F.lit("isotonic"))
    low = wanted.where("kind = 'platt'").join(platt(few, keys), keys, "left")
    low = low.select(*keys, "p", predict_platt(F.col("p"), F.coalesce("slope", F.lit(1.0)), F.coalesce("intercept", F.lit(0.0))).alias("value"), "kind")
    return high.unionByName(low)


def walk_forward(rows: DataFrame, order: list[str], least: int = 30, least_conformal: int = 20, fraction: float = 0.25) -> DataFrame:
    """rows (t, order columns, p, y) with n_train, kind, p_cal and the ends of two intervals, each row judged by what was
    fitted to all rows of times before its own and none of its own time or later.

    A fit needs the rows before t only as counts by probability. These are cumulated over time within each probability,
    so no time scans the rows before it: the work is the number of times by that of different probabilities. The
    intervals' widths are quantiles of |y - p_cal| over the last rows before t, a quarter of them and 20 at least: counts
    before t less those before the time in which these rows begin, and of that time the rows beyond its share. Only
    tables of one row per time are sorted as a whole. Rows of equal p are one point."""
    src = rows.where("p IS NOT NULL AND y IS NOT NULL AND t IS NOT NULL")
    times = src.groupBy("t").agg(F.count("*").alias("here"))
    every = Window.orderBy("t")
    times = times.select("t", (F.row_number().over(every) - 1).alias("k"), (F.sum("here").over(every.rowsBetween(Window.unboundedPreceding, 0)) - F.col("here")).alias("n_train"), F.count("*").over(Window.partitionBy()).alias("of"))
    tail = F.least(F.greatest(F.lit(least_conformal), F.ceil(F.col("n_train") * fraction)), "n_train")
    times = times.withColumn("tail", tail).withColumn("cut", F.col("n_train") - F.col("tail"))
    # The time in which the tail of each time begins, by one sort of two rows per time.
    ends = times.select(F.col("n_train").alias("x"), F.lit(0).alias("side"), F.col("k").alias("first"), F.col("n_train").alias("first_n"), F.lit(None).cast("int").alias("k"))
    ends = ends.unionByName(times.where("n_train > 0").select(F.col("cut").alias("x"), F.lit(1).alias("side"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("long").alias("first_n"), "k"))
    upto = Window.orderBy("x", "side").rowsBetween(Window.unboundedPreceding, 0)
    begins = ends.select("k", "side", "x", F.last("first", True).over(upto).alias("first"), F.last("first_n", True).over(upto).alias("first_n")).where("side = 1").select(F.col("k").alias("j"), "first", (F.col("x") - F.col("first_n")).alias("skip"))
    placed = src.select("t", *order, F.col("p").cast("double").alias("p"), F.col("y").cast("long").alias("y")).join(times.select("t", "k", "of"), "t")
    counts = placed.groupBy("p", "k", "of").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))
    w = Window.partitionBy("p").orderBy("k")
    since = w.rowsBetween(Window.unboundedPreceding, 0)
    spans = counts.select("p", F.sum("n").over(since).alias("n"), F.sum("positives").over(since).alias("positives"), (F.col("k") + 1).alias("a"), F.coalesce(F.lead("k").over(w), F.col("of") - 1).alias("z"))
    before = spans.where("a <= z").select(F.explode(F.sequence("a", "z")).alias("j"), "p", "n", "positives")
    asked = before.select("j", "p").unionByName(counts.select(F.col("k").alias("j"), "p")).distinct()
    values = calibrated(before, asked, ["j"], least)
    # Counts of the tail: all before j, less all before the time after the one it begins in, and that one's own share.
    old = before.select(F.col("j").alias("from"), "p", F.col("n").alias("n0"), F.col("positives").alias("s0"))
    whole = before.join(begins.select("j", (F.col("first") + 1).alias("from")), "j").join(old, ["from", "p"], "left")
    whole = whole.select("j", "p", (F.col("n") - F.coalesce("n0", F.lit(0))).alias("n"), (F.col("positives") - F.coalesce("s0", F.lit(0))).alias("positives"))
    place = F.row_number().over(Window.partitionBy("k").orderBy(*order))
    share = placed.select("p", "y", F.col("k").alias("first"), place.alias("place")).join(begins, "first").where("place > skip").groupBy("j", "p").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))
    last = whole.unionByName(share).groupBy("j", "p").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives")).join(values, ["j", "p"])
    misses = last.select("j", F.explode(F.array(F.struct((1 - F.col("value")).alias("r"), F.col("positives").alias("c")), F.struct(F.col("value").alias("r"), (F.col("n") - F.col("positives")).alias("c")))).alias("e")).select("j", "e.*").where("c > 0")
    misses = misses.groupBy("j", "r").agg(F.sum("c").alias("c"))
    run = F.sum("c").over(Window.partitionBy("j").orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    misses = misses.withColumn("upto", run).withColumn("all", F.sum("c").over(Window.partitionBy("j")))
    at = lambda q: F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("all") * q)), F.col("r")))
    widths = misses.groupBy("j").agg(at(0.5).alias("q50"), at(0.9).alias("q90"))
    got = placed.join(times.select("k", "n_train"), "k").withColumnRenamed("k", "j").join(values, ["j", "p"]).join(widths, "j", "left")
    q50, q90 = F.coalesce("q50", F.lit(0.15)), F.coalesce("q90", F.lit(0.35))
    edge = lambda q, up: F.least(F.lit(1.0), F.col("value") + q) if up else F.greatest(F.lit(0.0), F.col("value") - q)
    return got.select("t", *order, "p", "y", "n_train", "kind", F.col("value").alias("p_cal"), edge(q50, False).alias("low_50"), edge(q50, True).alias("high_50"), edge(q90, False).alias("low_90"), edge(q90, True).alias("high_90"))
