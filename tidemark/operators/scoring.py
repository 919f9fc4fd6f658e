"""Evaluation of probabilities against outcomes, and ranking under caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-6


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """All bins, empty ones with zeros, of (p, y): mean p (held to 0..1), mean y and count. The last bin holds p = 1."""
    p = F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0))
    got = rows.groupBy(F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.avg(p).alias("mean_p"), F.avg("y").alias("mean_y"), F.count("*").alias("n"))
    return rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").na.fill(0)


def metrics(rows: DataFrame, key: str) -> DataFrame:
    """Brier score, log loss, sharpness and count per key."""
    q = F.least(F.greatest("p", F.lit(EPSILON)), F.lit(1 - EPSILON))
    return rows.groupBy(key).agg(
        F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"),
        F.avg(-(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1 - q))).alias("log_loss"),
        F.var_pop("p").alias("sharpness"),
        F.count("*").alias("n"),
    )


def capped(rows: DataFrame, group: str, order: list, most: int) -> DataFrame:
    """The first `most` rows of each group in the given order."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def expanding_rate(rows: DataFrame, t: str = "t", y: str = "y") -> DataFrame:
    """Per decision time the number and mean of strictly earlier outcomes; times are aggregated before the window,
    which so sees one row per time, not per outcome."""
    per = rows.groupBy(t).agg(F.count("*").alias("n"), F.sum(y).alias("s"))
    w = Window.orderBy(t).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(t, F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n_train"), (F.sum("s").over(w) / F.sum("n").over(w)).alias("rate"))


def report(rows: DataFrame, key: str, bins: int = 10, least: int = 40, most_ece: float = 0.08) -> DataFrame:
    """Brier score, log loss, expected and largest calibration error of (key, p, y), over all (key null, overall true)
    and per key, with the gates that fail. One pass: sums per key and bin, and over bins, give all of them."""
    p = F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0))
    q = F.least(F.greatest("p", F.lit(EPSILON)), F.lit(1 - EPSILON))
    src = rows.select(F.col(key), F.col("y"), p.alias("_p"), q.alias("_q"), F.least(F.floor(p * bins), F.lit(bins - 1)).alias("_bin"))
    cells = src.groupingSets([[key, "_bin"], ["_bin"]], key, "_bin").agg(
        F.grouping(key).alias("_all"), F.count("*").alias("n"), F.sum("_p").alias("sp"), F.sum("y").alias("sy"), F.sum((F.col("_p") - F.col("y")) ** 2).alias("sb"),
        F.sum(-(F.col("y") * F.log("_q") + (1 - F.col("y")) * F.log(1 - F.col("_q")))).alias("sl"),
    )
    n, off = F.sum("n"), F.abs(F.col("sp") - F.col("sy"))
    out = cells.groupBy(key, (F.col("_all") == 1).alias("overall")).agg(n.alias("n"), (F.sum("sb") / n).alias("brier"), (F.sum("sl") / n).alias("log_loss"), (F.sum(off) / n).alias("ece"), F.max(off / F.col("n")).alias("mce"))
    gates = F.array_compact(F.array(F.when(F.col("n") < least, F.lit("too_few")), F.when(F.col("ece") > most_ece, F.lit("ece_too_high"))))
    return out.withColumn("gates", F.concat_ws(",", gates))


def summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean, least, nearest-rank p50 and p90 and largest value per key; the rank (n - 1) * q is rounded half to
    even. Equal values are counted before the order is made, so a window row stands for one different value."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy(key)))

    def at(q: float):
        rank = F.bround((F.col("n") - 1) * q)
        return F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank), F.col("v")))

    return placed.groupBy(key).agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), F.min("v").alias("least"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("v").alias("largest"))


def conformal(rows: DataFrame, key: str, order: list[str], least: int = 20, fraction: float = 0.25) -> DataFrame:
    """Per key the half-widths q50 and q90 of intervals around p: the quantiles of |y - p| over the last rows in the
    given order, a quarter of them and 20 at least."""
    by = [F.desc(c) for c in order]
    n = F.count("*").over(Window.partitionBy(key))
    p = F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0))
    tail = rows.select(key, *order, F.abs(F.col("y") - p).alias("r"), n.alias("n"), F.row_number().over(Window.partitionBy(key).orderBy(*by)).alias("back"))
    tail = tail.withColumn("k", F.least(F.greatest(F.lit(least), F.ceil(F.col("n") * fraction)), "n")).where(F.col("back") <= F.col("k"))
    tail = tail.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("r")))
    at = lambda q: F.max(F.when(F.col("place") == F.greatest(F.lit(1), F.ceil(F.col("k") * q)), F.col("r")))
    return tail.groupBy(key).agg(at(0.5).alias("q50"), at(0.9).alias("q90"), F.max("k").cast("long").alias("calibrated_on"))


def coverage(rows: DataFrame, widths: DataFrame, key: str) -> DataFrame:
    """Share of rows (key, p, y) whose y lies in the interval, and the intervals' mean width, per key and level; a key
    without widths gets 0.15 and 0.35."""
    df = rows.join(widths, key, "left")
    agg = []
    for level, default in (("50", 0.15), ("90", 0.35)):
        q = F.coalesce(F.col(f"q{level}"), F.lit(default))
        low, high = F.greatest(F.lit(0.0), F.col("p") - q), F.least(F.lit(1.0), F.col("p") + q)
        agg += [F.avg(((F.col("y") >= low) & (F.col("y") <= high)).cast("int")).alias(f"coverage_{level}"), F.avg(high - low).alias(f"width_{level}")]
    return df.groupBy(key).agg(*agg)
