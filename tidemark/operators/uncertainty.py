"""Coverage report of forecast intervals: rates, exact medians, failed checks with their first examples, and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("50", "90")


def interval_report(rows: DataFrame, key: str, id_col: str, least: int = 50, targets: tuple[float, float] = (0.5, 0.9), tol: float = 0.05, same: float = 1e-12, most_degenerate: float = 0.25, examples: int = 5) -> DataFrame:
    """rows (key, id, y, low_50, high_50, low_90, high_90) to one row per key: per level coverage, mean and median width,
    share of degenerate intervals and number of invalid ones, the number of rows whose 90 per cent interval is narrower
    than the 50 per cent one, flags, and the first ids of each failed check.

    An interval that is null, not finite or turned round is invalid and covers nothing; one beyond 0..1 is invalid and
    clipped. Counts and sums are added up per task first, medians come from counts of equal widths, and of the examples
    no task sends more than it may keep."""
    level = lambda k: F.struct(F.lit(k).alias("level"), F.col(f"low_{k}").cast("double").alias("lo"), F.col(f"high_{k}").cast("double").alias("hi"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))
    df = rows.select(F.col(key).alias("key"), F.col(id_col).alias("id"), "y", F.inline(F.array(*map(level, LEVELS))))
    df = df.withColumn("ok", F.coalesce(finite("lo") & finite("hi") & (F.col("lo") <= F.col("hi")), F.lit(False)))
    df = df.withColumn("width", F.when(F.col("ok"), clip("hi") - clip("lo")))
    df = df.withColumns({
        "invalid": ~F.col("ok") | (F.col("lo") < 0) | (F.col("hi") > 1),
        "degenerate": F.coalesce(F.col("width") <= same, F.lit(False)),
        "covered": F.coalesce(F.col("ok") & (F.col("y") >= clip("lo")) & (F.col("y") <= clip("hi")), F.lit(False)),
    })
    n = F.count("*")
    rate = lambda c: F.sum(F.col(c).cast("long")) / n
    cells = df.groupBy("key", "level").agg(n.alias("n"), rate("covered").alias("coverage"), (F.coalesce(F.sum("width"), F.lit(0.0)) / n).alias("mean_width"), rate("degenerate").alias("degenerate_rate"), F.sum(F.col("invalid").cast("long")).alias("invalid"))
    w = Window.partitionBy("key", "level")
    placed = df.where("ok").groupBy("key", "level", "width").agg(n.alias("c"))
    placed = placed.withColumn("upto", F.sum("c").over(w.orderBy("width").rowsBetween(Window.unboundedPreceding, 0))).withColumn("of", F.sum("c").over(w))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("width")))
    medians = placed.groupBy("key", "level").agg(((at(F.floor((F.col("of") - 1) / 2)) + at(F.floor(F.col("of") / 2))) / 2).alias("median_width"))
    cells = cells.join(medians, ["key", "level"], "left").withColumn("median_width", F.coalesce("median_width", F.lit(0.0)))
    both = rows.select(F.col(key).alias("key"), F.col(id_col).alias("id"), *[(F.least(F.greatest(F.col(f"high_{k}"), F.lit(0.0)), F.lit(1.0)) - F.least(F.greatest(F.col(f"low_{k}"), F.lit(0.0)), F.lit(1.0))).alias(f"w{k}") for k in LEVELS], *[(finite(f"low_{k}") & finite(f"high_{k}") & (F.col(f"low_{k}") <= F.col(f"high_{k}"))).alias(f"ok{k}") for k in LEVELS])
    narrow = both.where("ok50 AND ok90").where(F.col("w90") + same < F.col("w50")).select("key", "id", F.lit("all").alias("level"), F.lit("monotonic_width_violation").alias("code"))
    failed = df.select("key", "id", "level", F.explode(F.array_compact(F.array(F.when(F.col("invalid"), F.lit("invalid_interval")), F.when(F.col("degenerate"), F.lit("degenerate_interval"))))).alias("code"))
    failed = failed.unionByName(narrow)
    first = failed.withColumn("place", F.row_number().over(Window.partitionBy("key", "level", "code").orderBy("id"))).where(F.col("place") <= examples)
    first = first.groupBy("key", "level", "code").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"].cast("string"))).alias("ids"))
    first = first.groupBy("key").agg(F.sort_array(F.collect_list(F.concat_ws(":", "code", "level", "ids"))).alias("examples"))
    wide = cells.groupBy("key").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("level") == k, F.col(c))).alias(f"{c}_{k}") for k in LEVELS for c in ("coverage", "mean_width", "median_width", "degenerate_rate", "invalid")])
    out = wide.join(narrow.groupBy("key").agg(n.alias("narrower")), "key", "left").join(first, "key", "left").withColumn("narrower", F.coalesce("narrower", F.lit(0).cast("long")))
    flag = lambda c, name: F.when(c, F.lit(name))
    flags = F.array_compact(F.array(
        flag(F.col("n") < least, "insufficient_uncertainty_data"),
        flag(F.col("invalid_50") + F.col("invalid_90") > 0, "conformal_invalid_intervals"),
        flag(F.greatest("degenerate_rate_50", "degenerate_rate_90") > most_degenerate, "conformal_degenerate_intervals"),
        flag(F.col("coverage_90") < targets[1] - tol, "coverage_below_target_90"),
        flag(F.col("coverage_50") < targets[0] - tol, "coverage_below_target_50"),
    ))
    return out.withColumn("flags", flags).withColumn("examples", F.coalesce("examples", F.array().cast("array<string>"))).withColumnRenamed("key", key)
