"""Ledger, positions and performance as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_fills(ledger: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first entry per key in the given order, as an aggregation with map-side combine."""
    rest = [c for c in ledger.columns if c not in key and c not in order]
    best = ledger.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("r"))
    return best.select(*key, *[f"r.{c}" for c in [*order, *rest]])


def positions(ledger: DataFrame, key: list[str]) -> DataFrame:
    """(token, side) folds of (quantity, notional, fee), money in decimals so that sums are exact; positions of no quantity are left out."""
    g = ledger.groupBy(*key).agg(F.sum("quantity").alias("quantity"), F.sum("notional").cast("double").alias("cost"), F.sum("fee").cast("double").alias("fees"), F.count("*").alias("entries"))
    return g.where("quantity > 0").withColumn("avg_cost", F.col("cost") / F.col("quantity"))


def exposure(ledger: DataFrame, token: str) -> DataFrame:
    """Signed notional per token; sales count as negative."""
    n = F.col("quantity") * F.col("price")
    return ledger.groupBy(token).agg(F.sum(F.when(F.col("side") == "SELL", -n).otherwise(n)).alias("exposure"))


def concentration(notional: DataFrame, group: str, amount: str) -> DataFrame:
    """Share of the largest and of the three largest amounts in each group's total."""
    w = Window.partitionBy(group).orderBy(F.desc(amount))
    r = notional.withColumn("k", F.row_number().over(w))
    g = r.groupBy(group).agg(F.sum(amount).alias("total"), F.sum(F.when(F.col("k") == 1, F.col(amount))).alias("a"), F.sum(F.when(F.col("k") <= 3, F.col(amount))).alias("b"))
    return g.select(group, "total", (F.col("a") / F.col("total")).alias("top1_share"), (F.col("b") / F.col("total")).alias("top3_share"))


def reference_prices(orders: DataFrame, external: DataFrame, order: list[str]) -> DataFrame:
    """(token, side, price): the last order's price, else the external one."""
    last = orders.groupBy("token", "side").agg(F.max_by("price", F.struct(*order)).alias("_own"))
    return last.join(external.withColumnRenamed("price", "_other"), ["token", "side"], "full").select("token", "side", F.coalesce("_own", "_other").alias("price"))


def mark_to_model(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """positions (token, side, quantity, cost) with price, value and gain; all three null where there is no price."""
    p = positions.join(prices, ["token", "side"], "left").withColumn("value", F.col("quantity") * F.col("price"))
    return p.withColumn("gain", F.col("value") - F.col("cost"))


def missing_prices(positions: DataFrame, prices: DataFrame) -> DataFrame:
    return positions.select("token", "side").join(prices.where("price IS NOT NULL"), ["token", "side"], "left_anti")


def run_performance(runs: DataFrame) -> DataFrame:
    """Over runs (gain, notional): mean, median, worst and best gain in basis points, and the share of runs without
    notional, whose gain counts as 0."""
    bps = F.when(F.col("notional") > 0, F.col("gain") / F.col("notional") * 10000).otherwise(0.0)
    r = runs.select(bps.alias("b"), (F.col("notional") <= 0).cast("int").alias("z"))
    return r.agg(F.count("*").alias("runs"), F.avg("b").alias("mean_bps"), F.median("b").alias("median_bps"), F.min("b").alias("worst_bps"), F.max("b").alias("best_bps"), F.avg("z").alias("zero_rate"))
