"""Forecast models as column expressions over a market's features, with what drives them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calibrators import sigmoid
from .selector import clamp

#: Weights of the two models, and their intercepts.
MICRO = {
    "mid_price_centered": 2.0,
    "book_imbalance_1": 1.2,
    "return_5m": 1.5,
    "realized_vol_1h": -0.6,
    "spread_bps_scaled": -0.8,
    "trade_count_5m_scaled": 0.7,
    "volume_5m_scaled": 0.4,
    "stale_trade_scaled": 0.5,
    "stale_book_scaled": 0.3,
}
META = {"agreement": 0.35, "p_a": 0.55, "p_b": 1.05}
MICRO_BASE, META_BASE = 0.0, -0.15


def micro_inputs() -> dict[str, Column]:
    """The features held within their bounds and scaled; missing ones at their defaults."""

    def held(name: str, default: float, low: float, high: float) -> Column:
        return clamp(F.coalesce(F.col(name).cast("double"), F.lit(default)), low, high)

    return {
        "mid_price_centered": held("mid_price", 0.5, 0.0, 1.0) - 0.5,
        "book_imbalance_1": held("book_imbalance_1", 0.0, -1.0, 1.0),
        "return_5m": held("return_5m", 0.0, -0.5, 0.5),
        "realized_vol_1h": held("realized_vol_1h", 0.0, 0.0, 2.0),
        "spread_bps_scaled": held("spread_bps", 0.0, 0.0, 2000.0) / 1000.0,
        "trade_count_5m_scaled": held("trade_count_5m", 0.0, 0.0, 100.0) / 100.0,
        "volume_5m_scaled": F.log1p(held("volume_5m", 0.0, 0.0, 1_000_000.0)) / 10.0,
        "stale_trade_scaled": -(held("stale_seconds_last_trade", 3600.0, 0.0, 14_400.0) / 3600.0),
        "stale_book_scaled": -(held("stale_seconds_last_book", 3600.0, 0.0, 14_400.0) / 3600.0),
    }


def _score(inputs: dict[str, Column], weights: dict[str, float], base: float) -> Column:
    return sum((weights[k] * inputs[k] for k in sorted(weights)), F.lit(base))


def contributions(inputs: dict[str, Column], weights: dict[str, float], prefix: str) -> list[Column]:
    return [F.struct(F.lit(f"{prefix}.{k}").alias("feature"), inputs[k].alias("value"), F.lit(weights[k]).alias("coefficient"), (weights[k] * inputs[k]).alias("contribution")) for k in sorted(weights)]


def no_trade_flags() -> Column:
    """Flags of a market that is not to be traded: insufficient_data, illiquid, stale."""
    need = ("spread_bps", "top_depth_bid", "top_depth_ask", "stale_seconds_last_trade", "stale_seconds_last_book")
    or0 = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    missing = F.greatest(*[F.col(c).isNull() for c in need])
    illiquid = (or0("spread_bps") >= 1500.0) | (or0("top_depth_bid") + or0("top_depth_ask") < 1.0)
    stale = F.greatest(or0("stale_seconds_last_trade"), or0("stale_seconds_last_book")) >= 14_400.0
    return F.array_compact(F.array(F.when(illiquid, F.lit("illiquid")), F.when(missing, F.lit("insufficient_data")), F.when(stale, F.lit("stale"))))


def forecast(rows: DataFrame, most: int = 5) -> DataFrame:
    """rows (features, price_prob) with p_a (the price), p_b (a logistic model of the features), p_raw (a logistic model
    of both and of how far they agree), the `most` largest contributions as drivers, by size, then name, and
    no_trade_flags. One projection after the inputs; p_a is null without a price, and then so are p_raw and drivers."""
    inputs = micro_inputs()
    names = list(inputs)
    df = rows.withColumns({f"_{k}": c for k, c in inputs.items()}).withColumn("p_a", F.when(F.col("price_prob").isNotNull(), clamp(F.col("price_prob").cast("double"))))
    inputs = {k: F.col(f"_{k}") for k in names}
    df = df.withColumn("p_b", sigmoid(_score(inputs, MICRO, MICRO_BASE)))
    meta = {"agreement": 1.0 - F.abs(F.col("p_a") - F.col("p_b")), "p_a": F.col("p_a"), "p_b": F.col("p_b")}
    parts = F.array(*contributions(inputs, MICRO, "micro"), *contributions(meta, META, "meta"))
    ranked = F.transform(F.sort_array(F.transform(parts, lambda x: F.struct((-F.abs(x["contribution"])).alias("o"), x["feature"].alias("f"), x.alias("x")))), lambda y: y["x"])
    df = df.withColumn("p_raw", sigmoid(_score(meta, META, META_BASE))).withColumn("drivers", F.when(F.col("p_a").isNotNull(), F.slice(ranked, 1, most))).withColumn("no_trade_flags", no_trade_flags())
    return df.drop(*[f"_{k}" for k in names])
