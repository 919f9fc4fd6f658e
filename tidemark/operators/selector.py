"""Scores and ranks of candidate markets as column expressions over their features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks.staged import staged

#: Words that make a rule ambiguous, and what each time to resolution counts.
AMBIGUOUS = ["maybe", "depends", "subject to", "discretion", "ambiguous", "unclear"]
TTR = {"0_24h": 1.00, "1_7d": 0.85, "7_30d": 0.55, "30d_plus": 0.30, "unknown": 0.25}
NEEDED = ["spread_bps", "top_depth_bid", "top_depth_ask", "book_imbalance_1", "return_5m", "realized_vol_1h", "stale_seconds_last_trade", "stale_seconds_last_book"]


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def _or(name: str, default: float) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(default))


def liquidity() -> tuple[Column, Column, Column]:
    """Quality from 0 to 1, and whether the market is illiquid and whether its data are stale."""
    spread = _or("spread_bps", 10000.0)
    depth = F.greatest(_or("top_depth_bid", 0.0), F.lit(0.0)) + F.greatest(_or("top_depth_ask", 0.0), F.lit(0.0))
    age = [F.greatest(_or(f"stale_seconds_last_{k}", 1e9), F.lit(0.0)) for k in ("trade", "book")]
    fresh = [1 - clamp(a / 7200.0) for a in age]
    lq = 0.35 * (1 - clamp(spread / 1000.0)) + 0.35 * clamp(F.log1p(depth) / F.log1p(F.lit(500.0))) + 0.15 * fresh[0] + 0.15 * fresh[1]
    return clamp(lq), (spread >= 1500.0) | (depth < 1.0), F.greatest(*age) >= 14400.0


def entropy(p: Column) -> Column:
    """In bits, of a probability held off 0 and 1."""
    q = clamp(p, 1e-6, 1 - 1e-6)
    return clamp(-(q * F.log(q) + (1 - q) * F.log(1 - q)) / F.log(F.lit(2.0)))


def ttr_bucket(resolves: Column, t: Column, status: Column) -> Column:
    left = F.unix_seconds(resolves.cast("timestamp")) - F.unix_seconds(t.cast("timestamp"))
    day = 86400
    known = F.when(left <= day, "0_24h").when(left <= 7 * day, "1_7d").when(left <= 45 * day, "7_30d").otherwise("30d_plus")
    return F.when(resolves.isNotNull(), known).when(F.lower(status).isin("resolved", "closed", "ended"), "0_24h").otherwise("unknown")


def scores(rows: DataFrame) -> DataFrame:
    """rows (the features, has_features, price_prob, rule_ok, rule_text, description, title, ttr) with lq, pq, vo, dc,
    rc, penalty, flags, screen_score and deep_score. A market with a hard flag has screen score 0."""
    lq, illiquid, stale = liquidity()
    text = F.concat_ws(" ", *[F.nullif(F.trim(c), F.lit("")) for c in ("rule_text", "description", "title")])
    hits = sum((F.lower(text).contains(k).cast("int") for k in AMBIGUOUS), F.lit(0))
    p = F.col("price_prob")
    present = sum((F.col(c).isNotNull().cast("int") for c in [*NEEDED, "price_prob"]), F.lit(0))
    vo = 0.6 * clamp(F.abs(_or("return_5m", 0.0)) / 0.20) + 0.4 * clamp(_or("realized_vol_1h", 0.0) / 0.20)
    df = rows.withColumns({"lq": lq, "_illiquid": illiquid, "_stale": stale, "pq": F.coalesce(entropy(p), F.lit(0.0)), "vo": clamp(vo), "dc": present / 9.0, "_amb": F.least(0.05 * hits, F.lit(0.30))})
    df = df.withColumn("rc", clamp(0.6 * F.when(F.col("rule_ok"), 1.0).otherwise(0.0) + 0.4 * clamp(F.length(text) / 400.0) - F.col("_amb")))
    missing, unpriced = ~F.col("has_features"), p.isNull()
    hard = F.col("_illiquid") | F.col("_stale")
    n = lambda c, v: F.when(c, v).otherwise(0.0)
    df = df.withColumn("penalty", F.col("_amb") + n(missing, 0.2) + n(unpriced, 0.2) + n(F.col("_illiquid"), 1.0) + n(F.col("_stale"), 1.0))
    raw = 0.35 * F.col("lq") + 0.25 * F.col("pq") + 0.20 * F.col("vo") + 0.10 * F.col("dc") + 0.10 * F.col("rc") - F.col("penalty")
    df = df.withColumn("screen_score", F.when(hard, 0.0).otherwise(F.round(clamp(raw), 6)))
    flag = lambda c, name: F.when(c, F.lit(name))
    flags = F.array_compact(F.array(flag(F.col("_amb") > 0, "ambiguous_rule"), flag(F.col("_illiquid"), "illiquid"), flag(missing, "missing_features"), flag(unpriced, "missing_price_prob"), flag(F.col("_stale"), "stale_data")))
    ttr = F.coalesce(*[F.when(F.col("ttr") == k, v) for k, v in TTR.items()], F.lit(TTR["unknown"]))
    r = lambda c: F.round(c, 6)
    base = 0.40 * r("pq") + 0.25 * r("vo") + 0.15 * r("dc") + 0.10 * ttr + 0.10 * F.col("screen_score")
    deep = base - n(hard, 1.0) - r(F.col("_amb") * 0.75) - n(missing, 0.15) - n(unpriced, 0.15)
    return df.withColumns({"flags": flags, "deep_score": r(clamp(deep))}).drop("_illiquid", "_stale", "_amb")


def candidate_set(rows: DataFrame, t: Column, most: int = 1500, ratio: float = 0.8, least_lq: float = 0.35, hours: int = 48) -> DataFrame:
    """rows (market_id, token, volume, updated_ts and features) that are among the first by volume, liquid enough, or
    lately updated, with their reasons; the first `most` of them by volume. The rows are made once and written; each
    reason is one condition of one pass over them."""
    order = [F.desc("volume"), F.col("market_id"), F.col("token")]
    rows, _ = staged(rows, "candidates")
    # The last row that volume alone lets in; what comes before it in the order is compared with it, not joined.
    cut = rows.select("volume", "market_id", "token").orderBy(*order).limit(max(1, int(most * ratio)))
    cut = cut.agg(F.max(F.struct((-F.col("volume")).alias("v"), "market_id", "token")).alias("c")).first()["c"]
    top = F.lit(False) if cut is None else F.struct((-F.col("volume")).alias("v"), "market_id", "token") <= F.struct(*[F.lit(x).cast(rows.schema[c].dataType).alias(n) for x, c, n in zip(cut, ("volume", "market_id", "token"), ("v", "market_id", "token"), strict=True)])
    lq = F.round(liquidity()[0], 6) >= least_lq
    fresh = (F.col("updated_ts") <= t) & (F.col("updated_ts") >= t - F.expr(f"INTERVAL {hours} HOURS"))
    df = rows.withColumn("reasons", F.array_compact(F.array(F.when(lq, F.lit("by_lq_threshold")), F.when(top, F.lit("by_volume")), F.when(fresh, F.lit("recently_updated")))))
    return df.where(F.size("reasons") > 0).orderBy(*order).limit(most)
