"""Features of a token's market at each decision time, from its book, its trades and its candles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import asof


def best_price(levels: Column, of_bids: bool) -> Column:
    prices = F.transform(levels, lambda v: v["price"])
    return F.array_max(prices) if of_bids else F.array_min(prices)


def book_probability(bids: Column, asks: Column) -> Column:
    """The middle of the best bid and ask as a probability. Prices outside 0 to 1 and NaN are no prices; null unless both
    sides have one above 0."""
    held = lambda levels: F.filter(levels, lambda v: v["price"].between(0, 1))
    return mid_price(F.lit(None).cast("double"), best_price(held(bids), True), best_price(held(asks), False))


def depth_at(levels: Column, best: Column) -> Column:
    """Total size of the levels at the best price; 0 without levels."""
    total = F.aggregate(F.filter(levels, lambda v: v["price"] == best), F.lit(0.0), lambda a, v: a + v["size"])
    return F.greatest(F.coalesce(total, F.lit(0.0)), F.lit(0.0))


def mid_price(mid: Column, bid: Column, ask: Column) -> Column:
    return F.when(mid > 0, mid).when((bid > 0) & (ask > 0), (bid + ask) / 2)


def spread_bps(bid: Column, ask: Column, mid: Column) -> Column:
    return F.when(mid > 0, (ask - bid) / mid * 10000)


def imbalance(bid_depth: Column, ask_depth: Column) -> Column:
    return F.when(bid_depth + ask_depth > 0, (bid_depth - ask_depth) / (bid_depth + ask_depth))


def log_return(now: Column, anchor: Column) -> Column:
    return F.when((now > 0) & (anchor > 0), F.log(now / anchor))


def stale_seconds(t: Column, at: Column) -> Column:
    """Whole seconds from at to t, 0 if at is later, null if there is none."""
    gone = F.floor((F.unix_micros(t.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 1_000_000)
    return F.when(gone < 0, F.lit(0).cast("long")).otherwise(gone)


def within(spine: DataFrame, rows: DataFrame, key: str, at: str, seconds: int, epsilon_seconds: int = 300) -> DataFrame:
    """Pairs of spine (key, t) and rows with t - seconds <= at <= t that were ingested by t + epsilon. They meet by
    equality of key and of one of two time buckets as wide as the window, so a hot key is split by time."""
    bucket = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / seconds)
    left = spine.select(key, "t", F.explode(F.array(bucket(F.col("t")), bucket(F.col("t")) - 1)).alias("_b"))
    right = rows.where(F.col("ingested_at").isNotNull()).withColumn("_b", bucket(F.col(at)))
    met = left.join(right, [key, "_b"]).drop("_b")
    late = F.col("ingested_at") <= F.col("t") + F.expr(f"INTERVAL {epsilon_seconds} SECONDS")
    return met.where((F.col(at) <= F.col("t")) & (F.col(at) >= F.col("t") - F.expr(f"INTERVAL {seconds} SECONDS")) & late)


def features(spine: DataFrame, books: DataFrame, trades: DataFrame, candles: DataFrame, key: str, short: int = 300, long: int = 3600, epsilon_seconds: int = 300) -> DataFrame:
    """spine (key, t) with the thirteen features. books: key, book_id, event_ts, ingested_at, mid, bids, asks (arrays of
    price and size); trades: key, trade_id, event_ts, ingested_at, price, size; candles: key, start_ts, ingested_at,
    close. Counts and sums over nothing are 0, other features null. The anchor of the return is the last trade, or else
    the middle of the last book, at t - short; what is ingested by t + epsilon counts for it as well."""
    # Each book becomes five numbers first, so that no levels are sorted or carried.
    bid, ask = best_price(F.col("bids"), True), best_price(F.col("asks"), False)
    tops = books.select(key, "book_id", "event_ts", "ingested_at", "mid", bid.alias("bid"), ask.alias("ask"), depth_at(F.col("bids"), bid).alias("db"), depth_at(F.col("asks"), ask).alias("da"))
    tops = tops.withColumn("m", mid_price(F.col("mid"), F.col("bid"), F.col("ask")))
    own = ["m", "bid", "ask", "db", "da"]
    known = asof.asof_many(spine, {"book": (tops, "book_id", own, 0), "trade": (trades, "trade_id", ["price", "size"], 0), "old_trade": (trades, "trade_id", ["price"], short), "old_book": (tops, "book_id", ["m"], short)}, key, epsilon_seconds)
    depth = lambda c: F.coalesce(F.col(f"book.{c}"), F.lit(0.0)).alias(c)
    known = known.select(
        key, "t", F.col("book.event_ts").alias("book_ts"), *[F.col(f"book.{c}").alias(c) for c in ("m", "bid", "ask")], depth("db"), depth("da"), F.col("trade.event_ts").alias("trade_ts"),
        F.col("trade.price").alias("price"), F.col("trade.size").alias("size"), F.col("old_trade.price").alias("at_trade"), F.col("old_book.m").alias("at_book"),
    )
    recent = within(spine, trades, key, "event_ts", short, epsilon_seconds).groupBy(key, "t").agg(F.count("*").alias("n"), F.sum("size").alias("v"))
    w = Window.partitionBy(key, "t").orderBy("start_ts")
    steps = within(spine, candles, key, "start_ts", long, epsilon_seconds).where("close > 0").withColumn("r", F.log(F.col("close") / F.lag("close").over(w)))
    vol = steps.groupBy(key, "t").agg(F.stddev_pop("r").alias("vol"))
    df = known.join(recent, [key, "t"], "left").join(vol, [key, "t"], "left")
    return df.select(
        key, "t", F.col("m").alias("mid_price"),
        spread_bps(F.col("bid"), F.col("ask"), F.col("m")).alias("spread_bps"),
        F.col("db").alias("top_depth_bid"), F.col("da").alias("top_depth_ask"),
        imbalance(F.col("db"), F.col("da")).alias("book_imbalance_1"),
        F.col("price").alias("last_trade_price"), F.col("size").cast("double").alias("last_trade_size"),
        F.coalesce("n", F.lit(0)).alias("trade_count_5m"), F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("volume_5m"),
        log_return(F.coalesce("m", "price"), F.coalesce("at_trade", "at_book")).alias("return_5m"),
        F.col("vol").alias("realized_vol_1h"),
        stale_seconds(F.col("t"), F.col("trade_ts")).alias("stale_seconds_last_trade"),
        stale_seconds(F.col("t"), F.col("book_ts")).alias("stale_seconds_last_book"),
    )
