"""The market feed: each function takes a batch or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def subscribed(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows of the tokens asked for, a table; others are dropped."""
    return rows.join(tokens.select("token").distinct(), "token", "left_semi")


def deduplicated(rows: DataFrame, key: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """One row per natural key. A stream keeps keys only as long as rows may come late."""
    if rows.isStreaming:
        return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(key)
    return rows.dropDuplicates(key)


def throughput(rows: DataFrame, at: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Messages and different tokens (up to the sketch's error) per interval and channel; on a stream intervals close
    when no row of theirs can come any more."""
    src = rows.withWatermark(at, late) if rows.isStreaming else rows
    g = src.groupBy(F.window(at, width).alias("w"), "channel").agg(F.count("*").alias("messages"), F.approx_count_distinct("token").alias("tokens"))
    return g.select(F.col("w.start").alias("start_ts"), "channel", "messages", "tokens")


def channel(kind: str = "type") -> Column:
    c = F.lower(F.col(kind))
    return F.when(c.contains("trade"), "trade").when(c.contains("book"), "book").otherwise("drop")


def gaps(rows: DataFrame, key: str, seq: str, at: str, stale_seconds: int) -> DataFrame:
    """rows of a batch with what each key's earlier rows, in the order of seq, make of it: the largest time before it,
    and the first reason that holds of sequence_gap (seq is not the one before plus 1), time_regression and stale (more
    than stale_seconds after the largest time)."""
    w = Window.partitionBy(key).orderBy(seq)
    seen = F.max(at).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = rows.withColumn("last_ts", seen).withColumn("_p", F.lag(seq).over(w))
    pause = F.unix_seconds(F.col(at).cast("timestamp")) - F.unix_seconds(F.col("last_ts").cast("timestamp"))
    reason = F.when(F.col("_p") + 1 != F.col(seq), "sequence_gap").when(F.col(at) < F.col("last_ts"), "time_regression").when(pause > stale_seconds, "stale").otherwise("none")
    return df.withColumn("reason", reason).drop("_p")


def mismatch_bps(a: Column, b: Column) -> Column:
    """How far two prices lie apart, in basis points of the larger."""
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-8)) * 10000
