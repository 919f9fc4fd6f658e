"""Registered queries of merged tables, with the same in DuckDB's SQL: rows of the given tables arrive as batches, some
of them twice and out of order."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sinks.merge import KEYS, MergeTable, TokenOwners, shared_dir, trade_hash
from .market_queries import books
from .queries import _CANDLES, _TRADES, _candles, _table, trades


def _merged(spark, rows, key, part, batches=(2, 0, 1, 0)):
    """rows dealt to three batches by part, merged in the given order."""
    table = MergeTable(spark, f"{shared_dir(spark)}/tidemark-merge-{uuid.uuid4().hex}", rows.drop("_part").schema, key, ["ingested_at"], buckets=16)
    rows = rows.withColumn("_part", part)
    for b in batches:
        table.merge(rows.where(F.col("_part") == b).drop("_part"))
    table.vacuum()
    return table.read()


def _trades(spark, sf_dir):
    t = trades(spark, sf_dir)
    seq = F.when(F.col("trade_id") % 3 > 0, F.col("trade_id") % 3)
    side = F.when(F.col("trade_id") % 2 == 0, "buy").otherwise("sell")
    rows = t.select("token", "event_ts", "ingested_at", "price", "size", side.alias("side"), seq.alias("seq"), "trade_id")
    made = F.when(F.col("seq").isNull(), trade_hash(F.col("token"), F.col("event_ts"), F.col("price"), F.col("size"), F.col("side")))
    rows = rows.withColumn("trade_hash", made)
    return _merged(spark, rows, KEYS["trades"], F.col("trade_id") % 3).withColumn("seq", F.coalesce("seq", F.lit(-1).cast("long"))).withColumn("trade_hash", F.coalesce("trade_hash", F.lit("")))


def _snapshots(spark, sf_dir):
    got = _merged(spark, books(spark, sf_dir), KEYS["orderbook_snapshots"], F.col("book_id") % 3)
    return got.select("token", "event_ts", "ingested_at", "book_id", F.size("bids").alias("n_bids"), F.round(F.col("asks")[0]["price"], 6).alias("ask"))


def _merged_candles(spark, sf_dir):
    """Each day's candle comes twice: as it was at half of its trades, and at the end."""
    c = _candles(spark, sf_dir).withColumn("width", F.lit("1d"))
    final = c.withColumn("ingested_at", F.col("start_ts") + F.expr("INTERVAL 1 DAY"))
    early = c.withColumn("ingested_at", F.col("start_ts") + F.expr("INTERVAL 12 HOURS")).withColumn("close", F.col("open")).withColumn("volume", F.lit(0).cast("long"))
    return _merged(spark, final.unionByName(early), KEYS["candles"], F.when(F.hour("ingested_at") == 12, F.col("token") % 2).otherwise(F.lit(2))).select("token", "width", "start_ts", "ingested_at", "open", "close", "volume")


def _owners(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("market_id"), F.col("l_linenumber").cast("string").alias("outcome"), F.col("l_partkey").alias("token_id"), F.col("l_shipdate").cast("string").alias("at"))
    owners = TokenOwners(spark, f"{shared_dir(spark)}/tidemark-owners-{uuid.uuid4().hex}", li.schema, buckets=16)
    for b in (1, 0, 1):
        owners.merge(li.where(F.col("token_id") % 2 == b))
    return owners


QUERIES = {
    "merged_trades": _trades,
    "merged_snapshots": _snapshots,
    "merged_candles": _merged_candles,
    "market_tokens": lambda s, d: _owners(s, d).tokens(),
    "token_conflicts": lambda s, d: _owners(s, d).conflicts(),
}
_CLAIMS = """l AS (SELECT l_suppkey AS market_id, l_linenumber::VARCHAR AS outcome, l_partkey AS token_id, l_shipdate::VARCHAR AS since FROM lineitem),
  o AS (SELECT token_id, arg_min(market_id, (since, market_id, outcome)) AS existing_market_id, arg_min(outcome, (since, market_id, outcome)) AS existing_outcome FROM l GROUP BY token_id)"""
ORACLES = {
    "merged_trades": f"""WITH {_TRADES}, r AS (SELECT *, CASE WHEN trade_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, CASE WHEN trade_id % 3 > 0 THEN trade_id % 3 ELSE -1 END AS seq FROM t),
  h AS (SELECT *, CASE WHEN seq = -1 THEN sha256('{{"event_ts":"' || strftime(event_ts, '%Y-%m-%dT%H:%M:%S') || '.000000+00:00","price":"' || price::DECIMAL(28,8)::VARCHAR || '","side":"' || side || '","size":"' || size::DECIMAL(28,8)::VARCHAR
    || '","token_id":"' || token || '"}}') ELSE '' END AS trade_hash FROM r)
  SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY token, event_ts, seq, trade_hash ORDER BY ingested_at DESC, price DESC, size DESC, side DESC, trade_id DESC) = 1""",
    "merged_snapshots": f"""WITH {_TRADES}, b AS (SELECT token, event_ts, ingested_at, trade_id AS book_id, 3 AS n_bids, round(price + 0.01, 6) AS ask FROM t JOIN events ON trade_id = event_id WHERE event_type IN ('view', 'click'))
  SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY token, event_ts ORDER BY ingested_at DESC, book_id DESC) = 1""",
    "merged_candles": f"WITH {_TRADES}, {_CANDLES} SELECT token, '1d' AS width, start_ts, start_ts + to_days(1) AS ingested_at, open, close, volume FROM c",
    "market_tokens": f"WITH {_CLAIMS} SELECT market_id, outcome, arg_max(token_id, (since, token_id)) AS token_id FROM l JOIN o USING (token_id) WHERE market_id = existing_market_id AND outcome = existing_outcome GROUP BY ALL",
    "token_conflicts": f"WITH {_CLAIMS} SELECT DISTINCT market_id, outcome, token_id, existing_market_id, existing_outcome FROM l JOIN o USING (token_id) WHERE market_id <> existing_market_id OR outcome <> existing_outcome",
}
