"""Registered queries of payloads read as rows, and of the forecast models. Tests hold the payloads against plain Python
over all of them; customers are markets in one of eleven shapes, events are books and lists of trades in one of six."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models
from ..sources import catalog, clob
from .market_queries import _NOW, AT, _features, _features_sql
from .queries import _rounded, _table, trades

#: $i, $n, $s and $p stand for the customer's key, name and segment, and a price.
MARKETS = [
    '{"market_id": "m$i", "question": "$n?", "status": " Active ", "tokens": [{"token_id": $i, "outcome": "YES"}, {"tokenId": "t$i", "name": "NO"}, {"id": "u$i", "label": "NO"}, 5, {"outcome": "x"}], "updatedAt": "2024-01-0$d 00:00:00"}',
    '{"id": $i, "title": "", "question": " $n ", "resolved": true, "closed": true, "outcomes": "[\\"Yes\\", \\"No\\"]", "clobTokenIds": "[\\"a$i\\", \\"b$i\\", \\"c$i\\"]", "outcomePrices": "[\\"0.995\\", \\"0.005\\"]", "closedTime": "2024-02-0$dT00:00:00Z"}',
    '{"conditionId": "c$i", "closed": true, "outcomes": ["Up", "Down"], "clobTokenIds": ["x$i", null], "outcomePrices": [0.99, 0.99], "description": "$s"}',
    '{"marketId": "k$i", "active": true, "winningOutcome": " no ", "outcomes": ["Yes", "No"], "clobTokenIds": [$i, $i], "resolvedAt": 170406$d200, "created": "2023-12-31"}',
    '{"market_id": "", "id": 0, "condition_id": "z$i", "winningOutcome": 1, "outcomes": ["Red", "Blue"], "rules": "ends $s"}',
    '{"market_id": "w$i", "resolved_outcome": "Maybe", "outcomes": ["Red", "Blue"], "outcomePrices": ["1", "0"], "tokens": []}',
    '{"market_id": "v$i", "outcome": "Solo", "status": "", "resolved": "true", "updated_ts": "soon"}',
    '{"title": "no id $i"}',
    '[{"market_id": "list$i"}]',
    "{broken $i",
    '{"market_id": "q$i", "outcomes": ["A", "B", "C"], "outcomePrices": ["$p", "1.5", "none"], "winning_outcome": null, "resolvedOutcome": 7, "clobTokenIds": "nope", "category": {"a": 1}}',
]
#: $i, $v, $k and $t stand for the event's number, value, inner number and second.
BOOKS = [
    '{"timestamp": $t, "bids": [{"price": "0.$k", "size": "$v"}, ["0.2", 5], {"price": "0.$k", "amount": 1}, [1], "x"], "asks": [["0.9", "$v"], {"price": 0.95, "size": null}, {"price": 0.9, "size": 3}], "mid": null}',
    '{"ts": "2024-01-02T03:04:05Z", "bids": [], "asks": [[0.123456785, 2.5]], "mid": "0.$k"}',
    '{"bids": "none", "asks": [[0.7, 1], [0.6, 2], [0.65, "n"]]}',
    "[1, 2]",
    '{"event_ts": "$t000", "bids": [[0.1, 1], [0.3, 1], [0.3, 2], [0.2, 9]], "asks": [[0.4, 1], [0.35, 4], [0.35, 3]]}',
    "{bad",
]
TRADES = [
    '[{"timestamp": $t, "price": "0.$k", "size": $v, "side": "BID", "hash": "h$i"}, {"timestamp": "?", "price": 1, "size": 1}, 7]',
    '{"trades": [{"ts": "$t000", "price": 0.5, "amount": "$k", "side": "s", "seq": $i}, {"price": 0.5, "size": 1}], "token": "t$i"}',
    '{"data": {"createdAt": "2024-01-02", "price": "0.$k", "size": "1e2", "sequence": "$k"}}',
    '{"data": []}',
    "nothing",
    '{"trades": [{"event_ts": $t, "price": null, "size": 3}, {"event_ts": $t, "price": 0.123456785, "size": 0, "side": null, "id": 5, "seq": 1.5}]}',
]
CANDLES = '[{"start": "2024-01-01T00:00:00Z", "end": "2024-01-01T01:00:00Z", "open": "0.$k", "high": 1, "low": 0, "close": "0.5", "volume": $v}, {"start": $t, "end": $t, "open": 1, "high": 1, "low": 1, "close": 1, "volume": 1}, {"start_ts": $t, "end_ts": $t9, "o": "0.$k", "h": "x", "l": 0, "c": 0, "v": 0}]'


def _made(key, shapes, fill):
    raw = F.element_at(F.array(*map(F.lit, shapes)), (key % len(shapes) + 1).cast("int"))
    for name, value in fill.items():
        raw = F.replace(raw, F.lit(name), value)
    return raw


def market_payloads(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    fill = {"$i": key.cast("string"), "$n": F.col("c_name"), "$s": F.col("c_mktsegment"), "$d": (key % 9 + 1).cast("string"), "$p": F.when(key % 2 == 0, "0.991").otherwise("0.5")}
    return c.select(key.alias("key"), _made(key, MARKETS, fill).alias("payload"), F.expr(AT).alias("ingested_at"))


def event_payloads(spark, sf_dir, shapes):
    e = _table(spark, sf_dir, "events")
    second = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").cast("string")
    fill = {"$i": F.col("event_id").cast("string"), "$v": F.col("value").cast("string"), "$k": F.get_json_object("props", "$.k"), "$t": second}
    return e.select("event_id", _made(F.col("event_id"), shapes, fill).alias("payload"), F.expr("TIMESTAMP '2024-01-01 00:00:00'").alias("received"))


def _seconds(df, *cols):
    return df.withColumns({c: F.coalesce(F.unix_seconds(c), F.lit(-1).cast("long")) for c in cols})


def _catalog(spark, sf_dir):
    got = catalog.latest(catalog.markets(market_payloads(spark, sf_dir)).drop("ingested_at", "key"))
    return _seconds(got, "created_ts", "updated_ts", "resolution_ts")


def _outcomes(spark, sf_dir):
    return _seconds(catalog.outcomes(market_payloads(spark, sf_dir)), "resolved_ts")


def _books(spark, sf_dir):
    b = clob.books(event_payloads(spark, sf_dir, BOOKS), depth=2)
    side = lambda c: F.concat_ws(" ", F.transform(c, lambda x: F.concat_ws("x", x["price"].cast("string"), x["size"].cast("string")))).alias(c)
    return _seconds(b.select("event_id", "event_ts", side("bids"), side("asks"), F.col("mid").cast("string").alias("mid")), "event_ts")


def _payload_trades(spark, sf_dir):
    t = clob.trades(event_payloads(spark, sf_dir, TRADES).drop("received"))
    return _seconds(t.withColumns({c: F.col(c).cast("string") for c in ("price", "size")}), "event_ts")


def _payload_candles(spark, sf_dir):
    c = clob.candles(event_payloads(spark, sf_dir, [CANDLES]).drop("received"))
    return _seconds(c.withColumns({k: F.col(k).cast("string") for k in ("open", "high", "low", "close", "volume")}), "start_ts", "end_ts")


def _forecasts_now(spark, sf_dir):
    grid = trades(spark, sf_dir).select("token").distinct().withColumn("t", F.expr(AT))
    f = models.forecast(_features(spark, sf_dir, grid).withColumn("price_prob", F.col("mid_price")))
    f = f.withColumn("drivers", F.concat_ws(",", F.transform("drivers", lambda d: d["feature"]))).withColumn("no_trade_flags", F.concat_ws(",", "no_trade_flags"))
    return _rounded(f.select("token", "p_a", "p_b", "p_raw", "drivers", "no_trade_flags"), "p_a", "p_b", "p_raw")


def _flags(spark, sf_dir):
    grid = trades(spark, sf_dir).select("token").distinct().withColumn("t", F.expr(AT))
    f = models.forecast(_features(spark, sf_dir, grid).withColumn("price_prob", F.col("mid_price")))
    return f.select(F.explode_outer("no_trade_flags").alias("flag")).groupBy(F.coalesce("flag", F.lit("")).alias("flag")).agg(F.count("*").alias("n"))


QUERIES = {
    "catalog_markets": _catalog,
    "catalog_tokens": lambda s, d: catalog.tokens(market_payloads(s, d)),
    "catalog_outcomes": _outcomes,
    "payload_books": _books,
    "payload_trades": _payload_trades,
    "payload_candles": _payload_candles,
    "model_forecasts": _forecasts_now,
    "no_trade_flags": _flags,
}
_INPUTS = {
    "mid_price_centered": ("least(greatest(coalesce(mid_price, 0.5), 0), 1) - 0.5", models.MICRO["mid_price_centered"]),
    "book_imbalance_1": ("least(greatest(coalesce(book_imbalance_1, 0), -1), 1)", models.MICRO["book_imbalance_1"]),
    "return_5m": ("least(greatest(coalesce(return_5m, 0), -0.5), 0.5)", models.MICRO["return_5m"]),
    "realized_vol_1h": ("least(greatest(coalesce(realized_vol_1h, 0), 0), 2)", models.MICRO["realized_vol_1h"]),
    "spread_bps_scaled": ("least(greatest(coalesce(spread_bps, 0), 0), 2000) / 1000", models.MICRO["spread_bps_scaled"]),
    "trade_count_5m_scaled": ("least(coalesce(trade_count_5m, 0), 100) / 100.0::DOUBLE", models.MICRO["trade_count_5m_scaled"]),
    "volume_5m_scaled": ("ln(1 + least(coalesce(volume_5m, 0), 1000000)) / 10", models.MICRO["volume_5m_scaled"]),
    "stale_trade_scaled": ("-least(coalesce(stale_seconds_last_trade, 3600), 14400) / 3600.0::DOUBLE", models.MICRO["stale_trade_scaled"]),
    "stale_book_scaled": ("-least(coalesce(stale_seconds_last_book, 3600), 14400) / 3600.0::DOUBLE", models.MICRO["stale_book_scaled"]),
}
_FLAGS = """concat_ws(',', CASE WHEN coalesce(spread_bps, 0) >= 1500 OR top_depth_bid + top_depth_ask < 1 THEN 'illiquid' END, CASE WHEN spread_bps IS NULL OR stale_seconds_last_trade IS NULL OR stale_seconds_last_book IS NULL THEN 'insufficient_data' END,
  CASE WHEN greatest(coalesce(stale_seconds_last_trade, 0), coalesce(stale_seconds_last_book, 0)) >= 14400 THEN 'stale' END)"""
_MODELS = f"""{_features_sql(_NOW)}, ins AS (SELECT token, CASE WHEN mid_price IS NOT NULL THEN least(greatest(mid_price, 0), 1) END AS p_a, {", ".join(f"({e})::DOUBLE AS i_{k}" for k, (e, _) in _INPUTS.items())}, {_FLAGS} AS flags FROM f),
  pb AS (SELECT *, 1 / (1 + exp(-({" + ".join(f"{w} * i_{k}" for k, (_, w) in _INPUTS.items())}))) AS p_b FROM ins),
  z AS (SELECT *, 1 / (1 + exp(-(-0.15 + 0.35 * (1 - abs(p_a - p_b)) + 0.55 * p_a + 1.05 * p_b))) AS p_raw, [{", ".join(f"{{'f': 'micro.{k}', 'c': abs({w} * i_{k})}}" for k, (_, w) in _INPUTS.items())}, {{'f': 'meta.agreement', 'c': 0.35 * (1 - abs(p_a - p_b))}}, {{'f': 'meta.p_a', 'c': 0.55 * p_a}}, {{'f': 'meta.p_b', 'c': 1.05 * p_b}}] AS parts FROM pb)"""
ORACLES = {
    "model_forecasts": f"""{_MODELS}, y AS (SELECT token, unnest(parts) AS x FROM z WHERE p_a IS NOT NULL), od AS (SELECT token, string_agg(x.f, ',' ORDER BY x.c DESC, x.f) AS drivers FROM (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY token ORDER BY x.c DESC, x.f) <= 5) GROUP BY token)
  SELECT z.token, round(p_a, 6) AS p_a, round(p_b, 6) AS p_b, round(p_raw, 6) AS p_raw, coalesce(drivers, '') AS drivers, flags AS no_trade_flags FROM z LEFT JOIN od ON z.token = od.token""",
    "no_trade_flags": f"{_MODELS} SELECT unnest(string_split(flags, ',')) AS flag, count(*) AS n FROM z GROUP BY 1",
}
