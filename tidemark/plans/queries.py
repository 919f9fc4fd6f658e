"""Registered queries of the as-of operators on the given tables, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, portfolio, scoring

FIRST = "TIMESTAMP_NTZ '2024-01-02 00:00:00'"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    at = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    late = F.make_dt_interval(hours=(F.col("event_id") % 7).cast("int"))
    size = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("user_id").alias("token"), F.col("event_id").alias("trade_id"), at.alias("event_ts"), (at + late).alias("ingested_at"), (F.col("value") / 500).alias("price"), size.alias("size"))


_TRADES = """t AS (SELECT user_id AS token, event_id AS trade_id, date_trunc('hour', ts) AS event_ts,
  date_trunc('hour', ts) + to_hours((event_id % 7)::INT) AS ingested_at, value / 500 AS price, json_extract_string(props, '$.k')::BIGINT AS size FROM events)"""


def _asof(spark, sf_dir):
    rows = trades(spark, sf_dir)
    spine = rows.select("token").distinct().select("token", F.explode(F.expr(f"transform(sequence(0, 28), d -> {FIRST} + make_dt_interval(d))")).alias("t"))
    got = asof.asof_join(spine, rows, "token", "trade_id", ["price"])
    return got.withColumn("trade_id", F.coalesce("trade_id", F.lit(-1).cast("long")))


def _latest(spark, sf_dir):
    return asof.latest(asof.gate(trades(spark, sf_dir), F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"), 300), "token", "trade_id", ["price"])


def _volume(spark, sf_dir):
    t = "TIMESTAMP_NTZ '2024-01-20 00:00:00'"
    rows = asof.gate(trades(spark, sf_dir), F.expr(t), 300).where(F.col("event_ts") >= F.expr(f"{t} - INTERVAL 24 HOURS"))
    return rows.groupBy("token").agg(F.round(F.sum(F.col("price") * F.col("size")), 6).alias("volume"), F.count("*").alias("trades"))


def _candles(spark, sf_dir):
    c = asof.candles(trades(spark, sf_dir), "token", "trade_id", "day")
    return c.withColumn("start_ts", F.col("start_ts").cast("timestamp_ntz"))


def _volatility(spark, sf_dir):
    return asof.realized_volatility(_candles(spark, sf_dir), "token").withColumn("volatility", F.round("volatility", 6))


def _forecasts(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", "lang", ((F.col("n_chars") % 1000) / 999.0).alias("p"))
    return d.join(_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")


_FORECASTS = "f AS (SELECT doc_id, lang, (n_chars % 1000) / 999.0 AS p, quality AS y FROM documents JOIN labels USING (doc_id))"


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _cap(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return scoring.capped(d, "source", [F.desc("n_chars"), F.asc("doc_id")], 3)


def _expanding(spark, sf_dir):
    f = _forecasts(spark, sf_dir).select((F.col("doc_id") % 30).alias("t"), "y")
    return _rounded(scoring.expanding_rate(f), "rate")


def ledger(spark, sf_dir):
    side = F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY")
    qty = F.col("l_quantity")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("token"), side.alias("side"), qty.alias("quantity"), (F.col("l_extendedprice") / qty).alias("price"), F.col("l_extendedprice").cast("decimal(18,2)").alias("notional"), (F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_tax").cast("decimal(6,2)")).alias("fee"))


_LEDGER = """g AS (SELECT l_orderkey, l_linenumber, l_partkey AS token, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
  l_quantity AS quantity, l_extendedprice / l_quantity AS price, l_extendedprice::DECIMAL(18,2) AS notional, l_extendedprice::DECIMAL(18,2) * l_tax::DECIMAL(6,2) AS fee FROM lineitem)"""


def _positions(spark, sf_dir):
    return portfolio.positions(ledger(spark, sf_dir), ["token", "side"])


def _first(spark, sf_dir):
    got = portfolio.first_fills(ledger(spark, sf_dir), ["token", "side"], ["l_orderkey", "l_linenumber"])
    return got.select("token", "side", "l_orderkey", "l_linenumber", "quantity")


def _concentration(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    per = o.groupBy("c_mktsegment", "o_custkey").agg(F.sum("o_totalprice").alias("amount"))
    return _rounded(portfolio.concentration(per, "c_mktsegment", "amount"), "top1_share", "top3_share").withColumn("total", F.round("total", 2))


QUERIES = {
    "asof_latest_trade": _asof,
    "latest_per_token": _latest,
    "volume_24h": _volume,
    "candles_daily": _candles,
    "realized_volatility": _volatility,
    "calibration_bins": lambda s, d: _rounded(scoring.calibration(_forecasts(s, d)), "mean_p", "mean_y"),
    "forecast_metrics": lambda s, d: _rounded(scoring.metrics(_forecasts(s, d), "lang"), "brier", "log_loss", "sharpness"),
    "source_cap": _cap,
    "expanding_rate": _expanding,
    "position_fold": _positions,
    "ledger_first_fills": _first,
    "signed_exposure": lambda s, d: portfolio.exposure(ledger(s, d), "token").withColumn("exposure", F.round("exposure", 2)),
    "segment_concentration": _concentration,
}
_GATE = "event_ts <= TIMESTAMP '2024-01-20' AND ingested_at <= TIMESTAMP '2024-01-20 00:05:00'"
_CANDLES = """c AS (SELECT token, date_trunc('day', event_ts)::TIMESTAMP AS start_ts, arg_min(price, (event_ts, trade_id)) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, (event_ts, trade_id)) AS close, sum(size)::BIGINT AS volume FROM t GROUP BY 1, 2)"""
ORACLES = {
    "asof_latest_trade": f"""WITH {_TRADES}, s AS (SELECT token, TIMESTAMP '2024-01-02' + to_days(d::INT) AS t FROM (SELECT DISTINCT token FROM t), range(0, 29) r(d)),
  j AS (SELECT s.token, s.t, t.event_ts, trade_id, price, row_number() OVER (PARTITION BY s.token, s.t ORDER BY event_ts DESC NULLS LAST, ingested_at DESC, trade_id DESC) AS k
  FROM s LEFT JOIN t ON s.token = t.token AND t.event_ts <= s.t AND t.ingested_at <= s.t + INTERVAL 300 SECONDS) SELECT token, t, event_ts, coalesce(trade_id, -1) AS trade_id, price FROM j WHERE k = 1""",
    "latest_per_token": f"""WITH {_TRADES} SELECT token, event_ts, trade_id, price FROM t WHERE {_GATE} QUALIFY row_number() OVER (PARTITION BY token ORDER BY event_ts DESC, ingested_at DESC, trade_id DESC) = 1""",
    "volume_24h": f"WITH {_TRADES} SELECT token, round(sum(price * size), 6) AS volume, count(*) AS trades FROM t WHERE {_GATE} AND event_ts >= TIMESTAMP '2024-01-19' GROUP BY token",
    "candles_daily": f"WITH {_TRADES}, {_CANDLES} SELECT * FROM c",
    "realized_volatility": f"""WITH {_TRADES}, {_CANDLES}, r AS (SELECT token, ln(close / lag(close) OVER (PARTITION BY token ORDER BY start_ts)) AS r FROM c WHERE close > 0)
  SELECT token, CASE WHEN count(r) >= 2 THEN round(stddev_pop(r), 6) END AS volatility FROM r GROUP BY token""",
    "calibration_bins": f"""WITH {_FORECASTS}, g AS (SELECT least(floor(p * 10), 9)::INT AS bin, avg(p) AS a, avg(y) AS b, count(*) AS n FROM f GROUP BY 1)
  SELECT r.i::INT AS bin, round(coalesce(a, 0), 6) AS mean_p, round(coalesce(b, 0), 6) AS mean_y, coalesce(n, 0) AS n FROM range(0, 10) r(i) LEFT JOIN g ON r.i = g.bin""",
    "forecast_metrics": f"""WITH {_FORECASTS}, q AS (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM f) SELECT lang, round(avg((p - y) * (p - y)), 6) AS brier,
  round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss, round(var_pop(p), 6) AS sharpness, count(*) AS n FROM q GROUP BY lang""",
    "source_cap": "SELECT * FROM (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents) WHERE rank <= 3",
    "expanding_rate": f"""WITH {_FORECASTS}, g AS (SELECT doc_id % 30 AS t, count(*) AS n, sum(y) AS s FROM f GROUP BY 1) SELECT t, (SELECT coalesce(sum(n), 0)::BIGINT FROM g b WHERE b.t < g.t) AS n_train,
  round((SELECT sum(s) / sum(n) FROM g b WHERE b.t < g.t), 6) AS rate FROM g""",
    "position_fold": f"""WITH {_LEDGER}, p AS (SELECT token, side, sum(quantity) AS quantity, sum(notional)::DOUBLE AS cost, sum(fee)::DOUBLE AS fees, count(*) AS entries FROM g GROUP BY ALL)
  SELECT *, cost / quantity AS avg_cost FROM p WHERE quantity > 0""",
    "ledger_first_fills": f"WITH {_LEDGER} SELECT token, side, l_orderkey, l_linenumber, quantity FROM g QUALIFY row_number() OVER (PARTITION BY token, side ORDER BY l_orderkey, l_linenumber) = 1",
    "signed_exposure": f"WITH {_LEDGER} SELECT token, round(sum(CASE WHEN side = 'SELL' THEN -quantity * price ELSE quantity * price END), 2) AS exposure FROM g GROUP BY token",
    "segment_concentration": """WITH a AS (SELECT c_mktsegment, o_custkey, sum(o_totalprice) AS amount FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY amount DESC) AS k FROM a) SELECT c_mktsegment, round(sum(amount), 2) AS total,
  round(sum(amount) FILTER (k = 1) / sum(amount), 6) AS top1_share, round(sum(amount) FILTER (k <= 3) / sum(amount), 6) AS top3_share FROM k GROUP BY c_mktsegment""",
}
