"""Registered queries of scans, runs, snapshots and ranks, with the same in DuckDB's SQL. Customers are markets, orders
their tokens, runs and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry
from .allocation_queries import candidates
from .queries import _rounded, _table


def _markets(spark, sf_dir):
    c, key = _table(spark, sf_dir, "customer"), F.col("c_custkey")
    field = lambda k, every, yes, no: F.when(key % every == 0, F.lit(f'"{k}": {yes}, ')).when(key % every == 1, F.lit(f'"{k}": {no}, ')).otherwise("")
    payload = F.concat(F.lit("{"), field("active", 5, "true", '"True"'), field("closed", 7, "false", "true"), field("enableOrderBook", 11, "true", "false"), field("acceptingOrders", 13, "true", "null"), F.when(key % 3 == 0, F.concat(F.lit('"conditionId": "c'), key, F.lit('", '))).otherwise('"conditionId": "", '), F.lit('"z": 0}'))
    day = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 17 AS int))")
    market = F.concat(F.when(key % 2 == 0, "0x").otherwise("m"), key)
    return c.select(market.alias("market_id"), F.when(key % 19 == 0, "paused").otherwise("Active").alias("status"), payload.alias("payload"), F.when(key % 4 > 0, day).alias("updated_ts"), F.when(key % 8 > 0, F.expr("TIMESTAMP_NTZ '2023-12-01 00:00:00'")).alias("created_ts"))


def _tokens(spark, sf_dir):
    market = F.concat(F.when(F.col("o_custkey") % 2 == 0, "0x").otherwise("m"), F.col("o_custkey"))
    return _table(spark, sf_dir, "orders").select(market.alias("market_id"), F.concat(F.lit("t"), F.floor(F.col("o_orderkey") / 3)).alias("token_id"))


def _eligible(spark, sf_dir):
    got = registry.eligible_tokens(_tokens(spark, sf_dir), _markets(spark, sf_dir), 1000)
    return got.select("token_id", F.coalesce("condition_id", F.lit("")).alias("condition_id"), F.coalesce("sort_ts", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")).alias("sort_ts"))


def _runs(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("decision_ts"))
    made = o.select(F.col("o_orderkey").alias("run_id"), F.concat("o_orderpriority", F.lit("/"), F.col("o_custkey") % 50).alias("version"), (F.col("o_orderkey") * 7 % 1000).alias("selection_run_id"))
    return registry.latest_runs(made, runs, F.expr("TIMESTAMP_NTZ '1995-01-01 00:00:00'"), F.expr("TIMESTAMP_NTZ '1996-06-30 00:00:00'"))


def _snapshots(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp_ntz")
    snaps = o.select(F.col("o_custkey").alias("market_id"), F.concat(F.lit("fs"), F.col("o_orderkey") % 2).alias("version"), F.col("o_orderkey").alias("id"), at.alias("asof_ts"), (at + F.expr("make_dt_interval(cast(o_orderkey % 40 AS int))")).alias("bound_ts"), F.col("o_totalprice").alias("features"))
    spine = o.select(F.col("o_custkey").alias("market_id")).distinct().select("market_id", F.explode(F.array(F.lit("fs0"), F.lit("fs1"))).alias("version"), F.explode(F.expr("transform(sequence(1992, 1998), y -> make_timestamp_ntz(y, 7, 1, 0, 0, 0))")).alias("t"))
    got = registry.snapshots_asof(spine, snaps, F.col("t") + F.expr("INTERVAL 5 DAYS"))
    return got.withColumns({"id": F.coalesce("id", F.lit(-1).cast("long")), "features": F.coalesce("features", F.lit(-1.0))})


def _ranks(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("market_id", F.col("token_id")).withColumn("deep_score", F.round(F.col("token_id") % 11 / 10.0, 1))
    first = registry.ranked(c.select("market_id", "screen_score", "lq", "volume", "deep_score"), registry.screen_order(), "screen_rank")
    return registry.ranked(first, registry.deep_order(), "deep_rank").select("market_id", "screen_rank", "deep_rank")


def _events(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    stage = F.element_at(F.array(F.lit("risk"), F.lit("forecast"), F.lit("other"), F.lit("execution"), F.lit("decision")), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", F.col("user_id").alias("run_id"), stage.alias("stage"), F.when(F.col("event_id") % 6 > 0, F.date_trunc("day", "ts").cast("timestamp_ntz")).alias("generated_at"), F.md5(F.col("event_id").cast("string")).alias("payload_hash"))


def _timeline(spark, sf_dir):
    e = registry.in_window(_events(spark, sf_dir), "generated_at", F.expr("TIMESTAMP_NTZ '2024-01-03 00:00:00'"), F.expr("TIMESTAMP_NTZ '2024-01-25 00:00:00'"))
    return registry.ranked(e, registry.timeline_order(), "place").select("event_id", "stage", "place")


def _signals(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    key = F.col("event_id")
    flags = F.array(F.when(key % 3 == 0, F.lit(" stale")).otherwise(F.lit("")), F.when(key % 29 == 0, F.lit("illiquid")).otherwise(F.lit("noted")))
    warnings = F.when(key % 4 == 0, F.array(F.struct(F.col("event_type").alias("code"), F.lit("m ").alias("message")), F.struct(F.lit(" ").alias("code"), F.lit(None).cast("string").alias("message"))))
    status = F.when(key % 97 == 0, "FAIL").when(key % 31 == 0, "WARN").otherwise("OK")
    same = F.when(F.col("user_id") % 3 == 0, F.lit("h")).otherwise(F.concat(F.lit("h"), key % 2))
    rows = e.select(F.col("user_id").alias("run_id"), flags.alias("flags"), warnings.alias("warnings"), status.alias("status"), F.when(key % 5 > 0, same).alias("hash"))
    s = registry.signals(rows, "run_id")
    return s.select("run_id", "status", F.coalesce("hash", F.lit("")).alias("hash"), "mixed_hash", F.concat_ws(",", "flags").alias("flags"), F.concat_ws(",", F.transform("warnings", lambda w: F.concat_ws(":", w["code"], w["message"]))).alias("warnings"))


def _kpis(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "N", "FILLED").when(F.col("l_returnflag") == "R", "REJECTED").otherwise("OPEN")
    k = registry.kpis(li.select(F.col("l_suppkey").alias("run_id"), F.col("l_extendedprice").cast("decimal(18,2)").alias("notional"), status.alias("status")), "run_id")
    return _rounded(k.withColumns({c: F.col(c).cast("double") for c in ("planned", "executed")}), "fill_rate")


QUERIES = {"eligible_tokens": _eligible, "latest_selection_runs": _runs, "snapshots_asof": _snapshots, "global_ranks": _ranks, "artifact_timeline": _timeline, "run_signals": _signals, "pipeline_kpis": _kpis}
_MARKET = "CASE WHEN {0} % 2 = 0 THEN '0x' ELSE 'm' END || {0}"
ORACLES = {
    "eligible_tokens": f"""WITH m AS (SELECT {_MARKET.format("c_custkey")} AS market_id, c_custkey AS k, CASE WHEN c_custkey % 4 > 0 THEN TIMESTAMP '2024-01-01' + to_days((c_custkey % 17)::INT) WHEN c_custkey % 8 > 0 THEN TIMESTAMP '2023-12-01' END AS sort_ts FROM customer
    WHERE c_custkey % 19 > 0 AND c_custkey % 7 <> 1 AND c_custkey % 11 <> 1),
  x AS (SELECT 't' || (o_orderkey // 3) AS token_id, CASE WHEN k % 3 = 0 THEN 'c' || k WHEN k % 2 = 0 THEN market_id ELSE '' END AS condition_id, sort_ts, market_id FROM orders JOIN m ON k = o_custkey),
  b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY token_id ORDER BY sort_ts DESC NULLS LAST, market_id DESC) = 1)
  SELECT token_id, condition_id, coalesce(sort_ts, TIMESTAMP '1970-01-01') AS sort_ts FROM (SELECT * FROM b ORDER BY b.sort_ts DESC NULLS LAST, token_id LIMIT 1000)""",
    "latest_selection_runs": """SELECT o_orderpriority || '/' || (o_custkey % 50) AS version, o_orderkey * 7 % 1000 AS selection_run_id, o_orderdate::TIMESTAMP AS decision_ts FROM orders WHERE o_orderdate::TIMESTAMP BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-06-30'
  QUALIFY row_number() OVER (PARTITION BY o_orderpriority || '/' || (o_custkey % 50) ORDER BY o_orderdate DESC, o_orderkey * 7 % 1000 DESC) = 1""",
    "snapshots_asof": """WITH s AS (SELECT DISTINCT o_custkey AS market_id, v.version, make_timestamp(y.y, 7, 1, 0, 0, 0) AS t FROM orders, (VALUES ('fs0'), ('fs1')) v(version), range(1992, 1999) y(y)),
  n AS (SELECT o_custkey AS market_id, 'fs' || (o_orderkey % 2) AS version, o_orderkey AS id, o_orderdate::TIMESTAMP AS a, o_orderdate::TIMESTAMP + to_days((o_orderkey % 40)::INT) AS b, o_totalprice AS f FROM orders),
  j AS (SELECT s.*, id, b, f, row_number() OVER (PARTITION BY s.market_id, s.version, s.t ORDER BY a DESC NULLS LAST, id DESC) AS k FROM s LEFT JOIN n ON s.market_id = n.market_id AND s.version = n.version AND a <= s.t)
  SELECT market_id, version, t, CASE WHEN b <= t + to_days(5) THEN id ELSE -1 END AS id, CASE WHEN b <= t + to_days(5) THEN f ELSE -1 END AS features FROM j WHERE k = 1""",
    "global_ranks": """WITH i AS (SELECT o_orderkey AS market_id, round(floor(o_totalprice % 100) / 100, 2) AS s, (o_orderkey % 97) / 97.0::DOUBLE AS lq, o_totalprice AS v, round((o_orderkey % 11) / 10.0, 1) AS d FROM orders)
  SELECT market_id, row_number() OVER (ORDER BY s DESC, lq DESC, v DESC, market_id) AS screen_rank, row_number() OVER (ORDER BY d DESC, s DESC, v DESC, market_id) AS deep_rank FROM i""",
    "artifact_timeline": """WITH e AS (SELECT event_id, user_id, ['risk', 'forecast', 'other', 'execution', 'decision'][event_id % 5 + 1] AS stage, [7, 1, 99, 4, 2][event_id % 5 + 1] AS o, CASE WHEN event_id % 6 > 0 THEN date_trunc('day', ts) END AS g FROM events)
  SELECT event_id, stage, row_number() OVER (ORDER BY o, g NULLS FIRST, user_id, md5(event_id::VARCHAR)) AS place FROM e WHERE g IS NULL OR g BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25'""",
    "run_signals": """WITH e AS (SELECT user_id AS run_id, event_id AS k, event_type, CASE WHEN event_id % 5 > 0 THEN CASE WHEN user_id % 3 = 0 THEN 'h' ELSE 'h' || (event_id % 2) END END AS h FROM events)
  SELECT run_id, CASE WHEN bool_or(k % 97 = 0) THEN 'FAIL' WHEN bool_or(k % 31 = 0) THEN 'WARN' ELSE 'OK' END AS status, CASE WHEN min(h) = max(h) THEN min(h) ELSE '' END AS hash, coalesce(min(h) <> max(h), FALSE) AS mixed_hash,
    concat_ws(',', CASE WHEN bool_or(k % 29 = 0) THEN 'illiquid' END, CASE WHEN bool_or(k % 29 > 0) THEN 'noted' END, CASE WHEN bool_or(k % 3 = 0) THEN 'stale' END) AS flags,
    array_to_string(list_sort(list_concat(coalesce(list(DISTINCT event_type || ':m') FILTER (k % 4 = 0), []), CASE WHEN bool_or(k % 4 = 0) THEN ['unknown_warning:'] ELSE [] END)), ',') AS warnings FROM e GROUP BY run_id""",
    "pipeline_kpis": """SELECT l_suppkey AS run_id, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS planned, coalesce(sum(l_extendedprice::DECIMAL(18,2)) FILTER (l_returnflag = 'N'), 0)::DOUBLE AS executed,
  round(coalesce(sum(l_extendedprice::DECIMAL(18,2)) FILTER (l_returnflag = 'N'), 0)::DOUBLE / sum(l_extendedprice::DECIMAL(18,2))::DOUBLE, 6) AS fill_rate, count(*) AS n_planned, count(*) FILTER (l_returnflag = 'N') AS n_filled, count(*) FILTER (l_returnflag = 'R') AS n_rejected FROM lineitem GROUP BY 1""",
}
