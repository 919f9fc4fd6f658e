"""Registered queries of decisions, selection, allocation and risk, with the same in DuckDB's SQL. Orders stand for
forecasts: a month of them is a run, a customer is a market."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allocation
from .queries import _rounded, _table


def candidates(spark, sf_dir):
    o, key = _table(spark, sf_dir, "orders"), F.col("o_orderkey")
    bucket = F.element_at(F.array(*map(F.lit, ["0_24h", "1_7d", "7_30d", " 30d_plus ", "", "soon"])), (F.col("o_custkey") % 6 + 1).cast("int"))
    return o.select(
        F.date_format("o_orderdate", "yyyy-MM").alias("run"), F.when(key % 9 == 0, key - 1).otherwise(key).alias("market_id"), key.alias("token_id"), F.when(key % 8 > 0, F.col("o_orderpriority")).alias("category"),
        F.when(F.col("o_custkey") % 7 > 0, (F.col("o_custkey") % 7).cast("string")).otherwise("").alias("group_id"), bucket.alias("ttr"), F.round(F.floor(F.col("o_totalprice") % 100) / 100, 2).alias("screen_score"), ((key % 97) / 97.0).alias("lq"), F.col("o_totalprice").alias("volume"),
    )


def _selected(spark, sf_dir):
    got = allocation.diversified(candidates(spark, sf_dir), k=40, max_per_category=9, max_per_group=7)
    return got.select("run", "rank", "market_id", "token_id", "screen_score")


def _quotas(spark, sf_dir):
    mix = _table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("run"), F.col("o_orderpriority").alias("bucket")).agg(F.count("*").alias("weight"))
    return allocation.quotas(mix, 37)


def forecasts(spark, sf_dir):
    o, key = _table(spark, sf_dir, "orders"), F.col("o_orderkey")
    p = F.floor(F.col("o_totalprice") % 1000) / 1000
    cal = p + (key % 41 - 20) / 400.0
    flags = F.when(key % 13 == 0, F.array(F.lit(" stale "), F.lit("illiquid"))).when(key % 17 == 0, F.array(F.lit("noted"), F.lit("")))
    return o.select(F.date_format("o_orderdate", "yyyy-MM").alias("run"), F.col("o_custkey").alias("market_id"), key.alias("token_id"), F.when(key % 8 > 0, F.col("o_orderpriority")).alias("category"), p.alias("price_prob"), cal.alias("p_cal"), (cal - 0.02).alias("low_90"), (cal + 0.02).alias("high_90"), flags.alias("flags"))


def _decided(spark, sf_dir):
    return allocation.decisions(forecasts(spark, sf_dir), min_edge_bps=50, robust=True, most=200)


def _decisions(spark, sf_dir):
    d = _decided(spark, sf_dir)
    return _rounded(d.select("run", "rank", "market_id", "token_id", "action", "edge", "edge_bps", "edge_low_90", "edge_high_90", F.concat_ws(",", "reasons").alias("reasons"), F.concat_ws(",", "quality_flags").alias("quality_flags")), "edge", "edge_low_90", "edge_high_90").withColumn("edge_bps", F.round("edge_bps", 4))


def _plan(spark, sf_dir):
    return allocation.trade_plan(_decided(spark, sf_dir), max_orders=60, max_total=1200, max_market=60, max_category=300, fixed=None)


def _orders(spark, sf_dir):
    p = _plan(spark, sf_dir).where("reason IS NULL")
    return p.select("run", "rank", "market_id", "token_id", "side", F.round("price", 6).alias("price"), F.col("notional").cast("double").alias("notional"), F.col("quantity").cast("double").alias("quantity"))


def _skips(spark, sf_dir):
    return _plan(spark, sf_dir).where("reason IS NOT NULL").groupBy("run", "reason").agg(F.count("*").alias("n"))


def _risk(spark, sf_dir):
    o = _plan(spark, sf_dir).where("reason IS NULL").select("run", "rank", "market_id", "token_id", "category", "notional", "quality_flags")
    runs = o.select("run").distinct()
    held = {"900001": 180.0, "900002": 170.0, "900003": 160.0}
    totals = F.create_map(*[F.lit(x) for kv in held.items() for x in kv])
    guards = F.when(F.substring("run", 6, 2) == "07", F.array(F.lit("performance_concentration_top1_breach"))).otherwise(F.array().cast("array<string>"))
    hooks = runs.select("run", F.lit(510.0).alias("total"), totals.alias("markets"), F.create_map(F.lit("1-URGENT"), F.lit(100.0)).alias("categories"), guards.alias("guards"))
    cold = _table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.lit("market").alias("kind"), F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 20 == 0, "critical_loss").otherwise("rested").alias("flag"))
    return allocation.risk(o, hooks, cold, max_total=1000, max_market=40, max_category=250, top1=0.35, top3=0.9, least=5)


def _verdicts(spark, sf_dir):
    r = _risk(spark, sf_dir)
    return r.select("run", "rank", "token_id", "verdict", F.col("approved").cast("double").alias("approved"), F.concat_ws(",", "reasons").alias("reasons"))


def _summary(spark, sf_dir):
    s = allocation.risk_summary(_risk(spark, sf_dir))
    return s.withColumns({c: F.col(c).cast("double") for c in ("requested", "approved", "blocked")})


QUERIES = {
    "bucket_quotas": _quotas,
    "diversified_selection": _selected,
    "decisions": _decisions,
    "trade_plan_orders": _orders,
    "trade_plan_skips": _skips,
    "risk_verdicts": _verdicts,
    "risk_summary": _summary,
}
_CANDIDATES = """i AS (SELECT strftime(o_orderdate, '%Y-%m') AS run, CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS market_id, o_orderkey AS token_id, CASE WHEN o_orderkey % 8 > 0 THEN o_orderpriority ELSE 'unknown' END AS category,
  CASE WHEN o_custkey % 7 > 0 THEN (o_custkey % 7)::VARCHAR ELSE 'unknown' END AS grp, ['0_24h', '1_7d', '7_30d', '30d_plus', 'unknown', 'unknown'][o_custkey % 6 + 1] AS bucket, round(floor(o_totalprice % 100) / 100, 2) AS screen_score, (o_orderkey % 97) / 97.0::DOUBLE AS lq, o_totalprice AS volume FROM orders),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY screen_score DESC, lq DESC, volume DESC, market_id) AS place FROM i),
  q(bucket, turn, quota) AS (VALUES ('0_24h', 1, 10), ('1_7d', 2, 14), ('7_30d', 3, 10), ('30d_plus', 4, 4), ('unknown', 5, 2)),
  st AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY turn, place) AS step FROM (SELECT ranked.*, turn, quota FROM ranked JOIN q USING (bucket) UNION ALL SELECT ranked.*, 99, 1000000 FROM ranked)),
  g AS (SELECT run, 0 AS step, [{'place': 0, 'market_id': 0::BIGINT, 'category': '', 'grp': '', 'bucket': ''}][2:] AS got FROM (SELECT DISTINCT run FROM i) UNION ALL
    SELECT g.run, st.step, CASE WHEN len(got) < 40 AND NOT list_contains(list_transform(got, lambda x: x.market_id), st.market_id) AND (turn = 99 OR len(list_filter(got, lambda x: x.bucket = st.bucket)) < quota) AND len(list_filter(got, lambda x: x.category = st.category)) < 9
      AND len(list_filter(got, lambda x: x.grp = st.grp)) < 7 THEN list_append(got, {'place': st.place, 'market_id': st.market_id, 'category': st.category, 'grp': st.grp, 'bucket': st.bucket}) ELSE got END FROM g JOIN st ON g.run = st.run AND st.step = g.step + 1),
  ends AS (SELECT run, arg_max(got, step) AS got FROM g GROUP BY run)"""
_DECIDED = """fc AS (SELECT strftime(o_orderdate, '%Y-%m') AS run, o_custkey AS market_id, o_orderkey AS token_id, CASE WHEN o_orderkey % 8 > 0 THEN o_orderpriority END AS category, floor(o_totalprice % 1000) / 1000 AS price_prob,
  floor(o_totalprice % 1000) / 1000 + (o_orderkey % 41 - 20) / 400.0::DOUBLE AS p_cal, CASE WHEN o_orderkey % 13 = 0 THEN 'illiquid,stale' WHEN o_orderkey % 17 = 0 THEN 'noted' ELSE '' END AS quality_flags FROM orders),
  e AS (SELECT *, p_cal - price_prob AS edge, (p_cal - price_prob) * 10000 AS edge_bps, (p_cal - 0.02::DOUBLE) - price_prob AS edge_low_90, (p_cal + 0.02::DOUBLE) - price_prob AS edge_high_90, quality_flags = 'illiquid,stale' AS bad FROM fc),
  a AS (SELECT *, CASE WHEN bad THEN 'NO_TRADE' WHEN edge_bps >= 50 AND edge_low_90 > 0 THEN 'BUY_YES' WHEN edge_bps <= -50 AND edge_high_90 < 0 THEN 'BUY_NO' ELSE 'NO_TRADE' END AS action FROM e),
  d AS (SELECT *, CASE WHEN action <> 'NO_TRADE' THEN '' WHEN bad THEN 'flag:illiquid,flag:stale' WHEN abs(edge_bps) >= 50 THEN 'robust_check_failed' ELSE 'edge_below_threshold' END AS reasons,
    row_number() OVER (PARTITION BY run ORDER BY (action = 'NO_TRADE')::INT, CASE WHEN action <> 'NO_TRADE' THEN -abs(edge_bps) END NULLS FIRST, market_id, token_id)::INT AS rank FROM a QUALIFY rank <= 200)"""
_PLAN = f"""{_DECIDED}, z AS (SELECT *, round(25 * least(2, greatest(0.5::DOUBLE, abs(edge_bps) / 100)), 2)::DECIMAL(28,2) AS notional, CASE WHEN edge_bps > 0 THEN 'BUY_YES' WHEN edge_bps < 0 THEN 'BUY_NO' END AS side,
    round(CASE WHEN edge_bps > 0 THEN price_prob ELSE 1 - price_prob END, 8) AS price, row_number() OVER (PARTITION BY run ORDER BY abs(edge_bps) DESC, market_id, token_id) AS step FROM d),
  y AS (SELECT *, CASE WHEN price > 0 THEN round(notional::DOUBLE / price, 2) END AS quantity, CASE WHEN action = 'NO_TRADE' THEN 'decision_no_trade:' || split_part(reasons, ',', 1) WHEN bad THEN 'blocked_by_quality_flag:illiquid' END AS pre,
    CASE WHEN side IS NULL THEN 'zero_edge' WHEN price <= 0 THEN 'invalid_price' END AS post FROM z),
  f AS (SELECT run, 0 AS step, 0::DECIMAL(28,2) AS total, [{{'m': 0::BIGINT, 'c': '', 'n': 0::DECIMAL(28,2)}}][2:] AS got, '' AS reason, 0::BIGINT AS token_id FROM (SELECT DISTINCT run FROM y) UNION ALL
    SELECT run, step, CASE WHEN why IS NULL THEN total + notional ELSE total END::DECIMAL(28,2), CASE WHEN why IS NULL THEN list_append(got, {{'m': market_id, 'c': category, 'n': notional}}) ELSE got END, why, token_id FROM (SELECT y.run, y.step, f.total, f.got, y.notional, y.market_id, y.category, y.token_id,
      CASE WHEN pre IS NOT NULL THEN pre WHEN len(got) >= 60 THEN 'cap_exceeded:max_orders' WHEN total + notional > 1200 THEN 'cap_exceeded:max_total_notional_usd'
        WHEN coalesce(list_sum(list_transform(list_filter(got, lambda x: x.m = y.market_id), lambda x: x.n)), 0) + notional > 60 THEN 'cap_exceeded:max_notional_per_market_usd'
        WHEN category IS NOT NULL AND coalesce(list_sum(list_transform(list_filter(got, lambda x: x.c = y.category), lambda x: x.n)), 0) + notional > 300 THEN 'cap_exceeded:max_notional_per_category_usd' ELSE post END AS why FROM f JOIN y ON f.run = y.run AND y.step = f.step + 1)),
  o AS (SELECT y.*, row_number() OVER (PARTITION BY run ORDER BY step)::INT AS place FROM y SEMI JOIN (SELECT * FROM f WHERE step > 0 AND reason IS NULL) k ON y.run = k.run AND y.step = k.step)"""
_RISK = f"""{_PLAN}, w AS (SELECT run, place, market_id, token_id, category, notional, list_sort(list_distinct(list_concat(CASE WHEN run LIKE '%-07' THEN ['performance_concentration_top1_breach'] ELSE [] END, CASE WHEN market_id % 20 = 0 THEN ['cooldown_active:market:critical_loss'] ELSE [] END))) AS own FROM o),
  rk AS (SELECT run, 0 AS place, [{{'m': 900001::BIGINT, 'n': 180::DECIMAL(28,2)}}, {{'m': 900002, 'n': 170}}, {{'m': 900003, 'n': 160}}] AS ms, [{{'c': '1-URGENT', 'n': 100::DECIMAL(28,2)}}] AS cs, 0::BIGINT AS token_id, '' AS verdict, 0::DECIMAL(28,2) AS given, '' AS reasons FROM (SELECT DISTINCT run FROM w) UNION ALL
    SELECT run, place, CASE WHEN given > 0 THEN list_append(ms, {{'m': market_id, 'n': given}}) ELSE ms END, CASE WHEN given > 0 AND category IS NOT NULL THEN list_append(cs, {{'c': category, 'n': given}}) ELSE cs END, token_id, verdict, given, reasons FROM
    (SELECT *, CASE WHEN verdict = 'ALLOW' THEN notional WHEN verdict = 'DOWNSIZE' THEN a ELSE 0 END::DECIMAL(28,2) AS given, CASE verdict WHEN 'ALLOW' THEN '' WHEN 'DOWNSIZE' THEN replace(split_part(caps, ',', 1), 'cap_exceeded', 'downsized_by_cap') ELSE coalesce(why, caps) END AS reasons FROM
    (SELECT *, CASE WHEN why IS NOT NULL OR a <= 0 THEN 'BLOCK' WHEN a >= notional THEN 'ALLOW' WHEN a >= 5 THEN 'DOWNSIZE' ELSE 'BLOCK' END AS verdict FROM
    (SELECT *, CASE WHEN len(own) > 0 THEN array_to_string(own, ',') WHEN a <= 0 THEN NULL WHEN top[1] / (total + a) > 0.35::DOUBLE THEN 'concentration_cap:top1' WHEN list_sum(top[:3]) / (total + a) > 0.9::DOUBLE THEN 'concentration_cap:top3' END AS why FROM
    (SELECT *, list_reverse_sort(list_transform(list_distinct(list_append(list_transform(ms, lambda x: x.m), market_id)), lambda k: list_sum(list_transform(list_filter(list_append(ms, {{'m': market_id, 'n': a}}), lambda x: x.m = k), lambda x: x.n::DOUBLE)))) AS top,
      coalesce(nullif(concat_ws(',', CASE WHEN lt <= 0 THEN 'cap_exceeded:max_total_notional_usd' END, CASE WHEN lm <= 0 THEN 'cap_exceeded:max_notional_per_market_usd' END, CASE WHEN category IS NOT NULL AND lc <= 0 THEN 'cap_exceeded:max_notional_per_category_usd' END), ''),
        CASE WHEN least(lt, lm, lc) < lt THEN 'cap_exceeded:max_notional_per_market_usd' WHEN category IS NOT NULL AND least(lt, lm, lc) < lm THEN 'cap_exceeded:max_notional_per_category_usd' WHEN least(lt, lm, lc) < lc THEN 'cap_exceeded:max_total_notional_usd' ELSE 'cap_exceeded:unknown' END) AS caps FROM
    (SELECT *, least(notional, lt, lm, lc) AS a, list_sum(list_transform(ms, lambda x: x.n::DOUBLE)) AS total FROM
    (SELECT w.*, ms, cs, (1000 - list_sum(list_transform(ms, lambda x: x.n)))::DECIMAL(28,2) AS lt, (40 - coalesce(list_sum(list_transform(list_filter(ms, lambda x: x.m = w.market_id), lambda x: x.n)), 0))::DECIMAL(28,2) AS lm,
      CASE WHEN category IS NULL THEN notional ELSE (250 - coalesce(list_sum(list_transform(list_filter(cs, lambda x: x.c = w.category), lambda x: x.n)), 0))::DECIMAL(28,2) END AS lc FROM rk JOIN w ON rk.run = w.run AND w.place = rk.place + 1)))))))"""
ORACLES = {
    "bucket_quotas": """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS run, o_orderpriority AS bucket, count(*) AS w FROM orders GROUP BY ALL), r AS (SELECT *, w::DOUBLE / (sum(w) OVER (PARTITION BY run))::DOUBLE * 37 AS raw FROM m),
  k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY raw - floor(raw) DESC, bucket) AS k, 37 - sum(floor(raw)) OVER (PARTITION BY run) AS rest FROM r) SELECT run, bucket, (floor(raw) + (k <= rest)::INT)::BIGINT AS quota FROM k""",
    "diversified_selection": f"""WITH RECURSIVE {_CANDIDATES}, u AS (SELECT run, unnest(list_transform(got, lambda x: x.place)) AS place FROM ends)
  SELECT run, row_number() OVER (PARTITION BY run ORDER BY place)::INT AS rank, market_id, token_id, screen_score FROM u JOIN ranked USING (run, place)""",
    "decisions": f"""WITH {_DECIDED} SELECT run, rank, market_id, token_id, action, round(edge, 6) AS edge, round(edge_bps, 4) AS edge_bps, round(edge_low_90, 6) + 0::DOUBLE AS edge_low_90, round(edge_high_90, 6) + 0::DOUBLE AS edge_high_90, reasons, quality_flags FROM d""",
    "trade_plan_orders": f"WITH RECURSIVE {_PLAN} SELECT run, place AS rank, market_id, token_id, side, round(price, 6) AS price, notional::DOUBLE AS notional, quantity FROM o",
    "trade_plan_skips": f"WITH RECURSIVE {_PLAN} SELECT run, reason, count(*) AS n FROM f WHERE step > 0 AND reason IS NOT NULL GROUP BY ALL",
    "risk_verdicts": f"WITH RECURSIVE {_RISK} SELECT run, place AS rank, token_id, verdict, given::DOUBLE AS approved, reasons FROM rk WHERE place > 0",
    "risk_summary": f"""WITH RECURSIVE {_RISK} SELECT run, count(*) AS n_total, count(*) FILTER (verdict = 'ALLOW') AS n_allow, count(*) FILTER (verdict = 'BLOCK') AS n_block, count(*) FILTER (verdict = 'DOWNSIZE') AS n_downsize,
  sum(notional)::DOUBLE AS requested, sum(given)::DOUBLE AS approved, greatest(sum(notional) - sum(given), 0)::DOUBLE AS blocked FROM rk JOIN w USING (run, place) WHERE place > 0 GROUP BY run""",
}
