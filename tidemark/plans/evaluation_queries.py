"""Registered queries of selections held against each other, with the same in DuckDB's SQL. A selector is an order's
priority, a run of it a year, the customers who ordered are the selected tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, evaluation, models, registry
from .market_queries import _BOOKS, _last, _mid, books
from .queries import _TRADES, _table, trades

AT = "TIMESTAMP_NTZ '2024-01-20 00:00:00'"
HOURS = 240


def _year():
    return F.year("o_orderdate") - 1992


def _selections(spark, sf_dir):
    """selected (selection_run_id, token_id, ttr), runs and what they made; a version of no tokens beside them."""
    o = _table(spark, sf_dir, "orders")
    run = _year() * 10 + F.substring("o_orderpriority", 1, 1).cast("int")
    ttr = F.when(F.col("o_orderkey") % 9 == 0, F.lit(None)).when(F.col("o_orderkey") % 2 == 0, F.lit("0_24h")).otherwise("1_7d")
    picked = o.select(run.alias("selection_run_id"), F.when(F.col("o_orderkey") % 13 > 0, F.col("o_custkey")).alias("token_id"), ttr.alias("ttr"))
    decided = F.expr(f"{AT} - make_dt_interval(cast(run_id DIV 10 * 3 AS int))")
    runs = o.select(run.alias("run_id")).distinct().unionByName(spark.range(1).select(F.lit(39).alias("run_id"))).withColumn("decision_ts", decided)
    made = runs.select("run_id", F.col("run_id").alias("selection_run_id"), F.concat(F.lit("v"), F.col("run_id") % 10).alias("version"))
    return picked, runs, made


def _snapshots(spark, sf_dir):
    t = trades(spark, sf_dir).where("trade_id % 2 = 0")
    known = F.when(F.col("trade_id") % 5 == 0, F.col("event_ts") + F.expr("INTERVAL 40 DAYS")).otherwise(F.col("event_ts"))
    given = {"mid_price": F.col("price"), "book_imbalance_1": F.col("size") / 100.0, "spread_bps": F.lit(120.0)}
    names = ("mid_price", "book_imbalance_1", "return_5m", "realized_vol_1h", "spread_bps", "top_depth_bid", "top_depth_ask", "trade_count_5m", "volume_5m", "stale_seconds_last_trade", "stale_seconds_last_book")
    features = F.struct(*[given.get(c, F.lit(None).cast("double")).cast("double").alias(c) for c in names])
    return t.select("token", F.col("trade_id").alias("snapshot_id"), F.col("event_ts").alias("asof_ts"), known.alias("bound_ts"), features.alias("features"))


def _examples(spark, sf_dir, tokens):
    spine = tokens.select("token", F.explode(evaluation.grid(F.expr(AT), HOURS)).alias("t"))
    c = _table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0")
    outcomes = c.select(F.col("c_custkey").alias("token"), F.expr("TIMESTAMP_NTZ '2024-01-05 00:00:00' + make_dt_interval(cast(c_custkey % 40 AS int))").alias("resolved_ts"), (F.col("c_acctbal") > 4000).cast("int").alias("y"))
    b = books(spark, sf_dir).withColumn("prob", _mid())
    got = asof.dataset(spine, b, trades(spark, sf_dir), outcomes, "token", snapshots=_snapshots(spark, sf_dir))
    p_b = models.forecast(got.select("*", "features.*")).select(F.col("token").alias("token_id"), "t", "price_prob", "y", "status", "p_b")
    return p_b


def _evaluation(spark, sf_dir):
    picked, runs, made = _selections(spark, sf_dir)
    now = F.expr(AT)
    latest = registry.latest_runs(made, runs, now - F.expr(f"INTERVAL {HOURS} HOURS"), now)
    asked = made.select("version").distinct().unionByName(spark.range(1).select(F.lit("v0").alias("version")))
    tokens = latest.join(picked, "selection_run_id").where("token_id IS NOT NULL").select(F.col("token_id").alias("token")).distinct()
    got = evaluation.evaluate(asked, latest, picked, _examples(spark, sf_dir, tokens))
    buckets = F.array_join(F.transform(F.map_entries("ttr_buckets"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    got = got.withColumns({"ttr_buckets": buckets, "selection_run_id": F.coalesce("selection_run_id", F.lit(-1)), "decision_ts": F.coalesce("decision_ts", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))})
    got = got.withColumns({c: F.col(c).cast("string") for c in ("tokens_digest", "examples_digest")})
    # Prices have few decimals, so means often lie halfway; the small part decides these alike in any order of summing.
    return got.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in got.columns if c.startswith(("brier", "ece", "entropy", "price"))})


def _pool(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return o.select(_year().alias("run"), F.col("o_custkey").alias("market_id"), F.element_at(F.array(F.lit("0_24h"), F.lit("1_7d"), F.lit(None).cast("string")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("bucket"), F.col("o_orderpriority").alias("category"), F.round(F.col("o_totalprice") % 50, 0).alias("volume"), (F.col("o_orderkey") % 10).alias("screen_score"), "o_orderkey")


def _stratified(spark, sf_dir):
    s = evaluation.seed(F.expr(AT), F.concat(F.lit("c"), F.col("run")))
    return evaluation.stratified(_pool(spark, sf_dir), 100, s)


def _volumes(spark, sf_dir):
    rows = _pool(spark, sf_dir).withColumn("market_id", F.col("o_orderkey"))
    return evaluation.top_volume(rows, 50).select("run", "market_id", "volume", "rank")


QUERIES = {"selector_evaluation": _evaluation, "stratified_sample": _stratified, "top_volume_baseline": _volumes}

_POOL = """p AS (SELECT year(o_orderdate) - 1992 AS run, o_custkey AS market_id, coalesce(['0_24h', '1_7d', NULL][o_orderkey % 3 + 1], 'unknown') AS bucket, o_orderpriority AS category FROM orders)"""
_DIGEST = "sum(('0x' || substr(md5(concat_ws('|', {})), 1, 13))::BIGINT)::DECIMAL(38,0)"


def _placed(q):
    """The nearest rank of a quantile, (n - 1) * q rounded half to even."""
    return f"round_even((n - 1) * {q}::DOUBLE, 0)"


_SPREAD = ", ".join(
    f"max(CASE WHEN m = '{m}' THEN {c} END) AS {m}_{n}"
    for m in evaluation.MEASURES
    for n, c in (("mean", "mean"), ("p50", "p50"), ("p90", "p90"), ("least", "least"), ("largest", "largest"))
)
_FIGURES = [f"{c}_{m}" for c in ("brier", "ece") for m in ("a", "b")] + [f"{m}_{c}" for m in evaluation.MEASURES for c in ("mean", "p50", "p90", "least", "largest")]
ORACLES = {
    "selector_evaluation": f"""WITH {_TRADES}, {_BOOKS},
  o2 AS (SELECT (year(o_orderdate) - 1992) * 10 + left(o_orderpriority, 1)::INT AS run, CASE WHEN o_orderkey % 13 > 0 THEN o_custkey END AS token, CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' WHEN o_orderkey % 2 = 0 THEN '0_24h' ELSE '1_7d' END AS ttr FROM orders),
  runs AS (SELECT run, 'v' || (run % 10) AS version, TIMESTAMP '2024-01-20' - to_days((run // 10 * 3)::INT) AS decision_ts FROM (SELECT DISTINCT run FROM o2 UNION SELECT 39)),
  lat AS (SELECT * FROM runs WHERE decision_ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY version ORDER BY decision_ts DESC, run DESC) = 1),
  asked AS (SELECT v.version, run AS selection_run_id, decision_ts FROM (SELECT DISTINCT version FROM runs UNION SELECT 'v0') v LEFT JOIN lat USING (version)),
  mem AS (SELECT version, token, ttr FROM lat JOIN o2 USING (run) WHERE token IS NOT NULL),
  tk AS (SELECT DISTINCT version, token FROM mem),
  s AS (SELECT token, TIMESTAMP '2024-01-10' + to_hours((h * 4)::INT) AS t FROM (SELECT DISTINCT token FROM tk), range(0, 61) r(h)),
  sn AS (SELECT token, trade_id AS id, event_ts, event_ts AS ingested_at, CASE WHEN trade_id % 5 = 0 THEN event_ts + to_days(40) ELSE event_ts END AS bound, price AS fp, size / 100.0 AS fi, TRUE AS has FROM t WHERE trade_id % 2 = 0),
  {_last("bl", "b", "m")}, {_last("tl", "o", "price")}, {_last("sl", "sn", "bound, fp, fi, has")},
  x AS (SELECT c_custkey AS token, TIMESTAMP '2024-01-05' + to_days((c_custkey % 40)::INT) AS resolved_ts, (c_acctbal > 4000)::INT AS y FROM customer WHERE c_custkey % 5 <> 0),
  d AS (SELECT bl.token, bl.t, coalesce(CASE WHEN m BETWEEN 0 AND 1 THEN m END, CASE WHEN price BETWEEN 0 AND 1 THEN price END) AS p, y, resolved_ts, fp, fi, has AND bound <= bl.t + to_seconds(300) AS f FROM bl JOIN tl USING (token, t) JOIN sl USING (token, t) LEFT JOIN x USING (token)),
  e AS (SELECT *, CASE WHEN y IS NULL THEN 'no_outcome' WHEN t >= resolved_ts THEN 'no_outcome' WHEN NOT coalesce(f, FALSE) THEN 'missing_features' WHEN p IS NULL THEN 'missing_price' ELSE 'ok' END AS status,
    1 / (1 + exp(-(2.0::DOUBLE * (least(greatest(fp, 0), 1) - 0.5) + 1.2::DOUBLE * least(greatest(fi, -1), 1) - 0.8::DOUBLE * 0.12 - 0.5 - 0.3))) AS pb FROM d),
  met AS (SELECT version, e.* FROM tk JOIN e USING (token)), ok AS (SELECT * FROM met WHERE status = 'ok'),
  cnt AS (SELECT version, count(*) FILTER (status = 'ok') AS n_examples, count(*) FILTER (status = 'no_outcome') AS skipped_no_outcome, count(*) FILTER (status = 'missing_features') AS skipped_missing_features, count(*) FILTER (status = 'missing_price') AS skipped_missing_price FROM met GROUP BY 1),
  dg AS (SELECT version, {_DIGEST.format("token::VARCHAR, strftime(t, '%Y-%m-%d %H:%M:%S'), y::VARCHAR")} AS examples_digest FROM ok GROUP BY 1),
  tg AS (SELECT version, count(*) AS n_tokens, {_DIGEST.format("token::VARCHAR")} AS tokens_digest FROM tk GROUP BY 1),
  bk AS (SELECT version, string_agg(ttr || ':' || n, ',' ORDER BY ttr) AS ttr_buckets FROM (SELECT version, ttr, count(*) AS n FROM mem GROUP BY ALL) GROUP BY 1),
  sc AS (SELECT version, 'a' AS model, y, p AS p FROM ok UNION ALL SELECT version, 'b', y, pb FROM ok),
  ce AS (SELECT version, model, least(floor(p * 10), 9) AS bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy, sum((p - y) * (p - y)) AS sb FROM sc GROUP BY ALL),
  rp AS (SELECT version, model, sum(sb) / sum(n) AS brier, sum(abs(sp - sy)) / sum(n) AS ece FROM ce GROUP BY ALL),
  rq AS (SELECT version, {", ".join(f"max({c}) FILTER (model = '{m}') AS {c}_{m}" for c in ("brier", "ece") for m in ("a", "b"))} FROM rp GROUP BY 1),
  q AS (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM ok),
  va AS (SELECT version, 'price' AS m, round(p, 8) AS v FROM ok UNION ALL SELECT version, 'entropy', round(least(greatest(-(q * ln(q) + (1 - q) * ln(1 - q)) / ln(2), 0), 1), 6) FROM q),
  vr AS (SELECT *, row_number() OVER (PARTITION BY version, m ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY version, m) AS n FROM va),
  vs AS (SELECT version, m, avg(v) AS mean, min(v) AS least, max(v) AS largest, max(CASE WHEN k = {_placed(0.5)} THEN v END) AS p50, max(CASE WHEN k = {_placed(0.9)} THEN v END) AS p90 FROM vr GROUP BY ALL),
  vp AS (SELECT version, {_SPREAD} FROM vs GROUP BY 1)
  SELECT asked.version, coalesce(selection_run_id, -1) AS selection_run_id, coalesce(decision_ts, TIMESTAMP '1970-01-01') AS decision_ts, CASE WHEN selection_run_id IS NULL THEN 'missing_selection' WHEN n_tokens IS NULL THEN 'empty_selection' ELSE 'ok' END AS status,
    coalesce(n_tokens, 0) AS n_tokens, coalesce(tokens_digest, 0)::VARCHAR AS tokens_digest, coalesce(ttr_buckets, '') AS ttr_buckets, coalesce(n_examples, 0) AS n_examples, coalesce(skipped_no_outcome, 0) AS skipped_no_outcome, coalesce(skipped_missing_features, 0) AS skipped_missing_features,
    coalesce(skipped_missing_price, 0) AS skipped_missing_price, coalesce(examples_digest, 0)::VARCHAR AS examples_digest, {", ".join(f"round(coalesce({c}, 0) + 1e-9::DOUBLE, 6) AS {c}" for c in _FIGURES)}
  FROM asked LEFT JOIN tg USING (version) LEFT JOIN bk USING (version) LEFT JOIN cnt USING (version) LEFT JOIN dg USING (version) LEFT JOIN rq USING (version) LEFT JOIN vp USING (version)""",
    "stratified_sample": f"""WITH {_POOL}, u AS (SELECT run, market_id, min(bucket || '|' || category) AS k FROM p GROUP BY ALL), g AS (SELECT run, k, count(*)::DOUBLE AS w FROM u GROUP BY ALL),
  r AS (SELECT *, w / sum(w) OVER (PARTITION BY run) * 100 AS raw FROM g), f AS (SELECT *, floor(raw) AS fl, row_number() OVER (PARTITION BY run ORDER BY raw - floor(raw) DESC, k) AS place, 100 - sum(floor(raw)) OVER (PARTITION BY run) AS rest FROM r),
  h AS (SELECT *, row_number() OVER (PARTITION BY run, k ORDER BY sha256(substr(sha256('2024-01-20T00:00:00|c' || run), 1, 16) || '|' || market_id), market_id) AS n FROM u)
  SELECT run, market_id, split_part(k, '|', 1) AS bucket, split_part(k, '|', 2) AS category FROM h JOIN f USING (run, k) WHERE n <= fl + (place <= rest)::INT""",
    "top_volume_baseline": """SELECT year(o_orderdate) - 1992 AS run, o_orderkey AS market_id, round(o_totalprice % 50, 0) AS volume, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY round(o_totalprice % 50, 0) DESC, o_orderkey % 10 DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 50""",
}
