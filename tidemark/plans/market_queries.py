"""Registered queries of the market, forecast and article operators, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import asof, micro, news, portfolio, scoring, selector
from ..streaming import feed
from .queries import _CANDLES, _FORECASTS, _LEDGER, _TRADES, FIRST, _candles, _forecasts, _rounded, _table, ledger, trades

WIDE = 86400  # the given events are days apart, so the short window is a day and the long one three
AT = "TIMESTAMP_NTZ '2024-01-20 00:00:00'"


def spine(rows):
    return rows.select("token").distinct().select("token", F.explode(F.expr(f"transform(sequence(0, 28), d -> {FIRST} + make_dt_interval(d))")).alias("t"))


def books(spark, sf_dir):
    e = trades(spark, sf_dir).join(_table(spark, sf_dir, "events").where("event_type IN ('view', 'click')").select(F.col("event_id").alias("trade_id")), "trade_id", "left_semi")
    level = lambda p, s: F.struct(p.alias("price"), s.cast("double").alias("size"))
    low, high, k = F.col("price") - 0.01, F.col("price") + 0.01, F.col("size")
    mid = F.when(F.col("trade_id") % 3 == 0, F.col("price"))
    return e.select("token", F.col("trade_id").alias("book_id"), "event_ts", "ingested_at", mid.alias("mid"), F.array(level(low, k + 1), level(low - 0.01, k + 5), level(low, F.lit(2))).alias("bids"), F.array(level(high, k), level(high + 0.02, k + 9)).alias("asks"))


def _mid():
    return micro.mid_price(F.col("mid"), micro.best_price(F.col("bids"), True), micro.best_price(F.col("asks"), False))


def _features(spark, sf_dir, grid):
    c = _candles(spark, sf_dir).withColumn("ingested_at", F.col("start_ts") + F.expr("INTERVAL 1 HOUR"))
    return micro.features(grid, books(spark, sf_dir), trades(spark, sf_dir), c, "token", short=WIDE, long=3 * WIDE)


FEATURES = ["mid_price", "spread_bps", "top_depth_bid", "top_depth_ask", "book_imbalance_1", "last_trade_price", "last_trade_size", "volume_5m", "return_5m", "realized_vol_1h"]


def _micro(spark, sf_dir):
    df = _rounded(_features(spark, sf_dir, spine(trades(spark, sf_dir))), *FEATURES)
    return df.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("stale_seconds_last_trade", "stale_seconds_last_book")})


def _dataset(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0")
    outcomes = c.select(F.col("c_custkey").alias("token"), F.expr("TIMESTAMP_NTZ '2024-01-05 00:00:00' + make_dt_interval(cast(c_custkey % 40 AS int))").alias("resolved_ts"), (F.col("c_acctbal") > 4000).cast("int").alias("y"))
    b = books(spark, sf_dir).withColumn("prob", _mid())
    return asof.dataset(spine(trades(spark, sf_dir)), b, trades(spark, sf_dir), outcomes, "token")


def _dataset_rows(spark, sf_dir):
    return _rounded(_dataset(spark, sf_dir).withColumn("y", F.coalesce("y", F.lit(-1))), "price_prob")


def _markets(spark, sf_dir):
    at = F.expr(AT)
    grid = trades(spark, sf_dir).select("token").distinct().withColumn("t", at)
    f = _features(spark, sf_dir, grid).withColumn("has_features", F.lit(True))
    c = _table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    resolves = F.when(key % 11 != 0, at + F.expr("make_dt_interval(cast(c_custkey % 60 AS int))"))
    m = c.select(key.alias("token"), key.alias("market_id"), F.col("c_name").alias("title"), F.when(key % 3 == 0, "It depends; the end is unclear.").otherwise(F.col("c_mktsegment")).alias("rule_text"), F.lit(None).cast("string").alias("description"), (key % 2 == 0).alias("rule_ok"), selector.ttr_bucket(resolves, at, F.when(key % 2 == 0, "Closed")).alias("ttr"), (at - F.expr("make_dt_interval(0, cast(c_custkey % 90 AS int))")).alias("updated_ts"))
    v = asof.gate(trades(spark, sf_dir), at, 300).where(F.col("event_ts") >= at - F.expr("INTERVAL 24 HOURS")).groupBy("token").agg(F.sum(F.col("price") * F.col("size")).alias("volume"))
    df = m.join(f, "token", "left").join(v, "token", "left").withColumn("has_features", F.coalesce("has_features", F.lit(False)))
    return df.withColumn("volume", F.round(F.coalesce("volume", F.lit(0.0)), 6)).withColumn("price_prob", F.col("mid_price"))


def _scores(spark, sf_dir):
    df = selector.scores(_markets(spark, sf_dir)).withColumn("flags", F.concat_ws(",", "flags"))
    return _rounded(df.select("market_id", "ttr", "lq", "pq", "vo", "dc", "rc", "penalty", "flags", "screen_score", "deep_score"), "lq", "pq", "vo", "dc", "rc", "penalty", "screen_score", "deep_score")


def _candidates(spark, sf_dir):
    got = selector.candidate_set(_markets(spark, sf_dir), F.expr(AT), most=100)
    return got.select("market_id", "token", "volume", "ttr", F.concat_ws(",", "reasons").alias("reasons"))


def _report(spark, sf_dir):
    return _rounded(scoring.report(_forecasts(spark, sf_dir), "lang"), "brier", "log_loss", "ece", "mce").withColumn("lang", F.coalesce("lang", F.lit("")))


def _entropy(spark, sf_dir):
    rows = _forecasts(spark, sf_dir).withColumn("h", F.round(selector.entropy(F.col("p")), 6))
    return _rounded(scoring.summary(rows, "lang", "h"), "mean")


def _conformal(spark, sf_dir):
    f = _forecasts(spark, sf_dir)
    w = scoring.conformal(f, "lang", ["doc_id"])
    return _rounded(scoring.coverage(f, w, "lang").join(w, "lang"), "q50", "q90", "coverage_50", "width_50", "coverage_90", "width_90")


def _urls(spark, sf_dir):
    u = F.col("url")
    return _table(spark, sf_dir, "pages").select("page_id", T.domain(u).alias("domain"), T.canonical_url(u).alias("canonical"), F.sha2(T.canonical_url(u), 256).alias("url_hash"))


def _html(spark, sf_dir):
    h = F.col("html")
    return _table(spark, sf_dir, "pages").select("page_id", T.html_title(h).alias("title"), T.html_body(h).alias("body"))


def articles(spark, sf_dir):
    """Documents as articles: the first line is the title, the rest the body; published by the hour."""
    d = _table(spark, sf_dir, "documents")
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id DIV 4 AS int))")
    title = F.substring_index("text", "\n", 1)
    return d.select(F.col("doc_id").alias("id"), at.alias("published_at"), F.col("source").alias("domain"), title.alias("title"), F.substr("text", F.length(title) + 2).alias("body"))


_ARTICLES = """a AS (SELECT doc_id AS id, TIMESTAMP '2024-01-01' + to_hours((doc_id // 4)::INT) AS published_at, source AS domain, split_part(text, chr(10), 1) AS title,
  substr(text, length(split_part(text, chr(10), 1)) + 2) AS body FROM documents)"""


def _hashed(spark, sf_dir):
    a = articles(spark, sf_dir)
    return a.select("id", "published_at", "domain", T.content_hash(F.col("title"), F.col("body"), F.lit(None).cast("string")).alias("content_hash"), T.text_hash(F.col("title")).alias("title_hash"))


def _links(spark, sf_dir):
    a = articles(spark, sf_dir).select("id", T.tokens(F.col("title")).alias("title"), T.tokens(F.col("body")).alias("body"))
    b = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("market_id"), T.tokens(F.col("text")).alias("title"), T.tokens(F.substring_index("text", ".", 1)).alias("slug"))
    return news.market_links(a, b)


def _policies(spark, sf_dir):
    p = _table(spark, sf_dir, "pages").select("page_id", T.domain(F.col("url")).alias("domain"))
    parents = p.select(F.substring_index("domain", ".", -2).alias("domain")).where("domain <> 'example.net'").distinct().withColumn("allow_subdomains", F.lit(True))
    own = p.where("page_id % 3 = 0").select("domain").distinct().withColumn("allow_subdomains", F.lit(False))
    return news.domain_policies(p, parents.unionByName(own)).select("page_id", "domain", F.coalesce("policy", F.lit("")).alias("policy"))


def _prices(spark, sf_dir):
    g = ledger(spark, sf_dir).where("l_linenumber = 2 AND token % 3 = 0")
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("token"), F.explode(F.array(F.lit("BUY"), F.lit("SELL"))).alias("side"), F.col("p_retailprice").alias("price")).where("token % 7 <> 0")
    return portfolio.reference_prices(g, part, ["l_orderkey", "l_linenumber"])


def _marked(spark, sf_dir):
    m = portfolio.mark_to_model(portfolio.positions(ledger(spark, sf_dir), ["token", "side"]), _prices(spark, sf_dir))
    return m.select("token", "side", F.round("price", 6).alias("price"), F.round("value", 6).alias("value"), F.round("gain", 6).alias("gain"))


def _performance(spark, sf_dir):
    g = ledger(spark, sf_dir).groupBy("l_orderkey").agg(F.sum(F.when(F.col("side") == "SELL", F.col("notional")).otherwise(0)).cast("double").alias("gain"), F.sum("notional").cast("double").alias("notional"))
    return _rounded(portfolio.run_performance(g), "mean_bps", "median_bps", "worst_bps", "best_bps")


def _gaps(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), F.col("event_id").alias("seq"), "ts")
    return feed.gaps(e, "channel", "seq", "ts", 3600).where("reason <> 'none'").select("channel", "seq", "reason")


def _throughput(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), F.col("user_id").alias("token"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    return feed.throughput(feed.deduplicated(e, ["channel", "token", "ts"], "ts"), "ts", "1 day").drop("tokens").withColumn("start_ts", F.col("start_ts").cast("timestamp_ntz"))


def _book_probabilities(spark, sf_dir):
    b = books(spark, sf_dir).select("book_id", micro.book_probability(F.col("bids"), F.col("asks")).alias("price_prob"))
    return b.select("book_id", F.coalesce(F.round("price_prob", 6), F.lit(-1.0)).alias("price_prob"))


QUERIES = {
    "book_probabilities": _book_probabilities,
    "micro_features": _micro,
    "asof_dataset": _dataset_rows,
    "asof_skips": lambda s, d: _dataset(s, d).groupBy("status").agg(F.count("*").alias("n")),
    "selector_scores": _scores,
    "candidate_set": _candidates,
    "calibration_report": _report,
    "entropy_summary": _entropy,
    "conformal_intervals": _conformal,
    "url_functions": _urls,
    "html_articles": _html,
    "article_hashes": lambda s, d: _hashed(s, d).select("id", "content_hash", "title_hash"),
    "soft_duplicates": lambda s, d: news.soft_duplicates(_hashed(s, d)).select("id", "duplicate_of", "reason"),
    "article_market_links": _links,
    "domain_policies": _policies,
    "mark_to_model": _marked,
    "missing_prices": lambda s, d: portfolio.missing_prices(portfolio.positions(ledger(s, d), ["token", "side"]), _prices(s, d)),
    "run_performance": _performance,
    "sequence_gaps": _gaps,
    "channel_throughput": _throughput,
}

_SPINE = "s AS (SELECT token, TIMESTAMP '2024-01-02' + to_days(d::INT) AS t FROM (SELECT DISTINCT token FROM t), range(0, 29) r(d))"
_NOW = "s AS (SELECT DISTINCT token, TIMESTAMP '2024-01-20' AS t FROM t)"
_BOOKS = """b AS (SELECT token, trade_id AS id, t.event_ts, ingested_at, CASE WHEN CASE WHEN trade_id % 3 = 0 THEN price END > 0 THEN price WHEN price - 0.01 > 0 THEN (price - 0.01 + (price + 0.01)) / 2 END AS m,
  price - 0.01 AS bid, price + 0.01 AS ask, size + 3.0 AS db, size * 1.0 AS da FROM t JOIN events ON trade_id = event_id WHERE event_type IN ('view', 'click')), o AS (SELECT *, trade_id AS id FROM t)"""


def _last(name, rows, cols, back=0):
    return f"""{name} AS (SELECT * FROM (SELECT s.token, s.t, {cols}, row_number() OVER (PARTITION BY s.token, s.t ORDER BY event_ts DESC NULLS LAST, ingested_at DESC, id DESC) AS k FROM s
  LEFT JOIN {rows} r ON s.token = r.token AND event_ts <= s.t - to_seconds({back}) AND ingested_at <= s.t + to_seconds(300)) WHERE k = 1)"""


def _features_sql(grid):
    return f"""WITH {_TRADES}, {grid}, {_BOOKS}, {_CANDLES}, {_last("bl", "b", "event_ts AS bt, m, bid, ask, db, da")}, {_last("tl", "o", "event_ts AS tt, price, size")}, {_last("ta", "o", "price AS pa", WIDE)}, {_last("ba", "b", "m AS ma", WIDE)},
  v AS (SELECT s.token, s.t, count(*) AS n, sum(size) AS v FROM s JOIN t ON s.token = t.token AND event_ts BETWEEN s.t - to_seconds({WIDE}) AND s.t AND ingested_at <= s.t + to_seconds(300) GROUP BY ALL),
  w AS (SELECT token, t, stddev_pop(r) AS vol FROM (SELECT s.token, s.t, ln(close / lag(close) OVER (PARTITION BY s.token, s.t ORDER BY start_ts)) AS r FROM s JOIN c ON s.token = c.token
    AND start_ts BETWEEN s.t - to_seconds({3 * WIDE}) AND s.t AND start_ts + to_hours(1) <= s.t + to_seconds(300) WHERE close > 0) GROUP BY ALL),
  f AS (SELECT bl.token, bl.t, m AS mid_price, CASE WHEN m > 0 THEN (ask - bid) / m * 10000 END AS spread_bps, coalesce(db, 0)::DOUBLE AS top_depth_bid, coalesce(da, 0)::DOUBLE AS top_depth_ask,
    CASE WHEN coalesce(db, 0) + coalesce(da, 0) > 0 THEN (db - da)::DOUBLE / (db + da)::DOUBLE END AS book_imbalance_1, price AS last_trade_price, size::DOUBLE AS last_trade_size, coalesce(n, 0) AS trade_count_5m,
    coalesce(v, 0)::DOUBLE AS volume_5m, CASE WHEN coalesce(m, price) > 0 AND coalesce(pa, ma) > 0 THEN ln(coalesce(m, price) / coalesce(pa, ma)) END AS return_5m, vol AS realized_vol_1h,
    CASE WHEN tt IS NOT NULL THEN greatest(0, epoch(bl.t - tt))::BIGINT END AS stale_seconds_last_trade, CASE WHEN bt IS NOT NULL THEN greatest(0, epoch(bl.t - bt))::BIGINT END AS stale_seconds_last_book
    FROM bl JOIN tl USING (token, t) JOIN ta USING (token, t) JOIN ba USING (token, t) LEFT JOIN v USING (token, t) LEFT JOIN w USING (token, t))"""


_DATASET = f"""WITH {_TRADES}, {_SPINE}, {_BOOKS}, {_last("bl", "b", "m")}, {_last("tl", "o", "price")}, x AS (SELECT c_custkey AS token, TIMESTAMP '2024-01-05' + to_days((c_custkey % 40)::INT) AS resolved_ts, (c_acctbal > 4000)::INT AS y FROM customer WHERE c_custkey % 5 <> 0),
  d AS (SELECT bl.token, bl.t, coalesce(CASE WHEN m BETWEEN 0 AND 1 THEN m END, CASE WHEN price BETWEEN 0 AND 1 THEN price END) AS price_prob, y, resolved_ts FROM bl JOIN tl USING (token, t) LEFT JOIN x USING (token)),
  e AS (SELECT token, t, price_prob, y, CASE WHEN y IS NULL THEN 'no_outcome' WHEN t >= resolved_ts THEN 'resolved' WHEN price_prob IS NULL THEN 'missing_price' ELSE 'ok' END AS status FROM d)"""
_MARKETS = f"""{_features_sql(_NOW)}, vol24 AS (SELECT token, sum(price * size) AS volume FROM t WHERE event_ts BETWEEN TIMESTAMP '2024-01-19' AND TIMESTAMP '2024-01-20' AND ingested_at <= TIMESTAMP '2024-01-20 00:05:00' GROUP BY token),
  m AS (SELECT c_custkey AS market_id, c_custkey AS token, c_name AS title, CASE WHEN c_custkey % 3 = 0 THEN 'It depends; the end is unclear.' ELSE c_mktsegment END AS rule_text, c_custkey % 2 = 0 AS rule_ok,
    CASE WHEN c_custkey % 11 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN '0_24h' ELSE 'unknown' END WHEN c_custkey % 60 <= 1 THEN '0_24h' WHEN c_custkey % 60 <= 7 THEN '1_7d' WHEN c_custkey % 60 <= 45 THEN '7_30d' ELSE '30d_plus' END AS ttr,
    c_custkey % 90 AS hours_old FROM customer),
  j AS (SELECT m.*, f.* EXCLUDE (token), f.token IS NOT NULL AS has, round(coalesce(volume, 0), 6) AS volume, greatest(coalesce(stale_seconds_last_trade, 1e9), 0) AS st, greatest(coalesce(stale_seconds_last_book, 1e9), 0) AS sb,
    coalesce(top_depth_bid, 0) + coalesce(top_depth_ask, 0) AS depth, coalesce(spread_bps, 10000) AS sp FROM m LEFT JOIN f USING (token) LEFT JOIN vol24 USING (token)),
  q AS (SELECT *, 0.35::DOUBLE * (1 - least(greatest(sp / 1000.0, 0), 1)) + 0.35::DOUBLE * least(ln(1 + depth) / ln(501), 1) + 0.15::DOUBLE * (1 - least(st / 7200.0, 1)) + 0.15::DOUBLE * (1 - least(sb / 7200.0, 1)) AS lq,
    sp >= 1500 OR depth < 1 AS illiquid, greatest(st, sb) >= 14400 AS stale FROM j)"""
_SCORES = f"""{_MARKETS}, r AS (SELECT *, least(greatest(mid_price, 1e-6), 1 - 1e-6) AS z, concat_ws(' ', rule_text, title) AS txt FROM q),
  u AS (SELECT *, coalesce(least(-(z * ln(z) + (1 - z) * ln(1 - z)) / ln(2), 1), 0) AS pq, 0.6::DOUBLE * least(abs(coalesce(return_5m, 0)) / 0.2, 1) + 0.4::DOUBLE * least(coalesce(realized_vol_1h, 0) / 0.2, 1) AS vo,
    ((spread_bps IS NOT NULL)::INT + (top_depth_bid IS NOT NULL)::INT + (top_depth_ask IS NOT NULL)::INT + (book_imbalance_1 IS NOT NULL)::INT + (return_5m IS NOT NULL)::INT + (realized_vol_1h IS NOT NULL)::INT
      + (stale_seconds_last_trade IS NOT NULL)::INT + (stale_seconds_last_book IS NOT NULL)::INT + (mid_price IS NOT NULL)::INT) / 9.0::DOUBLE AS dc,
    CASE WHEN market_id % 3 = 0 THEN 0.1::DOUBLE ELSE 0 END AS amb FROM r),
  y AS (SELECT *, least(greatest(CASE WHEN rule_ok THEN 0.6::DOUBLE ELSE 0 END + 0.4::DOUBLE * least(length(txt) / 400.0, 1) - amb, 0), 1) AS rc, amb + 0.2::DOUBLE * (NOT has)::INT + 0.2::DOUBLE * (mid_price IS NULL)::INT + illiquid::INT + stale::INT AS penalty FROM u),
  w2 AS (SELECT *, CASE WHEN illiquid OR stale THEN 0::DOUBLE ELSE round(least(greatest(0.35::DOUBLE * lq + 0.25::DOUBLE * pq + 0.2::DOUBLE * vo + 0.1::DOUBLE * dc + 0.1::DOUBLE * rc - penalty, 0), 1), 6) END AS screen FROM y)"""
_KEEP = r"[\t-\r\x{1c}-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _norm(c):
    strip = f"regexp_replace(regexp_replace({c}, '^{_KEEP}', ''), '{_KEEP}$', '')"
    return f"coalesce(regexp_replace(lower({strip}), '{_KEEP}', ' ', 'g'), '')"


def _clean(c):
    c = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    for name, value in T.ENTITIES.items():
        c = "replace({}, '{}', '{}')".format(c, name, value.replace("'", "''"))
    return f"nullif(regexp_replace(regexp_replace(regexp_replace({c}, '{_KEEP}', ' ', 'g'), '^ ', ''), ' $', ''), '')"


_FILLED = f"regexp_replace(body, '{_KEEP}', '', 'g') <> ''"
_HASHES = f"""{_ARTICLES}, h AS (SELECT id, published_at, domain, sha256(CASE WHEN {_FILLED} THEN {_norm("body")} ELSE {_norm("title")} END) AS content_hash, sha256({_norm("title")}) AS title_hash FROM a)"""
_STOPS = ", ".join(f"'{w}'" for w in T.STOP)
_PRICES = f"""{_LEDGER}, o AS (SELECT token, side, arg_max(price, (l_orderkey, l_linenumber)) AS own FROM g WHERE l_linenumber = 2 AND token % 3 = 0 GROUP BY ALL),
  e AS (SELECT p_partkey AS token, side, p_retailprice AS other FROM part, (VALUES ('BUY'), ('SELL')) v(side) WHERE p_partkey % 7 <> 0), r AS (SELECT token, side, coalesce(own, other) AS price FROM o FULL JOIN e USING (token, side)),
  p AS (SELECT token, side, sum(quantity) AS quantity, sum(notional)::DOUBLE AS cost FROM g GROUP BY ALL HAVING sum(quantity) > 0)"""
_HOST = "lower(regexp_extract(url, '^[a-z]+://(?:www\\.)?([^/?#:]+)', 1))"


def _toks(c):
    return f"list_filter(list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+')), lambda x: x NOT IN ({_STOPS}))"


_ROUNDED = ", ".join(f"round({c}, 6) + 0::DOUBLE AS {c}" for c in FEATURES)
ORACLES = {
    "micro_features": f"{_features_sql(_SPINE)} SELECT token, t, {_ROUNDED}, trade_count_5m, coalesce(stale_seconds_last_trade, -1) AS stale_seconds_last_trade, coalesce(stale_seconds_last_book, -1) AS stale_seconds_last_book FROM f",
    "book_probabilities": f"""WITH {_TRADES}, q AS (SELECT trade_id AS book_id, CASE WHEN price - 0.01::DOUBLE BETWEEN 0 AND 1 THEN price - 0.01::DOUBLE WHEN price - 0.01::DOUBLE - 0.01::DOUBLE BETWEEN 0 AND 1 THEN price - 0.01::DOUBLE - 0.01::DOUBLE END AS bid,
    CASE WHEN price + 0.01::DOUBLE BETWEEN 0 AND 1 THEN price + 0.01::DOUBLE WHEN price + 0.01::DOUBLE + 0.02::DOUBLE BETWEEN 0 AND 1 THEN price + 0.01::DOUBLE + 0.02::DOUBLE END AS ask FROM t JOIN events ON trade_id = event_id WHERE event_type IN ('view', 'click'))
  SELECT book_id, CASE WHEN bid > 0 AND ask > 0 THEN round((bid + ask) / 2, 6) ELSE -1 END AS price_prob FROM q""",
    "asof_dataset": f"{_DATASET} SELECT token, t, round(price_prob, 6) AS price_prob, coalesce(y, -1) AS y, status FROM e",
    "asof_skips": f"{_DATASET} SELECT status, count(*) AS n FROM e GROUP BY status",
    "selector_scores": f"""{_SCORES} SELECT market_id, ttr, round(lq, 6) AS lq, round(pq, 6) AS pq, round(vo, 6) AS vo, round(dc, 6) AS dc, round(rc, 6) AS rc, round(penalty, 6) AS penalty,
  concat_ws(',', CASE WHEN amb > 0 THEN 'ambiguous_rule' END, CASE WHEN illiquid THEN 'illiquid' END, CASE WHEN NOT has THEN 'missing_features' END, CASE WHEN mid_price IS NULL THEN 'missing_price_prob' END, CASE WHEN stale THEN 'stale_data' END) AS flags,
  screen AS screen_score, round(least(greatest(0.4::DOUBLE * round(pq, 6) + 0.25::DOUBLE * round(vo, 6) + 0.15::DOUBLE * round(dc, 6) + 0.1::DOUBLE * CASE ttr WHEN '0_24h' THEN 1::DOUBLE WHEN '1_7d' THEN 0.85::DOUBLE WHEN '7_30d' THEN 0.55::DOUBLE WHEN '30d_plus' THEN 0.3::DOUBLE ELSE 0.25::DOUBLE END
  + 0.1::DOUBLE * screen - (illiquid OR stale)::INT - round(amb * 0.75::DOUBLE, 6) - 0.15::DOUBLE * (NOT has)::INT - 0.15::DOUBLE * (mid_price IS NULL)::INT, 0), 1), 6) AS deep_score FROM w2""",
    "candidate_set": f"""{_MARKETS}, k AS (SELECT *, row_number() OVER (ORDER BY volume DESC, market_id, token) AS k FROM q), g AS (SELECT market_id, token, volume, ttr, concat_ws(',', CASE WHEN round(lq, 6) >= 0.35 THEN 'by_lq_threshold' END,
  CASE WHEN k <= 80 THEN 'by_volume' END, CASE WHEN hours_old <= 48 THEN 'recently_updated' END) AS reasons FROM k) SELECT * FROM g WHERE reasons <> '' ORDER BY volume DESC, market_id, token LIMIT 100""",
    "calibration_report": f"""WITH {_FORECASTS}, x AS (SELECT lang, FALSE AS overall, p, y FROM f UNION ALL SELECT '', TRUE, p, y FROM f), q AS (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS q, least(floor(p * 10), 9) AS bin FROM x),
  c AS (SELECT lang, overall, bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy, sum((p - y) * (p - y)) AS sb, sum(-(y * ln(q) + (1 - y) * ln(1 - q))) AS sl FROM q GROUP BY ALL),
  r AS (SELECT lang, overall, sum(n)::BIGINT AS n, sum(sb) / sum(n) AS brier, sum(sl) / sum(n) AS log_loss, sum(abs(sp - sy)) / sum(n) AS ece, max(abs(sp - sy) / n) AS mce FROM c GROUP BY ALL)
  SELECT lang, overall, n, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(ece, 6) AS ece, round(mce, 6) AS mce, concat_ws(',', CASE WHEN n < 40 THEN 'too_few' END, CASE WHEN ece > 0.08 THEN 'ece_too_high' END) AS gates FROM r""",
    "entropy_summary": f"""WITH {_FORECASTS}, q AS (SELECT lang, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM f), h AS (SELECT lang, round(least(-(q * ln(q) + (1 - q) * ln(1 - q)) / ln(2), 1), 6) AS h FROM q),
  k AS (SELECT lang, h, row_number() OVER (PARTITION BY lang ORDER BY h) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM h)
  SELECT lang, count(*) AS n, round(avg(h), 6) AS mean, min(h) AS least, max(h) FILTER (k = round_even((n - 1) * 0.5::DOUBLE, 0)) AS p50, max(h) FILTER (k = round_even((n - 1) * 0.9::DOUBLE, 0)) AS p90, max(h) AS largest FROM k GROUP BY lang""",
    "conformal_intervals": f"""WITH {_FORECASTS}, b AS (SELECT *, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS back FROM f),
  t AS (SELECT lang, abs(y - p) AS r, least(greatest(20, ceil(n * 0.25::DOUBLE)), n)::BIGINT AS k, row_number() OVER (PARTITION BY lang ORDER BY abs(y - p)) AS place FROM b WHERE back <= least(greatest(20, ceil(n * 0.25::DOUBLE)), n)),
  w AS (SELECT lang, max(r) FILTER (place = greatest(1, ceil(k * 0.5::DOUBLE))) AS q50, max(r) FILTER (place = greatest(1, ceil(k * 0.9::DOUBLE))) AS q90, max(k) AS calibrated_on FROM t GROUP BY lang),
  i AS (SELECT *, greatest(0, p - q50) AS l5, least(1, p + q50) AS h5, greatest(0, p - q90) AS l9, least(1, p + q90) AS h9 FROM f JOIN w USING (lang))
  SELECT lang, round(any_value(q50), 6) AS q50, round(any_value(q90), 6) AS q90, any_value(calibrated_on) AS calibrated_on, round(avg((y BETWEEN l5 AND h5)::INT), 6) AS coverage_50, round(avg(h5 - l5), 6) AS width_50,
  round(avg((y BETWEEN l9 AND h9)::INT), 6) AS coverage_90, round(avg(h9 - l9), 6) AS width_90 FROM i GROUP BY lang""",
    "url_functions": f"""WITH u AS (SELECT page_id, {_HOST} AS domain, split_part(split_part(url, '#', 1), '?', 2) AS q, regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '^[a-z]+://[^/]*(/.*)?$', 1) AS path, split_part(url, ':', 1) AS s FROM pages),
  v AS (SELECT page_id, domain, lower(s) || '://' || domain || CASE WHEN path = '' THEN '/' ELSE path END AS base, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND x NOT LIKE 'utm\\_%' ESCAPE '\\')) AS q FROM u),
  w AS (SELECT page_id, domain, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM v) SELECT *, sha256(canonical) AS url_hash FROM w""",
    "html_articles": f"""SELECT page_id, coalesce({_clean("regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title>', 1)")}, {_clean("regexp_extract(html, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1>', 1)")}) AS title,
  coalesce({_clean("regexp_extract(html, '(?is)<article(?:\\s[^>]*)?>(.*?)</article>', 1)")}, nullif(array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1), lambda p: {_clean("p")}), lambda p: p IS NOT NULL), ' '), '')) AS body FROM pages""",
    "article_hashes": f"WITH {_HASHES} SELECT id, content_hash, title_hash FROM h",
    "soft_duplicates": f"""WITH {_HASHES}, c AS (SELECT x.id, arg_max(y.id, (y.published_at, -y.id)) AS d FROM h x JOIN h y ON x.content_hash = y.content_hash AND (y.published_at, y.id) < (x.published_at, x.id) GROUP BY x.id),
  t AS (SELECT x.id, arg_max(y.id, (y.published_at, -y.id)) AS d FROM h x JOIN h y ON x.title_hash = y.title_hash AND x.domain = y.domain AND (y.published_at, y.id) < (x.published_at, x.id) AND y.published_at >= x.published_at - to_hours(24) GROUP BY x.id)
  SELECT h.id, coalesce(c.d, t.d, -1) AS duplicate_of, CASE WHEN c.d IS NOT NULL THEN 'content_hash' WHEN t.d IS NOT NULL THEN 'title_window' ELSE 'new' END AS reason FROM h LEFT JOIN c USING (id) LEFT JOIN t USING (id)""",
    "article_market_links": f"""WITH {_ARTICLES}, d AS (SELECT id, {_toks("title")} AS tt, {_toks("body")} AS bt FROM a), w AS (SELECT id, unnest(list_distinct(list_concat(tt, bt))) AS w, tt, bt FROM d),
  ww AS (SELECT id, w, list_contains(tt, w)::INT AS t, list_contains(bt, w)::INT AS b FROM w), e AS (SELECT item_id AS market_id, {_toks("text")} AS mt, {_toks("split_part(text, '.', 1)")} AS ms FROM benchmark),
  l AS (SELECT market_id, unnest(list_distinct(list_concat(mt, ms))) AS w, mt, ms FROM e), g AS (SELECT id, market_id, sum(t * list_contains(mt, w)::INT)::BIGINT AS title_hits, sum(b * list_contains(mt, w)::INT)::BIGINT AS body_hits, sum(list_contains(ms, w)::INT)::BIGINT AS slug_hits FROM ww JOIN l USING (w) GROUP BY ALL),
  s AS (SELECT *, 2.0::DOUBLE * title_hits + body_hits + 0.5::DOUBLE * slug_hits AS score FROM g) SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, market_id)::INT AS rank FROM s QUALIFY rank <= 5""",
    "domain_policies": f"""WITH u AS (SELECT page_id, {_HOST} AS domain FROM pages), a AS (SELECT DISTINCT regexp_extract(domain, '[^.]+\\.[^.]+$') AS policy FROM u), o AS (SELECT DISTINCT domain FROM u WHERE page_id % 3 = 0)
  SELECT page_id, domain, coalesce((SELECT o.domain FROM o WHERE o.domain = u.domain), (SELECT policy FROM a WHERE policy <> 'example.net' AND (u.domain = policy OR ends_with(u.domain, '.' || policy)) ORDER BY length(policy) DESC LIMIT 1), '') AS policy FROM u""",
    "mark_to_model": f"WITH {_PRICES} SELECT token, side, round(price, 6) AS price, round(quantity * price, 6) AS value, round(quantity * price - cost, 6) AS gain FROM p LEFT JOIN r USING (token, side)",
    "missing_prices": f"WITH {_PRICES} SELECT token, side FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.token = p.token AND r.side = p.side AND r.price IS NOT NULL)",
    "run_performance": f"""WITH {_LEDGER}, r AS (SELECT l_orderkey, sum(CASE WHEN side = 'SELL' THEN notional ELSE 0 END)::DOUBLE AS gain, sum(notional)::DOUBLE AS notional FROM g GROUP BY 1), b AS (SELECT CASE WHEN notional > 0 THEN gain / notional * 10000 ELSE 0 END AS b, (notional <= 0)::INT AS z FROM r)
  SELECT count(*) AS runs, round(avg(b), 6) AS mean_bps, round(median(b), 6) AS median_bps, round(min(b), 6) AS worst_bps, round(max(b), 6) AS best_bps, avg(z) AS zero_rate FROM b""",
    "sequence_gaps": """WITH e AS (SELECT event_type AS channel, event_id AS seq, ts, lag(event_id) OVER w AS p, max(ts) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id))
  SELECT channel, seq, CASE WHEN p + 1 <> seq THEN 'sequence_gap' WHEN ts < m THEN 'time_regression' ELSE 'stale' END AS reason FROM e WHERE p + 1 <> seq OR ts < m OR floor(epoch(ts)) - floor(epoch(m)) > 3600""",
    "channel_throughput": "SELECT date_trunc('day', ts)::TIMESTAMP AS start_ts, event_type AS channel, count(DISTINCT (user_id, ts)) AS messages FROM events GROUP BY 1, 2",
}
