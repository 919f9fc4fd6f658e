"""Registered queries of claims and of intervals, with the same in DuckDB's SQL. A customer is a market, the goods that
it bought are claims about it, their suppliers the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims, uncertainty
from .queries import _FORECASTS, _forecasts, _rounded, _table


def raw_claims(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    li = li.join(_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    text = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit(", "), F.col("p_type"))).otherwise("!"))
    domain = F.concat(F.lit("s"), F.col("l_suppkey") % 7, F.lit(".org"))
    return li.select(
        F.col("o_custkey").alias("market_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), text.alias("text"), F.when(F.col("l_partkey") % 5 > 0, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("published_at"), domain.alias("domain"),
        F.concat(F.lit("https://"), domain, F.lit("/"), F.col("l_suppkey")).alias("url"), F.when(F.col("l_suppkey") % 2 == 0, "primary").otherwise("secondary").alias("source_type"),
    )


def _clusters(spark, sf_dir):
    c = claims.canonical(claims.clusters(raw_claims(spark, sf_dir)), most=12)
    return c.select("market_id", "cluster_id", F.array_join(F.transform("claim_ids", lambda x: x.cast("string")), ",").alias("claim_ids"), "representative_id", "claim_hash", "kept")


def _echo(spark, sf_dir):
    raw = raw_claims(spark, sf_dir)
    kept = claims.canonical(claims.clusters(raw), most=12).where("kept")
    return _rounded(claims.echo(claims.canonical_sources(kept, raw, most_primary=2)), "diversity", "penalty")


def _report(spark, sf_dir):
    f, d = _forecasts(spark, sf_dir), F.col("doc_id")
    half = F.when(d % 11 == 0, 0.0).otherwise(0.05 + (d % 7) / 20.0)
    low, high = F.greatest(F.col("p") - half, F.lit(0.0)), F.least(F.col("p") + half, F.lit(1.0))
    f = f.withColumns({"low_50": F.when(d % 31 == 0, F.lit(2.0)).otherwise(low), "high_50": high, "low_90": F.when(d % 13 == 0, F.col("p")).otherwise(F.greatest(low - 0.2, F.lit(0.0))), "high_90": F.when(d % 37 == 0, 1.2).when(d % 41 == 0, F.lit(None)).when(d % 13 == 0, F.col("p")).otherwise(F.least(high + 0.2, F.lit(1.0)))})
    got = uncertainty.interval_report(f, "lang", "doc_id")
    rates = [f"{c}_{k}" for k in ("50", "90") for c in ("coverage", "mean_width", "median_width", "degenerate_rate")]
    return _rounded(got, *rates).withColumns({"flags": F.concat_ws(",", "flags"), "examples": F.concat_ws("; ", "examples")})


QUERIES = {"claim_clusters": _clusters, "claim_echo": _echo, "interval_report": _report}
_CLAIMS = """c AS (SELECT o_custkey AS market_id, l_orderkey * 10 + l_linenumber AS claim_id, p_name || CASE WHEN p_partkey % 3 > 0 THEN ', ' || p_type ELSE '!' END AS text, CASE WHEN l_partkey % 5 > 0 THEN strftime(l_shipdate, '%Y-%m-%d') END AS published_at,
    's' || (l_suppkey % 7) || '.org' AS domain, 'https://s' || (l_suppkey % 7) || '.org/' || l_suppkey AS url, CASE WHEN l_suppkey % 2 = 0 THEN 'primary' ELSE 'secondary' END AS source_type
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
  w AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS words, row_number() OVER (PARTITION BY market_id ORDER BY published_at NULLS LAST, domain, claim_id, text) AS k FROM c),
  s AS (SELECT market_id, 0::BIGINT AS k, [{'id': 0::BIGINT, 'text': '', 'words': [''], 'ids': [0::BIGINT]}][2:] AS g FROM (SELECT DISTINCT market_id FROM w) UNION ALL
    SELECT market_id, k, CASE WHEN hit IS NULL THEN list_append(g, {'id': claim_id, 'text': text, 'words': words, 'ids': [claim_id]}) ELSE list_transform(g, lambda c, i: CASE WHEN i = hit THEN CASE WHEN (length(text), claim_id) < (length(c.text), c.id)
      THEN {'id': claim_id, 'text': text, 'words': words, 'ids': list_append(c.ids, claim_id)} ELSE {'id': c.id, 'text': c.text, 'words': c.words, 'ids': list_append(c.ids, claim_id)} END ELSE c END) END FROM
    (SELECT w.*, g, list_filter(list_transform(g, lambda c, i: CASE WHEN len(list_intersect(c.words, w.words)) * 2 >= len(list_distinct(list_concat(c.words, w.words))) THEN i END), lambda i: i IS NOT NULL)[1] AS hit FROM s JOIN w ON s.market_id = w.market_id AND w.k = s.k + 1)),
  e AS (SELECT market_id, arg_max(g, k) AS g FROM s GROUP BY market_id), x AS (SELECT market_id, unnest(g) AS c, unnest(range(1, len(g) + 1)) AS cluster_id FROM e)"""
_INTERVALS = f"""{_FORECASTS}, h AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 0.05 + (doc_id % 7) / 20.0 END::DOUBLE AS half FROM f), g AS (SELECT *, greatest(p - half, 0) AS lo, least(p + half, 1) AS hi FROM h),
  b AS (SELECT lang, doc_id, y, CASE WHEN doc_id % 31 = 0 THEN 2 ELSE lo END::DOUBLE AS l5, hi::DOUBLE AS h5, CASE WHEN doc_id % 13 = 0 THEN p ELSE greatest(lo - 0.2::DOUBLE, 0) END::DOUBLE AS l9, CASE WHEN doc_id % 37 = 0 THEN 1.2 WHEN doc_id % 41 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN p ELSE least(hi + 0.2::DOUBLE, 1) END::DOUBLE AS h9 FROM g),
  l AS (SELECT lang, doc_id, y, '50' AS level, l5 AS lo, h5 AS hi FROM b UNION ALL SELECT lang, doc_id, y, '90', l9, h9 FROM b), k AS (SELECT *, coalesce(lo <= hi, FALSE) AS ok, greatest(0, least(lo, 1)) AS cl, greatest(0, least(hi, 1)) AS ch FROM l),
  v AS (SELECT *, CASE WHEN ok THEN ch - cl END AS width, NOT ok OR lo < 0 OR hi > 1 AS invalid, coalesce(ok AND ch - cl <= 1e-12, FALSE) AS flat, coalesce(ok AND y BETWEEN cl AND ch, FALSE) AS covered FROM k),
  a AS (SELECT lang, level, count(*) AS n, avg(covered::INT) AS coverage, coalesce(sum(width), 0) / count(*) AS mean_width, coalesce(median(width), 0) AS median_width, avg(flat::INT) AS degenerate_rate, sum(invalid::INT)::BIGINT AS invalid FROM v GROUP BY ALL),
  nar AS (SELECT x.lang, x.doc_id FROM v x JOIN v z ON x.lang = z.lang AND x.doc_id = z.doc_id AND x.level = '50' AND z.level = '90' WHERE x.ok AND z.ok AND z.width + 1e-12 < x.width),
  bad AS (SELECT lang, doc_id, 'invalid_interval:' || level AS code FROM v WHERE invalid UNION ALL SELECT lang, doc_id, 'degenerate_interval:' || level FROM v WHERE flat UNION ALL SELECT lang, doc_id, 'monotonic_width_violation:all' FROM nar),
  ex AS (SELECT lang, code || ':' || string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id) AS t FROM (SELECT * FROM bad QUALIFY row_number() OVER (PARTITION BY lang, code ORDER BY doc_id) <= 5) GROUP BY lang, code),
  ee AS (SELECT lang, string_agg(t, '; ' ORDER BY t) AS examples FROM ex GROUP BY lang), nn AS (SELECT lang, count(*) AS narrower FROM nar GROUP BY lang)"""
_R = ", ".join(f"round(c{k}.{c}, 6) AS {c}_{k}" for k in ("50", "90") for c in ("coverage", "mean_width", "median_width", "degenerate_rate"))
ORACLES = {
    "claim_clusters": f"""WITH RECURSIVE {_CLAIMS} SELECT market_id, cluster_id::INT AS cluster_id, array_to_string(list_sort(c.ids), ',') AS claim_ids, c.id AS representative_id,
  sha256(trim(regexp_replace(regexp_replace(lower(c.text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS claim_hash, cluster_id <= 12 AS kept FROM x""",
    "claim_echo": f"""WITH RECURSIVE {_CLAIMS}, m AS (SELECT market_id, cluster_id, unnest(c.ids) AS claim_id FROM x WHERE cluster_id <= 12), o AS (SELECT market_id, cluster_id, domain, url, source_type, min(published_at) AS p FROM m JOIN c USING (market_id, claim_id) GROUP BY ALL),
  t AS (SELECT *, row_number() OVER (PARTITION BY market_id, cluster_id, source_type ORDER BY domain, url, p NULLS FIRST) AS k FROM o QUALIFY source_type <> 'primary' OR k <= 2),
  d AS (SELECT market_id, cluster_id, domain, count(*) AS c, max((source_type = 'primary')::INT) AS p FROM t GROUP BY ALL), g AS (SELECT market_id, cluster_id, sum(c) AS n, count(*) AS u, sum(p)::BIGINT AS pd, max(c) AS top FROM d GROUP BY ALL)
  SELECT market_id, cluster_id::INT AS cluster_id, u AS unique_domains, pd AS primary_domains, round(u / n, 6) AS diversity, round(CASE WHEN n <= 1 THEN 0 WHEN u <= 1 THEN 1 ELSE greatest(0, least(1, (top / n - 1 / u) / (1 - 1 / u))) END, 6)::DOUBLE AS penalty FROM g""",
    "interval_report": f"""WITH {_INTERVALS} SELECT c50.lang, c50.n, {_R}, c50.invalid AS invalid_50, c90.invalid AS invalid_90, coalesce(narrower, 0) AS narrower, coalesce(examples, '') AS examples,
  concat_ws(',', CASE WHEN c50.n < 50 THEN 'insufficient_uncertainty_data' END, CASE WHEN c50.invalid + c90.invalid > 0 THEN 'conformal_invalid_intervals' END, CASE WHEN greatest(c50.degenerate_rate, c90.degenerate_rate) > 0.25 THEN 'conformal_degenerate_intervals' END,
    CASE WHEN c90.coverage < 0.85 THEN 'coverage_below_target_90' END, CASE WHEN c50.coverage < 0.45 THEN 'coverage_below_target_50' END) AS flags FROM a c50 JOIN a c90 ON c50.lang = c90.lang AND c50.level = '50' AND c90.level = '90' LEFT JOIN nn ON c50.lang = nn.lang LEFT JOIN ee ON c50.lang = ee.lang""",
}
