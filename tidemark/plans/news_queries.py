"""Registered queries of articles as they arrive, with the same in DuckDB's SQL. Documents are articles; every fifth has
the URL of an earlier one, every seventh doesn't know when it was published."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedupe
from .market_queries import _HASHES, articles
from .queries import _table


def arrivals(spark, sf_dir):
    a = articles(spark, sf_dir).join(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    key = F.col("id")
    a = a.withColumn("n", key).withColumn("given_url", F.concat(F.lit("https://www.x.org/"), F.when(key % 5 == 0, F.floor(key / 10)).otherwise(key), F.lit("?utm_source=a#b")))
    none = F.lit(None).cast("string")
    # Every third arrives twelve hours before its time: the nearest earlier one may be later by its own clock.
    at = F.col("published_at") + F.expr("make_dt_interval(0, cast(IF(id % 3 = 0, 12, 0) AS int))")
    return a.withColumns({"published_at": at, "url": T.canonical_url(F.col("given_url")), "content_hash": T.content_hash(F.col("title"), F.col("body"), none), "title_hash": T.text_hash(F.col("title")), "summary": none, "ingested_at": F.col("published_at"), "unknown": key % 7 == 0})


def _found(spark, sf_dir):
    return dedupe.outcomes(arrivals(spark, sf_dir))


def _stored(spark, sf_dir):
    a = arrivals(spark, sf_dir)
    m = dedupe.merged(a, dedupe.outcomes(a))
    md5 = lambda c: F.md5(F.coalesce(F.col(c), F.lit(""))).alias(c)
    return m.select("article_id", "n_articles", "given_url", md5("title"), md5("body"), F.coalesce("lang", F.lit("")).alias("lang"), "published_at", "unknown")


QUERIES = {"article_outcomes": lambda s, d: _found(s, d).drop("n"), "stored_articles": _stored}
_ARRIVALS = f"""{_HASHES.replace("h AS (", "h AS MATERIALIZED (")}, r AS (SELECT h.id, h.published_at + to_hours(CASE WHEN h.id % 3 = 0 THEN 12 ELSE 0 END) AS published_at, h.domain, content_hash, title_hash, 'https://x.org/' || CASE WHEN h.id % 5 = 0 THEN h.id // 10 ELSE h.id END AS url, row_number() OVER (ORDER BY h.id) AS k FROM h),
  s AS (SELECT 0::BIGINT AS k, [{{'id': 0::BIGINT, 'p': TIMESTAMP '2024-01-01', 'd': '', 'u': '', 'c': '', 't': ''}}][2:] AS g, 0::BIGINT AS id, 0::BIGINT AS article_id, '' AS reason UNION ALL
    SELECT k, CASE WHEN hit IS NULL THEN list_append(g, {{'id': id, 'p': published_at, 'd': domain, 'u': url, 'c': content_hash, 't': title_hash}}) ELSE g END, id, coalesce(hit, id), CASE WHEN hit IS NULL THEN '' WHEN hu IS NOT NULL THEN 'canonical_url' WHEN hc IS NOT NULL THEN 'content_hash' ELSE 'title_window' END FROM
    (SELECT *, coalesce(hu, hc, ht) AS hit FROM (SELECT r.*, g, list_filter(g, lambda x: x.u = r.url)[1].id AS hu, list_filter(g, lambda x: x.c = r.content_hash)[1].id AS hc,
      list_sort(list_transform(list_filter(g, lambda x: x.t = r.title_hash AND x.d = r.domain AND abs(epoch(x.p) - epoch(r.published_at)) <= 86400), lambda x: {{'gap': abs(epoch(x.p) - epoch(r.published_at)), 'id': x.id}}))[1].id AS ht FROM s JOIN r ON r.k = s.k + 1)))"""
ORACLES = {
    "article_outcomes": f"WITH RECURSIVE {_ARRIVALS} SELECT id, article_id, CASE WHEN reason = '' THEN 'inserted' ELSE 'updated' END AS outcome, reason FROM s WHERE k > 0",
    "stored_articles": f"""WITH RECURSIVE {_ARRIVALS}, m AS (SELECT s.article_id, s.id, a.title, a.body, d.lang, r.published_at, s.id % 7 = 0 AS unknown, 'https://www.x.org/' || CASE WHEN s.id % 5 = 0 THEN s.id // 10 ELSE s.id END || '?utm_source=a#b' AS given_url
    FROM s JOIN a ON s.id = a.id JOIN documents d ON s.id = d.doc_id JOIN r ON s.id = r.id WHERE s.k > 0)
  SELECT article_id, count(*) AS n_articles, arg_max(given_url, id) AS given_url, md5(coalesce(arg_min(title, id) FILTER (trim(title, ' ') <> ''), '')) AS title, md5(coalesce(arg_min(body, id) FILTER (trim(body, ' ') <> ''), '')) AS body, coalesce(arg_min(lang, id) FILTER (trim(lang) <> ''), '') AS lang,
    coalesce(arg_min(published_at, id) FILTER (NOT unknown), arg_min(published_at, id)) AS published_at, bool_and(unknown) AS unknown FROM m GROUP BY article_id""",
}
