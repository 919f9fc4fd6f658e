"""Registered queries of payloads of claims and of stored articles. Each event is a payload, right or wrong in one of
several ways; tests hold these against plain Python over all of them. Pages are articles that arrive in three batches,
one of them twice and none in order, and have the same in DuckDB's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from ..operators import payloads
from ..sinks.articles import ArticleStore, stable_id
from ..sinks.merge import shared_dir
from .queries import _table

_HEAD = '"schema_version": "claim_extract.v1", "market_id": "m$u", "generated_at": "2024-01-01T00:00:00Z"'
#: $i, $u, $v and $k stand for the event's number, user, value and inner number.
SHAPES = [
    "{" + _HEAD + ', "claims": [{"claim_text": "c$i", "stance": "support", "confidence": 0.5, "sources": [{"url": "https://s$u.org/$k"}, {"url": "https://s$u.org/$i?a=1", "title": "t"}]}], "meta": {"k": $k}}',
    "{" + _HEAD + ', "claims": [{"claim_text": "", "stance": "maybe", "confidence": $v, "sources": [{"url": "https://www.s$u.org/a?utm_source=x#f"}, {"url": "https://S$u.org/a"}, {"title": 5, "source_type": "own"}]}]}',
    '{"schema_version": "v2", "market_id": "", "claims": [{"stance": "neutral", "sources": [$k, null]}, "text"], "extra": 1, "also": null}',
    "{" + _HEAD + ', "claims": [], "canonical_claims": [{"claim_canonical": "c", "claim_hash": "' + "a1" * 32 + '", "source_urls": ["u$i", "u$k", "u$i"], "evidence_count": $k}, {"claim_canonical": "d", "claim_hash": "A1", "source_urls": ["u"], "evidence_count": -1.5}]}',
    "{" + _HEAD + ', "claims": [' + ", ".join(['{"claim_text": "c", "stance": "oppose", "sources": []}'] * 81) + "]}",
    "{" + _HEAD + ', "claims": [{"claim_text": "c", "stance": "unknown", "sources": [' + ", ".join(f'{{"url": "https://s$u.org/{j}"}}' for j in range(11)) + "]}]}",
    '["$i"]',
    "{broken $i",
    "{" + _HEAD + ', "claims": {"claim_text": "c"}, "canonical_claims": null}',
]


def claim_payloads(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    fill = {"$i": F.col("event_id").cast("string"), "$u": F.col("user_id").cast("string"), "$v": F.col("value").cast("string"), "$k": F.get_json_object("props", "$.k")}
    raw = F.element_at(F.array(*map(F.lit, SHAPES)), (F.col("event_id") % len(SHAPES) + 1).cast("int"))
    for name, value in fill.items():
        raw = F.replace(raw, F.lit(name), value)
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("m"), F.col("user_id")).alias("market_id"), raw.alias("payload"))


def _issues(spark, sf_dir):
    rows = claim_payloads(spark, sf_dir).select("id", F.explode(payloads.issues(F.col("payload"))).alias("i"))
    return rows.select("id", "i.path", "i.code", "i.reason")


def _outcomes(spark, sf_dir):
    return payloads.outcome(claim_payloads(spark, sf_dir), "id").select("id", "used_fallback", F.size("issues").alias("n_issues"), F.array_join("no_trade_flags", ",").alias("flags"), "payload")


def _pages(spark, sf_dir):
    key = F.col("page_id")
    day = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(cast(page_id % 300 AS int))")
    p = _table(spark, sf_dir, "pages").select(key, (key % 5 * 10_000_000 + key).alias("at"), F.concat(F.lit("d"), key % 17, F.lit(".org")).alias("domain"), F.concat(F.lit("https://x.org/"), F.floor(key / 3)).alias("url"), F.col("url").alias("given"), day.alias("day"))
    return p


def _store(spark, sf_dir):
    store, p = ArticleStore(spark, f"{shared_dir(spark)}/tidemark-articles-{uuid.uuid4().hex}", TimestampNTZType(), buckets=16), _pages(spark, sf_dir)
    none = F.lit(None).cast("string")
    for b in (2, 0, 1, 0):
        part = p.where(F.col("page_id") % 3 == b)
        ids = store.write_sources(part.select("domain", "at", F.col("given").alias("name"), (F.col("page_id") % 2 == 0).alias("is_primary"), (F.col("page_id") % 100).alias("trust_score")))
        texts = {"canonical_url": F.col("given"), "title": F.concat(F.lit("t"), "page_id"), "body": none, "summary": none, "lang": F.lit("en"), "raw": F.lit("{}")}
        written = store.write_articles(part.join(ids, "domain").select("url", "at", "source_id", *[c.alias(n) for n, c in texts.items()], F.col("day").alias("published_at"), F.col("day").alias("ingested_at")))
        ids = F.when(F.col("page_id") % 4 > 0, F.array(F.concat(F.lit("m"), F.col("page_id") % 7), F.lit(""), F.concat(F.lit("m"), F.col("page_id") % 3), F.lit(None).cast("string")))
        store.replace_links(part.join(written, "url").select("article_id", "at", ids.alias("market_ids")))
    return store


def _asked(spark, sf_dir):
    """The articles that a third of the pages' URLs ask for, by their ids."""
    ids = _pages(spark, sf_dir).where("page_id DIV 3 % 3 = 0").select(stable_id(F.col("url")).alias("article_id"))
    return _store(spark, sf_dir).get(ids).select("article_id", "url", "title", "domain", F.col("at").alias("written"), "published_at")


QUERIES = {
    "claim_payload_issues": _issues,
    "claim_payload_outcomes": _outcomes,
    "stored_sources": lambda s, d: _store(s, d).sources().select("domain", "source_id", "name", "is_primary", "trust_score"),
    "articles_by_id": _asked,
    "article_links": lambda s, d: _store(s, d).links(),
}
_ID = "('0x' || substr(md5({}), 1, 15))::BIGINT"
_PAGES = "p AS (SELECT page_id, page_id % 5 * 10000000 + page_id AS o, 'd' || (page_id % 17) || '.org' AS domain, 'https://x.org/' || (page_id // 3) AS url, url AS given, TIMESTAMP '2024-01-01' + to_days((page_id % 300)::INT) AS day FROM pages)"
ORACLES = {
    "stored_sources": f"WITH {_PAGES} SELECT domain, {_ID.format('domain')} AS source_id, arg_max(given, o) AS name, arg_max(page_id, o) % 2 = 0 AS is_primary, max_by(page_id, o) % 100 AS trust_score FROM p GROUP BY domain",
    "articles_by_id": f"WITH {_PAGES} SELECT {_ID.format('url')} AS article_id, url, 't' || arg_max(page_id, o) AS title, arg_max(domain, o) AS domain, max(o) AS written, arg_max(day, o) AS published_at FROM p WHERE page_id // 3 % 3 = 0 GROUP BY url",
    "article_links": f"""WITH {_PAGES}, l AS (SELECT url, arg_max(page_id, o) AS k FROM p GROUP BY url)
  SELECT DISTINCT {_ID.format('url')} AS article_id, unnest(['m' || (k % 7), 'm' || (k % 3)]) AS market_id FROM l WHERE k % 4 > 0""",
}
