"""Articles: earlier copies, links to markets, and policies of domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20


def soft_duplicates(articles: DataFrame, hours: int = 24) -> DataFrame:
    """articles (id, published_at, domain, content_hash, title_hash) with duplicate_of and reason.

    Articles arrive in the order of published_at and id. An article's match is the one before it nearest in time with
    the same content, else with the same title and domain at most `hours` before; of several at one time the smallest
    id. A running maximum per hash finds it: no pairs. Rows without a hash have no match under it."""
    at = F.struct("published_at", (-F.col("id")).alias("i"))

    def before(keys):
        return F.max(at).over(Window.partitionBy(*keys).orderBy("published_at", "id").rowsBetween(Window.unboundedPreceding, -1))

    near = F.col("_t.published_at") >= F.col("published_at") - F.expr(f"INTERVAL {hours} HOURS")
    same = F.when(F.col("content_hash").isNotNull(), before(["content_hash"]))
    title = F.when(F.col("title_hash").isNotNull(), before(["title_hash", "domain"]))
    df = articles.withColumn("_c", same).withColumn("_t", title)
    df = df.withColumn("reason", F.when(F.col("_c").isNotNull(), "content_hash").when(near, "title_window").otherwise("new"))
    return df.withColumn("duplicate_of", F.when(F.col("reason") == "content_hash", -F.col("_c.i")).when(F.col("reason") == "title_window", -F.col("_t.i")).otherwise(-1)).drop("_c", "_t")


def market_links(articles: DataFrame, markets: DataFrame, most: int = 5) -> DataFrame:
    """articles (id, title, body as token sets) and markets (market_id, title, slug as token sets) to the best `most`
    markets of each article: 2 for each word of the market's title in the article's, 1 for each in its body, 0.5 for
    each of the slug in either. Words meet by an equi-join, so only markets that share one are scored."""
    words = articles.select("id", F.explode(F.array_union("title", "body")).alias("w"), "title", "body")
    words = words.select("id", "w", F.array_contains("title", F.col("w")).cast("int").alias("t"), F.array_contains("body", F.col("w")).cast("int").alias("b"))
    lexicon = markets.select("market_id", F.explode(F.array_union("title", "slug")).alias("w"), "title", "slug")
    lexicon = lexicon.select("market_id", "w", F.array_contains("title", F.col("w")).cast("int").alias("mt"), F.array_contains("slug", F.col("w")).cast("int").alias("ms"))
    hits = words.join(lexicon, "w").groupBy("id", "market_id").agg(F.sum(F.col("t") * F.col("mt")).alias("title_hits"), F.sum(F.col("b") * F.col("mt")).alias("body_hits"), F.sum("ms").alias("slug_hits"))
    scored = hits.withColumn("score", 2.0 * F.col("title_hits") + F.col("body_hits") + 0.5 * F.col("slug_hits"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "market_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def domain_policies(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """rows (domain, ...) with the policy (domain, allow_subdomains) of that very domain, else the longest parent's that
    allows subdomains; null if there is none. Each row meets one policy name per label of its domain, by equality."""
    own = policies.select(F.col("domain").alias("policy"), "allow_subdomains").groupBy("policy").agg(F.max("allow_subdomains").alias("allow_subdomains"))
    names = rows.select("domain").where("domain IS NOT NULL").distinct()
    labels = F.split("domain", r"\.")
    parents = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    found = names.withColumn("policy", F.explode(parents)).join(own, "policy").where(F.col("allow_subdomains") | (F.col("policy") == F.col("domain")))
    best = found.groupBy("domain").agg(F.max_by("policy", F.length("policy")).alias("policy"))
    return rows.join(best, "domain", "left")
