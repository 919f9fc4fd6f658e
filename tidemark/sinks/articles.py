"""Stored articles, their sources and their links to markets, written in batches that may be replayed or reordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .merge import MergeTable

TEXTS = ("canonical_url", "title", "body", "summary", "lang", "raw")


def stable_id(name: Column) -> Column:
    """An id that follows from the name: 60 bits of its MD5. A writer so knows the id of what it writes without asking
    the table, and two writers that meet the same name agree on it."""
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def _schema(key: str, key_type, rest: dict) -> StructType:
    return StructType([StructField(key, key_type), *[StructField(c, t) for c, t in rest.items()]])


class ArticleStore:
    """Sources by domain, articles by URL and the links of an article as one row, each in a merged table.

    All batches carry `at`, the whole number by which writes are ordered; of equal ones the larger row stays. A later
    write replaces an earlier one whole, whichever comes first. Rows without domain, URL or article id are not stored."""

    def __init__(self, spark: SparkSession, path: str, time_type, buckets: int = 64):
        text, whole = StringType(), LongType()
        rest = {"at": whole, "source_id": whole, **dict.fromkeys(TEXTS, text), "published_at": time_type, "ingested_at": time_type}
        self._sources = MergeTable(spark, f"{path}/sources", _schema("domain", text, {"at": whole, "name": text, "is_primary": text, "trust_score": whole}), ["domain"], ["at"], buckets=buckets)
        self._articles = MergeTable(spark, f"{path}/articles", _schema("url", text, rest), ["url"], ["at"], buckets=buckets)
        self._links = MergeTable(spark, f"{path}/links", _schema("article_id", whole, {"at": whole, "market_ids": ArrayType(text)}), ["article_id"], ["at"], buckets=buckets)

    def write_sources(self, rows: DataFrame) -> DataFrame:
        """rows (domain, at, name, is_primary, trust_score) are stored; (domain, source_id) of the batch's domains."""
        known = rows.where("domain IS NOT NULL")
        self._sources.merge(known.withColumn("is_primary", F.col("is_primary").cast("string")))
        return known.select("domain").distinct().withColumn("source_id", stable_id(F.col("domain")))

    def write_articles(self, rows: DataFrame) -> DataFrame:
        """rows (url, at, source_id, the texts, published_at, ingested_at) are inserted, or replace what is stored under
        their URL; (url, article_id) of the batch's URLs."""
        known = rows.where("url IS NOT NULL")
        self._articles.merge(known)
        return known.select("url").distinct().withColumn("article_id", stable_id(F.col("url")))

    def replace_links(self, rows: DataFrame) -> None:
        """rows (article_id, at, market_ids) replace all links of their articles; an empty or null list removes them.
        Null and empty names are left out and each counts once."""
        ids = F.sort_array(F.array_distinct(F.filter(F.coalesce("market_ids", F.array().cast("array<string>")), lambda m: m != "")))
        self._links.merge(rows.where("article_id IS NOT NULL").withColumn("market_ids", ids))

    def sources(self) -> DataFrame:
        return self._sources.read().withColumns({"is_primary": F.col("is_primary").cast("boolean"), "source_id": stable_id(F.col("domain"))})

    def articles(self) -> DataFrame:
        """The stored articles, each with the domain of its source where this is stored."""
        s = self._sources.read().select(stable_id(F.col("domain")).alias("source_id"), "domain")
        return self._articles.read().withColumn("article_id", stable_id(F.col("url"))).join(s, "source_id", "left")

    def get(self, ids: DataFrame) -> DataFrame:
        """The stored articles of ids (article_id)."""
        return self.articles().join(ids.select("article_id"), "article_id", "left_semi")

    def links(self) -> DataFrame:
        """(article_id, market_id)."""
        return self._links.read().select("article_id", F.explode("market_ids").alias("market_id"))
