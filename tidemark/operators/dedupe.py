"""Articles deduplicated as they arrive: which stored article each one updates, and what the stored ones become."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks.staged import drop, staged

HOURS = 24
_DAYS = (-1, 0, 1)


def _near(rows: DataFrame, other: DataFrame, what: list, how: str = "left") -> DataFrame:
    """rows with other's columns for their title, domain and each of the days around their own."""
    return rows.withColumn("_d", F.explode(F.array(*[F.col("day") + d for d in _DAYS]))).join(other.select("title_hash", "domain", F.col("day").alias("_d"), *what), ["title_hash", "domain", "_d"], how)


def _prepared(articles: DataFrame) -> DataFrame:
    return articles.select("n", "id", "published_at", "domain", "url", "content_hash", "title_hash", F.datediff("published_at", F.lit("1970-01-01")).alias("day"))


def leaders(articles: DataFrame, hours: int = HOURS) -> tuple[DataFrame, str]:
    """The articles that are stored as new, as a written table and its path: those that no stored earlier one matches by
    canonical URL, by content, or by title and domain at most `hours` apart.

    An article is new if none of the earlier ones it could match is. That chain is resolved in rounds over all of them at
    once: the first of each of its keys is new, what it matches is not, and the rest goes on. Equal keys meet in
    aggregations; titles meet by day, where stored ones are more than `hours` apart and so few. A key shared by very
    many is settled in one round; a title that goes on for days takes a round for each stored article of it."""
    return _rounds(*staged(_prepared(articles), "articles"), hours, keep=False)


def _rounds(left: DataFrame, path: str, hours: int, keep: bool) -> tuple[DataFrame, str]:
    """leaders() of a staged table, which is deleted after its round unless it is kept."""
    done, last = None, None
    while True:
        first = lambda key: left.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("n").alias(f"_{key}"))
        days = left.where("title_hash IS NOT NULL AND domain IS NOT NULL").groupBy("title_hash", "domain", "day").agg(F.min("n").alias("_title"))
        free = left.join(first("url"), "url", "left").join(first("content_hash"), "content_hash", "left").where("(_url IS NULL OR n = _url) AND (_content_hash IS NULL OR n = _content_hash)").select(left.columns)
        early = _near(free, days, ["_title"]).groupBy("n").agg(F.min("_title").alias("_title"))
        fresh, at = staged(free.join(early, "n").where("_title IS NULL OR n <= _title").select(left.columns), "new")
        done = fresh if done is None else done.unionByName(fresh)
        # What the new ones match is stored under them; both leave.
        hit = lambda key, name: fresh.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("n").alias(name))
        rest = left.join(hit("url", "_u"), "url", "left").join(hit("content_hash", "_c"), "content_hash", "left").where("NOT coalesce(_u <= n, FALSE) AND NOT coalesce(_c <= n, FALSE)").select(left.columns)
        close = _near(rest, fresh.withColumn("_p", F.col("published_at")).withColumn("_n", F.col("n")), ["_p", "_n"], "inner")
        close = close.where((F.col("_n") <= F.col("n")) & (F.abs(F.unix_micros(F.col("_p").cast("timestamp")) - F.unix_micros(F.col("published_at").cast("timestamp"))) <= hours * 3_600_000_000)).select("n").distinct()
        following, to = staged(rest.join(close, "n", "left_anti").join(fresh.select("n"), "n", "left_anti"), "articles")
        if not keep:
            drop(left, path)
        keep = False
        left, path, last = following, to, at
        if left.isEmpty():
            drop(left, path)
            break
    stored, at = staged(done, "stored")
    return stored, at


def outcomes(articles: DataFrame, hours: int = HOURS) -> DataFrame:
    """articles (n: order of arrival, different for each; id, published_at, domain, url: canonical, content_hash,
    title_hash) with article_id, outcome and reason: the stored article that each one becomes or updates.

    Of the stored ones that arrived before, the one of equal URL goes before that of equal content, that before the
    nearest in time of equal title and domain, of several the smallest id. Times count as they came in. Rows without a
    URL, hash or domain match nothing by it."""
    df, path = staged(_prepared(articles), "articles")  # hashes and URLs are made once
    stored, _ = _rounds(df, path, hours, keep=True)
    by = lambda key, name: stored.where(F.col(key).isNotNull()).select(key, F.col("id").alias(name), F.col("n").alias(f"{name}_n"))
    df = df.join(stored.select("n", F.lit(True).alias("new")), "n", "left").join(by("url", "_u"), "url", "left").join(by("content_hash", "_c"), "content_hash", "left")
    near = _near(df.where("new IS NULL"), stored.select("title_hash", "domain", "day", F.col("published_at").alias("_p"), F.col("n").alias("_n"), F.col("id").alias("_i")), ["_p", "_n", "_i"], "inner")
    gap = F.abs(F.unix_micros(F.col("_p").cast("timestamp")) - F.unix_micros(F.col("published_at").cast("timestamp")))
    near = near.where(F.col("_n") < F.col("n")).withColumn("gap", gap).where(F.col("gap") <= hours * 3_600_000_000).groupBy("n").agg(F.min(F.struct("gap", "_i")).alias("_t"))
    df = df.join(near, "n", "left")
    url, content = F.col("_u_n") < F.col("n"), F.col("_c_n") < F.col("n")
    target = F.when(F.col("new"), F.col("id")).when(url, F.col("_u")).when(content, F.col("_c")).otherwise(F.col("_t._i"))
    reason = F.when(F.col("new"), "").when(url, "canonical_url").when(content, "content_hash").otherwise("title_window")
    return df.select("n", "id", target.alias("article_id"), F.when(F.col("new"), "inserted").otherwise("updated").alias("outcome"), reason.alias("reason"))


def merged(articles: DataFrame, found: DataFrame) -> DataFrame:
    """The stored articles after all updates. articles has besides url the columns given_url, title, body, summary, lang,
    ingested_at and unknown (published_at is only the time of arrival). Texts stay what the first article that had any
    made them; the given URL and ingested_at are the last one's; an unknown time gives way to the first known one."""
    df = articles.join(found.select("n", "article_id"), "n")
    filled = lambda c: F.min_by(c, F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.col("n"))).alias(c)
    known = F.min_by("published_at", F.when(~F.col("unknown"), F.col("n")))
    return df.groupBy("article_id").agg(
        F.count("*").alias("n_articles"), F.max_by("given_url", "n").alias("given_url"), *[filled(c) for c in ("title", "body", "summary", "lang")], F.max_by("ingested_at", "n").alias("ingested_at"),
        F.coalesce(known, F.min_by("published_at", "n")).alias("published_at"), F.min("unknown").alias("unknown"),
    )
