"""URL filters over dated lists: entries become validity intervals, captures meet those active at fetch time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BROADCAST_ROWS = 1_000_000
SALTS = 32


def intervals(entries: DataFrame) -> DataFrame:
    """(key, ts, listed) to (key, since, until): a key is listed from an entry that lists it to the next that does
    not; of entries at one time the delisting one counts. Nulls are ignored."""
    e = entries.dropna(subset=["key", "ts", "listed"]).groupBy("key", "ts").agg(F.min("listed").alias("listed"))
    w = Window.partitionBy("key").orderBy("ts")
    turns = e.withColumn("was", F.lag("listed", 1, False).over(w)).where("listed <> was")
    return turns.withColumn("until", F.lead("ts").over(w)).where("listed").select("key", F.col("ts").alias("since"), "until")


def keys(host):
    """A host and its parent domains of two labels or more."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def host_of(url):
    """The host in lower case, without user info, port and closing dots; a backslash ends it as a slash does."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#\\]*@)?(\[[^\]/?#]*\]|[^/?#:\\]*)", 1)
    return F.rtrim(F.lower(host), F.lit("."))


def apply(captures: DataFrame, entries: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, host, fetch_ts, blocked, listed_by): captures has id_col, url and fetch_ts. A capture is blocked if its host or
    a parent domain is listed at fetch_ts (since inclusive, until exclusive); listed_by is the longest such key.
    Null urls and times are never blocked. Each row of captures gives one row, repeated rows and null ids too; empty
    tables give none, or none blocked; other columns are ignored. A list of up to BROADCAST_ROWS intervals is broadcast; a longer one is
    joined by shuffle, a key's captures being salted so that no host or domain lands in one task."""
    caps = captures.select(F.col(id_col).alias("id"), host_of(F.col("url")).alias("host"), "fetch_ts")
    caps = written(caps.withColumn("row", F.monotonically_increasing_id()), "captures")
    keyed = caps.select("row", "id", "host", "fetch_ts", F.explode(keys(F.col("host"))).alias("key"))
    spans = intervals(entries)
    active = lambda a: (F.col("fetch_ts") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetch_ts") < F.col("until")))
    if spans.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = keyed.join(F.broadcast(spans.withColumnRenamed("key", "k")), (F.col("key") == F.col("k")) & active(0), "left")
    else:
        dealt = spans.withColumnRenamed("key", "k").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        met = keyed.join(dealt, (F.col("key") == F.col("k")) & (F.col("salt") == F.col("t")) & active(0), "left")
    best = met.groupBy("row").agg(F.first("id").alias("id"), F.first("host").alias("host"), F.first("fetch_ts").alias("fetch_ts"), F.max(F.when(F.col("k").isNotNull(), F.struct(F.length("k").alias("n"), F.col("k").alias("k")))).alias("b"))
    return best.select("id", "host", "fetch_ts", F.col("b").isNotNull().alias("blocked"), F.col("b.k").alias("listed_by"))
