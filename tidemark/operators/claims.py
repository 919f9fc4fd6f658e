"""Claims of a market clustered by their leaders, and the canonical claims and sources of the clusters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalized_claim(text: Column) -> Column:
    """Lower case, anything but a-z, 0-9 and white space as blanks, single blanks; null is empty."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9\\s]", " ")
    return F.trim(F.regexp_replace(t, "\\s+", " "))


def fingerprint(text: Column) -> Column:
    return F.sha2(normalized_claim(text), 256)


def claim_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalized_claim(text), " "), lambda w: w != ""))


def clusters(claims: DataFrame, threshold: float = 0.5) -> DataFrame:
    """claims (market_id, claim_id, text, published_at, domain) to (market_id, cluster_id, claim_ids, representative_id,
    representative_text).

    In the order of publication (unknown last), domain and id each claim joins the first cluster whose representative
    shares enough of its words (Jaccard), or begins one; a shorter text, then a smaller id, takes over as representative.
    Two texts without words are alike. The order matters, so a market is one fold over its sorted claims, whose state is
    its clusters, in Arrow batches of markets; sets too different in size are not compared. A market's payload is bounded,
    markets are dealt out."""
    item = F.struct(F.col("published_at").isNull().alias("late"), F.col("published_at").alias("published_at"), F.coalesce("domain", F.lit("")).alias("domain"), F.col("claim_id").alias("claim_id"), F.coalesce("text", F.lit("")).alias("text"), normalized_claim(F.col("text")).alias("plain"))
    per = claims.where("market_id IS NOT NULL AND claim_id IS NOT NULL").groupBy("market_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    kind = claims.schema["claim_id"].dataType.simpleString()
    made = per.select("market_id", "items.claim_id", "items.text", "items.plain").mapInArrow(_folded(threshold), f"market_id {claims.schema['market_id'].dataType.simpleString()}, cluster_id int, claim_ids array<{kind}>, representative_id {kind}, representative_text string")
    return made.withColumn("claim_ids", F.sort_array("claim_ids"))


def _folded(threshold: float):
    """The fold over markets and their sorted claims. A set of words is one number with a bit for each word of the
    market, so that two sets are compared by counting bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            ids, texts, plain = (b.column(i).flatten().to_pylist() for i in (1, 2, 3))
            end = 0
            for market, size in zip(b.column(0).to_pylist(), b.column(1).value_lengths().to_pylist(), strict=True):
                start, end = end, end + size
                bit: dict[str, int] = {}
                made: list[list] = []  # id, text, words as a number, how many, claims
                for key, text, line in zip(ids[start:end], texts[start:end], plain[start:end], strict=True):
                    words = 0
                    for w in line.split(" ") if line else ():
                        words |= 1 << bit.setdefault(w, len(bit))
                    m = words.bit_count()
                    for c in made:
                        n = c[3]
                        if min(n, m) >= threshold * max(n, m):
                            both = (c[2] & words).bit_count()
                            if both >= threshold * (n + m - both):
                                c[4].append(key)
                                if (len(text), key) < (len(c[1]), c[0]):
                                    c[:4] = key, text, words, m
                                break
                    else:
                        made.append([key, text, words, m, [key]])
                for i, c in enumerate(made):
                    for column, value in zip(out, (market, i + 1, c[4], c[0], c[1]), strict=True):
                        column.append(value)
            kind = b.schema.field(1).type.value_type
            kinds = [b.schema.field(0).type, pa.int32(), pa.list_(kind), kind, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], ["market_id", "cluster_id", "claim_ids", "representative_id", "representative_text"])

    return run


def canonical(made: DataFrame, most: int = 25) -> DataFrame:
    """clusters() with claim_hash and kept: the first `most` clusters of a market stay, the claims of others are dropped."""
    return made.withColumn("claim_hash", fingerprint(F.col("representative_text"))).withColumn("kept", F.col("cluster_id") <= most)


def canonical_sources(made: DataFrame, sources: DataFrame, most_primary: int = 10) -> DataFrame:
    """sources (market_id, claim_id, url, domain, source_type, published_at) of each cluster: of equal url, domain and
    type the earliest with a known time, at most so many primary ones, first by domain, url and time; the others all."""
    member = made.select("market_id", "cluster_id", F.explode("claim_ids").alias("claim_id"))
    own = sources.join(member, ["market_id", "claim_id"]).groupBy("market_id", "cluster_id", "domain", "url", "source_type").agg(F.min("published_at").alias("published_at"))
    w = Window.partitionBy("market_id", "cluster_id", "source_type").orderBy("domain", "url", F.col("published_at").asc_nulls_first())
    return own.withColumn("place", F.row_number().over(w)).where((F.col("source_type") != "primary") | (F.col("place") <= most_primary))


def echo(sources: DataFrame) -> DataFrame:
    """canonical_sources() to per cluster domains, primary domains, diversity (domains to sources) and echo penalty (how
    far the largest domain's share lies above an equal one)."""
    keys = ["market_id", "cluster_id"]
    per = sources.groupBy(*keys, "domain").agg(F.count("*").alias("c"), F.max((F.col("source_type") == "primary").cast("int")).alias("p"))
    named = F.coalesce(F.col("domain"), F.lit("")) != ""
    g = per.groupBy(*keys).agg(F.sum("c").alias("n"), F.count(F.when(named, 1)).alias("unique_domains"), F.sum(F.when(named, F.col("p")).otherwise(0)).alias("primary_domains"), F.max(F.when(named, F.col("c"))).alias("largest"))
    equal = 1.0 / F.col("unique_domains")
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    penalty = F.when(F.col("n") <= 1, 0.0).when(F.col("unique_domains") <= 1, 1.0).otherwise(clamp((F.col("largest") / F.col("n") - equal) / (1.0 - equal)))
    return g.select(*keys, "unique_domains", "primary_domains", clamp(F.col("unique_domains") / F.col("n")).alias("diversity"), penalty.alias("penalty"))
