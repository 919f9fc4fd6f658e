"""What the selections of different selectors were worth, and the selections that they are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.staged import staged
from . import scoring, selector
from .allocation import quotas

MEASURES = ("entropy", "price")


def seed(decision_ts: Column, config_hash: Column) -> Column:
    """A seed that depends on the decision time and the configuration only."""
    return F.substring(F.sha2(F.concat_ws("|", F.date_format(decision_ts, "yyyy-MM-dd'T'HH:mm:ss"), config_hash), 256), 1, 16)


def top_volume(rows: DataFrame, k: int) -> DataFrame:
    """rows (run, market_id, volume, screen_score) with rank: the k of each run that were traded most, of equal ones
    those of the higher score, then by market. The bound on the rank is applied before the shuffle as well."""
    w = Window.partitionBy("run").orderBy(F.desc("volume"), F.desc("screen_score"), "market_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def stratified(rows: DataFrame, k: int, seed: Column) -> DataFrame:
    """(run, market_id, bucket, category): k markets of each run, dealt to its strata (bucket, category) by largest
    remainder of their sizes and drawn within one by a hash of seed and market, so that the same seed draws the same
    markets however the rows are dealt out. A market of several rows counts once, under the smallest stratum; a null
    bucket or category is a stratum of its own name "unknown". Rows without market take no part.

    A stratum is never gathered: its size is an aggregate, and no task hands on more than k of its rows. A run of at
    most k markets is taken whole."""
    named = lambda c: F.coalesce(F.col(c), F.lit("unknown")).alias(c)
    least = F.min(F.struct(named("bucket"), named("category"), seed.alias("seed"))).alias("s")
    rows = rows.where("market_id IS NOT NULL").groupBy("run", "market_id").agg(least).select("run", "market_id", "s.*")
    places = rows.groupBy("run", "bucket", "category").agg(F.count("*").alias("weight"))
    places = quotas(places.select("run", F.struct("bucket", "category").alias("bucket"), "weight"), k).select("run", "bucket.*", "quota")
    drawn = F.sha2(F.concat_ws("|", "seed", F.col("market_id").cast("string")), 256)
    w = Window.partitionBy("run", "bucket", "category").orderBy("drawn", "market_id")
    first = rows.withColumn("drawn", drawn).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return first.join(places, ["run", "bucket", "category"]).where("place <= quota").select("run", "market_id", "bucket", "category")


def grid(decision_ts: Column, window_hours: int, step_hours: int = 4) -> Column:
    """The decision times of a window, from its start on, the last one included if a step meets it."""
    return F.sequence(decision_ts - F.expr(f"INTERVAL {window_hours} HOURS"), decision_ts, F.expr(f"INTERVAL {step_hours} HOURS"))


def digest(*cols: str) -> Column:
    """A fingerprint of a group's rows that does not depend on their order, as an aggregate: 52 bits of each row's MD5
    summed exactly. Equal rows count."""
    return F.coalesce(F.sum(F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])), 1, 13), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def evaluate(versions: DataFrame, latest: DataFrame, selected: DataFrame, examples: DataFrame) -> DataFrame:
    """One row per asked version: status (ok, missing_selection without a run, empty_selection without tokens), run and
    its time, numbers of tokens, examples and skips by reason, Brier score and calibration error of the price (a) and of
    the model (b), mean, p50, p90, least and largest of the price and of its entropy in bits, rows per bucket of time to
    resolution as a map, and digests of tokens and examples. Numbers are 0 where there are no examples.

    versions (version), latest (version, selection_run_id, decision_ts), selected (selection_run_id, token_id, ttr),
    examples (token_id, t, price_prob, y, p_b, status) of the tokens of all versions: a token that several versions
    selected is looked up once. Repeated selections of a token count once, but for the buckets; rows without token take
    no part. What is measured is written once, and every figure is an aggregate over it."""
    asked = versions.select("version").distinct().join(latest, "version", "left")
    members = asked.join(selected.where("token_id IS NOT NULL"), "selection_run_id").select("version", "token_id", F.coalesce("ttr", F.lit("unknown")).alias("ttr"))
    met, _ = staged(members.select("version", "token_id").distinct().join(examples, "token_id"), "evaluated")
    tokens = members.select("version", "token_id").distinct().groupBy("version").agg(F.count("*").alias("n_tokens"), digest("token_id").alias("tokens_digest"))
    buckets = members.groupBy("version", "ttr").agg(F.count("*").alias("n")).groupBy("version").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("ttr", "n")))).alias("ttr_buckets"))
    ok = met.where("status = 'ok'")
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    counts = met.groupBy("version").agg(n("ok").alias("n_examples"), n("no_outcome", "resolved").alias("skipped_no_outcome"), n("missing_features").alias("skipped_missing_features"), n("missing_price").alias("skipped_missing_price"))
    rows = ok.withColumn("price", F.round("price_prob", 8))
    hashed = rows.groupBy("version").agg(digest("token_id", "t", "y").alias("examples_digest"))
    scored = rows.select(F.col("version"), "y", F.explode(F.array(F.struct(F.lit("a").alias("model"), F.col("price_prob").alias("p")), F.struct(F.lit("b").alias("model"), F.col("p_b").alias("p")))).alias("m"))
    scored = scoring.report(scored.select(F.struct("version", "m.model").alias("k"), "y", "m.p"), "k").where("NOT overall")
    pick = lambda key, name, c: F.max(F.when(F.col("k").getField(key) == name, F.col(c)))
    scored = scored.groupBy(F.col("k.version").alias("version")).agg(*[pick("model", m, c).alias(f"{c}_{m}") for c in ("brier", "ece") for m in ("a", "b")])
    values = F.array(F.struct(F.lit("entropy").alias("measure"), F.round(selector.entropy(F.col("price_prob")), 6).alias("v")), F.struct(F.lit("price").alias("measure"), F.col("price").alias("v")))
    spread = scoring.summary(rows.select("version", F.explode(values).alias("x")).select(F.struct("version", "x.measure").alias("k"), "x.v"), "k", "v")
    figures = ("mean", "p50", "p90", "least", "largest")
    spread = spread.groupBy(F.col("k.version").alias("version")).agg(*[pick("measure", m, c).alias(f"{m}_{c}") for m in MEASURES for c in figures])
    out = asked
    for part in (tokens, buckets, counts, hashed, scored, spread):
        out = out.join(part, "version", "left")
    status = F.when(F.col("selection_run_id").isNull(), "missing_selection").when(F.col("n_tokens").isNull(), "empty_selection").otherwise("ok")
    zeros = [c for c in out.columns if c not in ("version", "selection_run_id", "decision_ts", "ttr_buckets")]
    return out.withColumn("status", status).na.fill(0, zeros).withColumn("ttr_buckets", F.coalesce("ttr_buckets", F.create_map().cast("map<string,bigint>")))
