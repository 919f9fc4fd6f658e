"""As-of operators: what was known at a decision time, both by event time and by ingestion time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gate(rows: DataFrame, t, epsilon_seconds: int) -> DataFrame:
    """Rows whose event had happened by t and which had been ingested by t + epsilon."""
    return rows.where((F.col("event_ts") <= t) & (F.col("ingested_at") <= t + F.expr(f"INTERVAL {epsilon_seconds} SECONDS")))


def asof_many(spine: DataFrame, sources: dict[str, tuple[DataFrame, str, list[str], int]], key: str, epsilon_seconds: int = 300, split_seconds: int = 30 * 86400) -> DataFrame:
    """spine (key, t) with one struct per source: of its rows (key, event_ts, ingested_at, id, payload) the latest by
    (event_ts, ingested_at, id) of the same key that had happened `back` seconds before t and was ingested by t + epsilon.
    sources names (rows, id column, payload, back).

    Both gates hold from max(event_ts + back, ingested_at - epsilon) on. So all sources and the spine are put together
    and sorted by that time once, and running maxima answer every t: one shuffle for all sources, no pairs. A key is
    split into spans of time; what an earlier span ends with is carried into the next ones by a small table of one row
    per key and span, so a key of very many rows is sorted by many tasks. Rows without key or either time are never
    let through; a spine row without key or time finds none."""
    rows = None
    for name, (table, id_col, payload, back) in sources.items():
        known = table.where(F.col(key).isNotNull() & F.col("event_ts").isNotNull() & F.col("ingested_at").isNotNull())
        seen = F.greatest(F.col("event_ts") + F.expr(f"INTERVAL {back} SECONDS"), F.col("ingested_at") - F.expr(f"INTERVAL {epsilon_seconds} SECONDS"))
        part = known.select(F.col(key), seen.alias("_x"), F.lit(0).alias("_side"), F.struct("event_ts", "ingested_at", id_col, *payload).alias(name))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    both = rows.unionByName(spine.select(F.col(key), F.col("t").alias("_x"), F.lit(1).alias("_side")), allowMissingColumns=True)
    both = both.withColumn("_b", F.floor(F.unix_seconds(F.col("_x").cast("timestamp")) / split_seconds)).repartition(key, "_b")
    w = Window.partitionBy(key, "_b").orderBy("_x", "_side").rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumns({n: F.max(n).over(w) for n in sources}).where("_side = 1")
    # The condition always holds. It names the other columns, so that both readers of the shuffle read the same one.
    ends = both.groupBy(key, "_b").agg(*[F.max(n).alias(n) for n in sources], F.max("_x").alias("_x"), F.max("_side").alias("_side")).where("_side >= 0 OR _x IS NULL")
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, "_b", *[F.max(n).over(before).alias(f"_{n}") for n in sources])
    return here.join(carried, [key, "_b"], "left").select(key, F.col("_x").alias("t"), *[F.greatest(n, f"_{n}").alias(n) for n in sources])


def asof_join(spine: DataFrame, rows: DataFrame, key: str, id_col: str, payload: list[str], epsilon_seconds: int = 300) -> DataFrame:
    """spine (key, t) with the latest row of its key by (event_ts, ingested_at, id) that the gate lets through; see
    asof_many()."""
    best = asof_many(spine, {"_row": (rows, id_col, payload, 0)}, key, epsilon_seconds)
    return best.select(key, "t", F.col("_row.event_ts").alias("event_ts"), F.col(f"_row.{id_col}").alias(id_col), *[F.col(f"_row.{c}").alias(c) for c in payload])


def latest(rows: DataFrame, key: str, id_col: str, payload: list[str]) -> DataFrame:
    """The latest row per key, as an aggregation with map-side combine instead of a window."""
    best = rows.groupBy(key).agg(F.max(F.struct("event_ts", "ingested_at", id_col, *payload)).alias("r"))
    return best.select(key, "r.event_ts", f"r.{id_col}", *[f"r.{c}" for c in payload])


def candles(rows: DataFrame, key: str, id_col: str, width: str) -> DataFrame:
    """Open, high, low, close and volume per key and tumbling interval."""
    at = F.date_trunc(width, "event_ts").alias("start_ts")
    o, c = F.min(F.struct("event_ts", id_col, "price")), F.max(F.struct("event_ts", id_col, "price"))
    g = rows.groupBy(key, at).agg(o.alias("o"), F.max("price").alias("high"), F.min("price").alias("low"), c.alias("c"), F.sum("size").alias("volume"))
    return g.select(key, "start_ts", F.col("o.price").alias("open"), "high", "low", F.col("c.price").alias("close"), "volume")


def realized_volatility(closes: DataFrame, key: str) -> DataFrame:
    """Population deviation of consecutive log returns of positive closes; null for fewer than two returns."""
    w = Window.partitionBy(key).orderBy("start_ts")
    r = closes.where("close > 0").withColumn("r", F.log(F.col("close") / F.lag("close").over(w)))
    return r.groupBy(key).agg(F.when(F.count("r") >= 2, F.stddev_pop("r")).alias("volatility"))


def dataset(spine: DataFrame, books: DataFrame, trades: DataFrame, outcomes: DataFrame, key: str, epsilon_seconds: int = 300, snapshots: DataFrame | None = None) -> DataFrame:
    """spine (key, t) with price_prob, y and status. books (key, book_id, times, prob) and trades (key, trade_id, times,
    price): the probability is that of the latest book, or where this gives none within 0 to 1 the latest trade's, never
    that of an older book. outcomes (key, resolved_ts, y), one row per key at most. Status: no_outcome, resolved (t is
    not before the resolution), missing_features, missing_price or ok, the first that holds.

    snapshots (key, snapshot_id, asof_ts, bound_ts, features) adds the features of the latest one up to t, in the same
    shuffle; without it there are none and none are missing. A latest snapshot that was made with data of after
    t + epsilon gives nothing, and no older one takes its place."""
    sources = {"book": (books, "book_id", ["prob"], 0), "trade": (trades, "trade_id", ["price"], 0)}
    if snapshots is not None:
        made = snapshots.select(key, F.col("asof_ts").alias("event_ts"), F.col("asof_ts").alias("ingested_at"), "snapshot_id", "bound_ts", "features")
        sources["snapshot"] = (made, "snapshot_id", ["bound_ts", "features"], 0)
    known = asof_many(spine, sources, key, epsilon_seconds)
    features = []
    if snapshots is not None:
        late = F.col("snapshot.bound_ts") > F.col("t") + F.expr(f"INTERVAL {epsilon_seconds} SECONDS")
        features = [F.when(~F.coalesce(late, F.lit(False)), F.col("snapshot.features")).alias("features")]
    known = known.select(key, "t", F.col("book.prob").alias("prob"), F.col("trade.price").alias("price"), *features)
    valid = lambda c: F.when(F.col(c).between(0, 1), F.col(c))
    df = known.join(outcomes, key, "left").withColumn("price_prob", F.coalesce(valid("prob"), valid("price")))
    no = F.col("resolved_ts").isNull() | F.col("y").isNull()
    status = F.when(no, "no_outcome").when(F.col("t") >= F.col("resolved_ts"), "resolved")
    if features:
        status = status.when(F.col("features").isNull(), "missing_features")
    status = status.when(F.col("price_prob").isNull(), "missing_price").otherwise("ok")
    return df.select(key, "t", "price_prob", "y", status.alias("status"), *(["features"] if features else []))
