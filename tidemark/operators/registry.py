"""Scans of markets, runs and snapshots, ranks over whole tables, and what is summed up over a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.staged import staged
from .allocation import names

#: Switches of a market's payload that must hold, and what counts where one is missing; stages in order.
SWITCHES = {"active": ("true", True), "closed": ("false", False), "enableOrderBook": ("true", True), "acceptingOrders": ("true", True)}
STAGES = ["forecast", "decision", "trade_plan", "execution", "portfolio", "performance", "risk", "pipeline", "monitoring"]


def eligible_tokens(tokens: DataFrame, markets: DataFrame, most: int | None = None) -> DataFrame:
    """(token_id, condition_id, sort_ts) of tokens (market_id, token_id) whose market (market_id, status, payload,
    updated_ts, created_ts) is active, not closed, has a book and takes orders; of a token's markets the one updated
    last, unknown times last. With `most` the first so many by time, unknown last, then token."""
    said = lambda k, default: F.lower(F.coalesce(F.get_json_object("payload", f"$.{k}"), F.lit(default)))
    open_ = F.lower(F.coalesce("status", F.lit(""))) == "active"
    for k, (default, want) in SWITCHES.items():
        open_ = open_ & ((said(k, default) == "true") if want else (said(k, default) != "true"))
    filled = lambda k: F.nullif(F.get_json_object("payload", f"$.{k}"), F.lit(""))
    m = markets.where(open_).select("market_id", F.coalesce(filled("conditionId"), filled("condition_id"), F.when(F.col("market_id").startswith("0x"), F.col("market_id"))).alias("condition_id"), F.coalesce("updated_ts", "created_ts").alias("sort_ts"))
    best = F.max(F.struct(F.col("sort_ts").isNotNull().alias("known"), "sort_ts", "market_id", "condition_id")).alias("b")
    got = tokens.join(m, "market_id").groupBy("token_id").agg(best).select("token_id", "b.condition_id", "b.sort_ts")
    return got if most is None else got.orderBy(F.desc_nulls_last("sort_ts"), "token_id").limit(most)


def latest_runs(selections: DataFrame, runs: DataFrame, since: Column, until: Column) -> DataFrame:
    """(version, selection_run_id, decision_ts): of each version's selection runs (run_id, version, selection_run_id) in
    the closed window the one decided last, of several the largest id."""
    met = selections.join(runs.where(F.col("decision_ts").between(since, until)).select("run_id", "decision_ts"), "run_id")
    return met.groupBy("version").agg(F.max(F.struct("decision_ts", "selection_run_id")).alias("b")).select("version", "b.selection_run_id", "b.decision_ts")


def selected_tokens(selected: DataFrame, tokens: DataFrame) -> DataFrame:
    """selected (market_id, token_id, ...) with token_id filled by the smallest token of the market where it is null."""
    first = tokens.groupBy("market_id").agg(F.min("token_id").alias("_first"))
    return selected.join(first, "market_id", "left").withColumn("token_id", F.coalesce("token_id", "_first")).drop("_first")


def snapshots_asof(spine: DataFrame, snapshots: DataFrame, bound: Column | None = None) -> DataFrame:
    """spine (market_id, version, t) with the id and features of the market's latest snapshot (market_id, version, id,
    asof_ts, bound_ts, features) of that version up to t, the largest id of several.

    With bound a latest snapshot that was made with later data than that gives nothing: the row then has no features,
    and no older snapshot takes its place."""
    rows = snapshots.where("asof_ts IS NOT NULL").select("market_id", "version", F.col("asof_ts").alias("t"), F.lit(0).alias("side"), F.struct("asof_ts", "id", "bound_ts", "features").alias("s"))
    asked = spine.select("market_id", "version", "t", F.lit(1).alias("side"), F.lit(None).cast(rows.schema["s"].dataType).alias("s"))
    w = Window.partitionBy("market_id", "version").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    got = rows.unionByName(asked).withColumn("s", F.max("s").over(w)).where("side = 1")
    if bound is not None:
        got = got.withColumn("s", F.when(F.coalesce(F.col("s.bound_ts") <= bound, F.lit(True)), F.col("s")))
    return got.select("market_id", "version", "t", F.col("s.id").alias("id"), F.col("s.features").alias("features"))


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place in the given order over the whole table, from 1. The table is sorted by ranges and written;
    a row's place is its number in its range plus the rows of the ranges before, so no task sees more than a range."""
    sorted_, _ = staged(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_m", 33)
    sizes = sorted_.groupBy(part.alias("_p")).agg(F.count("*").alias("n"), F.min("_m").alias("first"))
    shift = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first") + 1
    placed = sizes.select("_p", shift.alias("_s"))
    return sorted_.withColumn("_p", part).join(F.broadcast(placed), "_p").withColumn(name, F.col("_m") + F.col("_s")).drop("_m", "_p", "_s")


def screen_order() -> list[Column]:
    return [F.desc("screen_score"), F.desc("lq"), F.desc("volume"), F.asc("market_id")]


def deep_order() -> list[Column]:
    return [F.desc("deep_score"), F.desc("screen_score"), F.desc("volume"), F.asc("market_id")]


def timeline_order(stage: str = "stage") -> list[Column]:
    """Stages in their order, unknown ones last, then time (unknown first), run and hash."""
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col(stage))
    return [F.when(place > 0, place).otherwise(99).asc(), F.asc_nulls_first("generated_at"), F.asc("run_id"), F.asc("payload_hash")]


def in_window(rows: DataFrame, at: str, since: Column, until: Column) -> DataFrame:
    """Rows of the closed window; those of unknown time stay."""
    return rows.where(F.col(at).isNull() | F.col(at).between(since, until))


def signals(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, flags, warnings: array of (code, message), status, hash) to one row per key: the different flags and
    warnings in order, the worst status (FAIL, WARN, else OK), the hash if all that are known agree, and whether they do
    not. Flags and warnings meet as rows, so equal ones leave before they are gathered."""
    flags = rows.select(key, F.explode(names(F.col("flags"))).alias("f")).distinct().groupBy(key).agg(F.sort_array(F.collect_list("f")).alias("flags"))
    said = rows.select(key, F.explode("warnings").alias("w")).select(key, F.coalesce(F.nullif(F.trim("w.code"), F.lit("")), F.lit("unknown_warning")).alias("code"), F.trim(F.coalesce("w.message", F.lit(""))).alias("message")).distinct()
    said = said.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("code", "message"))).alias("warnings"))
    worst = F.max(F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0))
    one, other = F.min("hash"), F.max("hash")
    base = rows.groupBy(key).agg(F.element_at(F.array(F.lit("OK"), F.lit("WARN"), F.lit("FAIL")), worst + 1).alias("status"), F.when(one == other, one).alias("hash"), F.coalesce(one != other, F.lit(False)).alias("mixed_hash"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return base.join(flags, key, "left").join(said, key, "left").select(key, "status", "hash", "mixed_hash", none("flags", "array<string>"), none("warnings", "array<struct<code:string,message:string>>"))


def kpis(orders: DataFrame, key: str) -> DataFrame:
    """orders (key, notional, status) to planned and executed notional, their share, and counts."""
    done = F.col("status") == "FILLED"
    planned, made = F.sum("notional"), F.coalesce(F.sum(F.when(done, F.col("notional"))), F.lit(0).cast("decimal(28,2)"))
    share = F.when(planned > 0, made.cast("double") / planned.cast("double")).otherwise(0.0)
    return orders.groupBy(key).agg(planned.alias("planned"), made.alias("executed"), share.alias("fill_rate"), F.count("*").alias("n_planned"), F.count_if(done).alias("n_filled"), F.count_if(F.col("status") == "REJECTED").alias("n_rejected"))
