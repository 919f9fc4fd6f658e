"""Decisions, diversified selection, capped allocation and risk verdicts, per run.

Each allocation is an order in which later rows depend on what earlier ones took: a fold over the run's sorted rows with
totals per market and category as its state. A task holds one run's rows at a time; runs are bounded by the candidate
budget, and different runs are folded in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Flags that forbid a trade, flags of a cooldown, buckets of time to resolution and their target shares.
BLOCKING = [
    "conformal_degenerate_intervals",
    "conformal_invalid_intervals",
    "illiquid",
    "insufficient_calibration_data",
    "insufficient_data",
    "insufficient_uncertainty_data",
    "poor_calibration",
    "stale",
]
COOLDOWN = ["critical_drawdown", "critical_liquidity", "critical_loss"]
BUCKETS = ["0_24h", "1_7d", "7_30d", "30d_plus", "unknown"]
MIX = {"0_24h": 0.25, "1_7d": 0.35, "7_30d": 0.25, "30d_plus": 0.10, "unknown": 0.05}
MONEY = "DECIMAL(28,2)"


def names(c: Column) -> Column:
    """A list of strings trimmed, without empty ones, sorted and each once; null gives an empty list."""
    return F.sort_array(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")))


def decisions(rows: DataFrame, min_edge_bps: float = 50.0, robust: bool = False, global_flags: list[str] | None = None, most: int | None = None) -> DataFrame:
    """rows (run, market_id, token_id, price_prob, p_cal, low_90, high_90, flags) with edge, edge_bps, edge_low_90,
    edge_high_90, quality_flags, action, reasons and rank. A blocking flag forbids the trade; else the edge decides, and
    with robust its 90 per cent interval must lie on the same side of 0. Trades rank first, by size of the edge, then
    the others by market and token; the first `most` of a run stay."""
    flags = names(F.concat(F.coalesce("flags", F.array().cast("array<string>")), F.array(*map(F.lit, global_flags or [])).cast("array<string>")))
    edge = F.col("p_cal") - F.col("price_prob")
    df = rows.withColumns({"quality_flags": flags, "edge": edge, "edge_bps": edge * 10000.0, "edge_low_90": F.col("low_90") - F.col("price_prob"), "edge_high_90": F.col("high_90") - F.col("price_prob")})
    blocked = F.transform(F.filter("quality_flags", lambda x: x.isin(BLOCKING)), lambda x: F.concat(F.lit("flag:"), x))
    up, down = F.col("edge_bps") >= min_edge_bps, F.col("edge_bps") <= -min_edge_bps
    fits_up, fits_down = (F.col("edge_low_90") > 0, F.col("edge_high_90") < 0) if robust else (F.lit(True), F.lit(True))
    action = F.when(F.size("_b") > 0, "NO_TRADE").when(up & fits_up, "BUY_YES").when(down & fits_down, "BUY_NO").otherwise("NO_TRADE")
    df = df.withColumn("_b", blocked).withColumn("action", action)
    why = F.when(F.size("_b") > 0, F.col("_b")).when(up | down, F.array(F.lit("robust_check_failed"))).otherwise(F.array(F.lit("edge_below_threshold")))
    df = df.withColumn("reasons", F.when(F.col("action") == "NO_TRADE", why).otherwise(F.array().cast("array<string>"))).drop("_b")
    trade = F.col("action") != "NO_TRADE"
    w = Window.partitionBy("run").orderBy(F.desc(trade), F.when(trade, -F.abs("edge_bps")), "market_id", "token_id")
    df = df.withColumn("rank", F.row_number().over(w))
    return df if most is None else df.where(F.col("rank") <= most)


def quotas(mix: DataFrame, k: int) -> DataFrame:
    """mix (run, bucket, weight) with quota: k places dealt by largest remainder, equal remainders by the bucket's name.
    Negative weights count as 0, all 0 as equal ones. Windows of a run's buckets only."""
    run = Window.partitionBy("run")
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    df = mix.withColumn("_w", weight).withColumn("_all", F.sum("_w").over(run)).withColumn("_n", F.count("*").over(run))
    df = df.withColumn("_raw", F.when(F.col("_all") > 0, F.col("_w") / F.col("_all")).otherwise(1.0 / F.col("_n")) * k).withColumn("quota", F.floor("_raw"))
    place = F.row_number().over(run.orderBy(F.desc(F.col("_raw") - F.col("quota")), "bucket"))
    df = df.withColumn("_place", place).withColumn("_left", k - F.sum("quota").over(run))
    return df.select("run", "bucket", (F.col("quota") + (F.col("_place") <= F.col("_left")).cast("long")).alias("quota"))


def _bump(totals: str, key: str, by: str, kind: str) -> str:
    """totals with `by` added under key."""
    return f"map_concat(map_filter({totals}, (k, v) -> k <> {key}), map({key}, CAST(coalesce(try_element_at({totals}, {key}), 0) + {by} AS {kind})))"


def _at(totals: str, key: str) -> str:
    return f"coalesce(try_element_at({totals}, {key}), 0)"


def diversified(rows: DataFrame, k: int = 200, mix: dict[str, float] | None = None, max_per_category: int = 45, max_per_group: int = 20) -> DataFrame:
    """rows (run, market_id, category, group_id, ttr, screen_score, lq, volume) that are selected, with their rank.

    First each bucket of time to resolution fills its quota with its best rows, then the best of what is left fill the
    k places; a market is taken once, and no category or group more often than allowed. An unknown or empty bucket,
    category or group is 'unknown'. The two passes are one fold over the rows sorted by bucket, then by rank."""
    w = Window.partitionBy("run").orderBy(F.desc("screen_score"), F.desc("lq"), F.desc("volume"), "market_id")
    text = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "unknown").otherwise(F.col(c))
    ttr = F.trim(F.coalesce("ttr", F.lit("")))
    bucket = F.coalesce(F.when(ttr.isin(BUCKETS), ttr), F.lit("unknown"))
    ranked = rows.withColumn("_place", F.row_number().over(w))
    item = F.struct(F.col("_place").alias("place"), F.col("market_id").cast("string").alias("market_id"), text("category").alias("category"), text("group_id").alias("group_id"), bucket.alias("bucket"))
    runs = ranked.groupBy("run").agg(F.sort_array(F.collect_list(item)).alias("items"))
    wanted = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(float((mix or MIX).get(b, 0.0))).alias("weight")) for b in BUCKETS])
    per = quotas(runs.select("run", F.inline(wanted)), k).groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "quota"))).alias("quota"))
    order = F.array(*map(F.lit, BUCKETS))
    first = F.sort_array(F.transform("items", lambda x: F.struct(F.array_position(order, x["bucket"]).alias("pass"), *[x[c].alias(c) for c in ("place", "market_id", "category", "group_id", "bucket")])))
    then = F.transform("items", lambda x: F.struct(F.lit(99).cast("long").alias("pass"), *[x[c].alias(c) for c in ("place", "market_id", "category", "group_id", "bucket")]))
    free = f"""size(s.used) < {k} AND NOT array_contains(s.used, x.market_id) AND (x.pass = 99 OR {_at("s.buckets", "x.bucket")} < quota[x.bucket])
      AND {_at("s.categories", "x.category")} < {max_per_category} AND {_at("s.groups", "x.group_id")} < {max_per_group}"""
    none = "map_filter(map('', 0), (k, v) -> FALSE)"
    fold = f"""aggregate(steps, named_struct('used', CAST(array() AS ARRAY<STRING>), 'places', CAST(array() AS ARRAY<INT>), 'categories', {none}, 'groups', {none}, 'buckets', {none}),
      (s, x) -> IF({free}, named_struct('used', array_append(s.used, x.market_id), 'places', array_append(s.places, x.place), 'categories', {_bump("s.categories", "x.category", "1", "INT")},
        'groups', {_bump("s.groups", "x.group_id", "1", "INT")}, 'buckets', {_bump("s.buckets", "x.bucket", "1", "INT")}), s), s -> array_sort(s.places))"""
    chosen = runs.join(per, "run").withColumn("steps", F.concat(first, then)).select("run", F.posexplode(F.expr(fold)).alias("rank", "_place"))
    return ranked.join(chosen.withColumn("rank", F.col("rank") + 1), ["run", "_place"]).drop("_place")


def trade_plan(rows: DataFrame, max_orders: int = 200, max_total: float = 5000, max_market: float = 500, max_category: float = 2000, fixed: float | None = 25, base: float = 25, target_bps: float = 100, scales: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """Decided rows (run, market_id, token_id, category, action, reasons, quality_flags, price_prob, edge_bps) with
    notional, side, price, quantity, rank and reason: rank among the orders of a run, or why the row is skipped.

    Rows are taken by size of the edge. One that would pass a cap is skipped, and later smaller ones may still fit.
    Without a fixed notional it grows with the edge within the scales. Money is decimal with two places."""
    first = lambda c: F.get(c, F.lit(0))
    block = F.filter(names(F.col("quality_flags")), lambda x: x.isin(BLOCKING))
    no = F.when(F.size("reasons") > 0, F.concat(F.lit("decision_no_trade:"), first("reasons"))).otherwise("decision_no_trade")
    if fixed is None:
        notional = F.lit(base) * F.least(F.lit(scales[1]), F.greatest(F.lit(scales[0]), F.abs("edge_bps") / target_bps))
    else:
        notional = F.lit(float(fixed))
    side = F.when(F.col("edge_bps") > 0, "BUY_YES").when(F.col("edge_bps") < 0, "BUY_NO")
    price = F.when(F.col("side") == "BUY_YES", F.col("price_prob")).otherwise(1.0 - F.col("price_prob"))
    df = rows.withColumn("notional", F.round(notional, 2).cast(MONEY)).withColumn("side", side).withColumn("price", F.round(price, 8))
    df = df.withColumn("quantity", F.when(F.col("price") > 0, F.round(F.col("notional").cast("double") / F.col("price"), 2).cast(MONEY)))
    pre = F.when(F.col("action") == "NO_TRADE", no).when(~F.col("action").isin("TRADE", "BUY_YES", "BUY_NO"), "invalid_decision_action").when(F.size(block) > 0, F.concat(F.lit("blocked_by_quality_flag:"), first(block))).when(F.col("notional") <= 0, "invalid_notional")
    post = F.when(F.col("side").isNull(), "zero_edge").when(F.col("price") <= 0, "invalid_price").when(F.col("quantity") <= 0, "invalid_quantity")
    w = Window.partitionBy("run").orderBy(F.desc(F.abs("edge_bps")), "market_id", "token_id")
    df = df.withColumn("_place", F.row_number().over(w))
    item = F.struct(F.col("_place").alias("place"), F.col("market_id").cast("string").alias("market_id"), F.col("category").cast("string").alias("category"), "notional", pre.alias("pre"), post.alias("post"))
    runs = df.groupBy("run").agg(F.sort_array(F.collect_list(item)).alias("items"))
    money = lambda x: f"CAST({x} AS {MONEY})"
    reason = f"""CASE WHEN x.pre IS NOT NULL THEN x.pre WHEN s.n >= {max_orders} THEN 'cap_exceeded:max_orders' WHEN s.total + x.notional > {money(max_total)} THEN 'cap_exceeded:max_total_notional_usd'
      WHEN {_at("s.markets", "x.market_id")} + x.notional > {money(max_market)} THEN 'cap_exceeded:max_notional_per_market_usd'
      WHEN x.category IS NOT NULL AND {_at("s.categories", "x.category")} + x.notional > {money(max_category)} THEN 'cap_exceeded:max_notional_per_category_usd' ELSE x.post END"""
    none = f"map_filter(map('', {money(0)}), (k, v) -> FALSE)"
    fold = f"""aggregate(items, named_struct('n', 0, 'total', {money(0)}, 'markets', {none}, 'categories', {none}, 'out', CAST(array() AS ARRAY<STRUCT<place: INT, reason: STRING, rank: INT>>)),
      (s, x) -> element_at(transform(array({reason}), why -> IF(why IS NOT NULL,
        named_struct('n', s.n, 'total', s.total, 'markets', s.markets, 'categories', s.categories, 'out', array_append(s.out, named_struct('place', x.place, 'reason', why, 'rank', CAST(NULL AS INT)))),
        named_struct('n', s.n + 1, 'total', {money("s.total + x.notional")}, 'markets', {_bump("s.markets", "x.market_id", "x.notional", MONEY)},
          'categories', IF(x.category IS NULL, s.categories, {_bump("s.categories", "coalesce(x.category, '')", "x.notional", MONEY)}),
          'out', array_append(s.out, named_struct('place', x.place, 'reason', CAST(NULL AS STRING), 'rank', s.n + 1))))), 1), s -> s.out)"""
    got = runs.select("run", F.explode(F.expr(fold)).alias("o")).select("run", F.col("o.place").alias("_place"), F.col("o.reason").alias("reason"), F.col("o.rank").alias("rank"))
    return df.drop("rank").join(got, ["run", "_place"]).drop("_place")


def risk(orders: DataFrame, hooks: DataFrame, cooldowns: DataFrame, max_total: float = 5000, max_market: float = 500, max_category: float = 2000, top1: float = 0.5, top3: float = 0.8, downsize: bool = True, least: float = 5) -> DataFrame:
    """orders (run, rank, market_id, token_id, category, notional, quality_flags) with verdict (ALLOW, DOWNSIZE, BLOCK),
    approved and reasons.

    hooks has per run what is held already: (run, total, markets: map, categories: map, guards: reasons that hold for
    every order of the run); a run without it holds nothing. cooldowns (kind: token or market, id, flag) block the
    tokens and markets they name. An order takes what every cap leaves, if that is at least `least`; an order that would
    make the largest or the three largest markets too great a share of all is blocked."""
    flag = lambda c, bad: F.filter(names(c), lambda x: x.isin(bad) | x.startswith("critical_"))
    cold = cooldowns.groupBy("kind", "id").agg(F.collect_set("flag").alias("f"))
    for kind in ("token", "market"):
        mine = cold.where(F.col("kind") == kind).select(F.col("id").alias(f"{kind}_id"), F.col("f").alias(f"_{kind}"))
        orders = orders.join(mine, f"{kind}_id", "left")
    named = lambda p, c, bad: F.transform(flag(c, bad), lambda x: F.concat(F.lit(p), x))
    own = F.concat(named("blocked_by_quality_flag:", F.col("quality_flags"), BLOCKING), named("cooldown_active:token:", F.col("_token"), COOLDOWN), named("cooldown_active:market:", F.col("_market"), COOLDOWN))
    df = orders.withColumn("_own", own).drop("_token", "_market").withColumn("notional", F.round(F.col("notional").cast("decimal(38,10)"), 2).cast(MONEY))
    w = Window.partitionBy("run").orderBy("rank", "market_id", "token_id")
    df = df.withColumn("_place", F.row_number().over(w))
    item = F.struct(F.col("_place").alias("place"), F.col("market_id").cast("string").alias("market_id"), F.col("category").cast("string").alias("category"), "notional", F.col("_own").alias("own"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{MONEY}>"))
    money = lambda x: f"CAST({x} AS {MONEY})"
    held = hooks.select("run", F.col("total").cast(MONEY).alias("total"), F.col("markets").cast(f"map<string,{MONEY}>").alias("markets"), F.col("categories").cast(f"map<string,{MONEY}>").alias("categories"), "guards")
    runs = df.groupBy("run").agg(F.sort_array(F.collect_list(item)).alias("items")).join(held, "run", "left")
    runs = runs.withColumns({"total": F.coalesce("total", F.expr(money(0))), "markets": F.coalesce("markets", none), "categories": F.coalesce("categories", none), "guards": names(F.col("guards"))})
    caps = [("cap_exceeded:max_total_notional_usd", f"{money(max_total)} - s.total"), ("cap_exceeded:max_notional_per_market_usd", f"{money(max_market)} - {_at('s.markets', 'x.market_id')}"),
            ("cap_exceeded:max_notional_per_category_usd", f"IF(x.category IS NULL, x.notional, {money(max_category)} - {_at('s.categories', 'coalesce(x.category, chr(0))')})")]
    # Step 1 binds what each cap leaves, step 2 the allowed amount and the caps that are used up or bind, step 3 the verdict.
    left = "named_struct('t', {}, 'm', {}, 'c', {})".format(*(money(e) for _, e in caps))
    binding = f"""IF(least(l.t, l.m, l.c) < l.t, array('{caps[1][0]}'), IF(x.category IS NOT NULL AND least(l.t, l.m, l.c) < l.m, array('{caps[2][0]}'), IF(least(l.t, l.m, l.c) < l.c, array('{caps[0][0]}'), CAST(array() AS ARRAY<STRING>))))"""
    spent = f"array_compact(array(IF(l.t <= 0, '{caps[0][0]}', NULL), IF(l.m <= 0, '{caps[1][0]}', NULL), IF(x.category IS NOT NULL AND l.c <= 0, '{caps[2][0]}', NULL)))"
    allowed = f"transform(array({left}), l -> named_struct('a', least(x.notional, l.t, l.m, l.c), 'why', IF(size({spent}) > 0, {spent}, {binding})))"
    shares = f"reverse(array_sort(filter(map_values({_bump('s.markets', 'x.market_id', 'a.a', MONEY)}), v -> v > 0)))"
    part = lambda n: f"CAST(aggregate(slice({shares}, 1, {n}), {money(0)}, (p, q) -> {money('p + q')}) AS DOUBLE) / CAST(s.total + a.a AS DOUBLE)"
    verdict = lambda v, amount, why: f"named_struct('verdict', '{v}', 'approved', {money(amount)}, 'why', {why})"
    full = "IF(size(a.why) > 0, a.why, array('cap_exceeded:unknown'))"
    judged = f"""CASE WHEN size(guards) > 0 OR size(x.own) > 0 THEN {verdict("BLOCK", 0, "array_sort(array_distinct(concat(guards, x.own)))")}
      WHEN x.notional <= 0 THEN {verdict("BLOCK", 0, "array('invalid_notional')")} WHEN a.a <= 0 THEN {verdict("BLOCK", 0, full)}
      WHEN s.total + a.a > 0 AND {part(1)} > {top1}D THEN {verdict("BLOCK", 0, "array('concentration_cap:top1')")} WHEN s.total + a.a > 0 AND {part(3)} > {top3}D THEN {verdict("BLOCK", 0, "array('concentration_cap:top3')")}
      WHEN a.a >= x.notional THEN {verdict("ALLOW", "x.notional", "CAST(array() AS ARRAY<STRING>)")}
      WHEN {str(downsize).upper()} AND a.a >= {money(least)} THEN {verdict("DOWNSIZE", "a.a", "array(replace(coalesce(get(a.why, 0), 'downsized_by_cap:unknown'), 'cap_exceeded', 'downsized_by_cap'))")}
      ELSE {verdict("BLOCK", 0, full)} END"""
    step = f"""element_at(transform(transform({allowed}, a -> {judged}), v -> named_struct('total', {money("s.total + v.approved")}, 'markets', IF(v.approved > 0, {_bump("s.markets", "x.market_id", "v.approved", MONEY)}, s.markets),
      'categories', IF(v.approved > 0 AND x.category IS NOT NULL, {_bump("s.categories", "coalesce(x.category, chr(0))", "v.approved", MONEY)}, s.categories), 'out', array_append(s.out, named_struct('place', x.place, 'verdict', v.verdict, 'approved', v.approved, 'why', v.why)))), 1)"""
    fold = f"""aggregate(items, named_struct('total', total, 'markets', markets, 'categories', categories, 'out', CAST(array() AS ARRAY<STRUCT<place: INT, verdict: STRING, approved: {MONEY}, why: ARRAY<STRING>>>)),
      (s, x) -> {step}, s -> s.out)"""
    got = runs.select("run", F.explode(F.expr(fold)).alias("o")).select("run", F.col("o.place").alias("_place"), F.col("o.verdict").alias("verdict"), F.col("o.approved").alias("approved"), F.col("o.why").alias("reasons"))
    return df.drop("_own").join(got, ["run", "_place"]).drop("_place")


def risk_summary(judged: DataFrame) -> DataFrame:
    """Counts of the verdicts, and what was asked for, approved and blocked, per run."""
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    asked, given = F.sum("notional"), F.sum("approved")
    return judged.groupBy("run").agg(F.count("*").alias("n_total"), n("ALLOW").alias("n_allow"), n("BLOCK").alias("n_block"), n("DOWNSIZE").alias("n_downsize"), asked.alias("requested"), given.alias("approved"), F.greatest(asked - given, F.lit(0).cast(MONEY)).alias("blocked"))
