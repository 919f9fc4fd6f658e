"""Registered queries of the feed's state and of dates in payloads, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import selector
from ..streaming import reconcile
from .queries import _table

DAY = 86400


def feed_rows(spark, sf_dir):
    """Purchases and views as trades, clicks and sign-ups as books, errors as reports of the exchange. Every fifth token
    has no sequence numbers; some rows come late, and some numbers are left out."""
    e = _table(spark, sf_dir, "events").withColumn("token", F.col("user_id"))
    kind = F.when(F.col("event_type").isin("purchase", "view"), "trade").when(F.col("event_type").isin("click", "signup"), "book").otherwise("rest")
    w = Window.partitionBy("token").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("kind", kind).withColumn("_sold", F.sum((F.col("kind") == "trade").cast("long")).over(w))
    key, rest = F.col("event_id"), F.col("kind") == "rest"
    at = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', date_trunc('second', ts))") * 1_000_000
    late = F.when(~rest & (key % 23 == 0), 2 * DAY * 1_000_000).otherwise(0)
    seq = F.when(F.col("token") % 5 > 0, F.col("_sold"))
    mid = F.when(F.when(rest, key % 10 == 0).otherwise((F.col("kind") == "book") & (key % 6 > 0)), F.round("value"))
    return e.select(
        "token", key.alias("n"), "kind", (at - late).cast("long").alias("at"), F.when(F.col("kind") == "trade", seq + (key % 29 == 0).cast("long")).alias("seq"), mid.alias("mid"),
        F.when(rest, seq + key % 3).alias("rest_seq"), F.when(rest, at - 3_600_000_000).cast("long").alias("rest_at"), F.when(rest, key % 4).alias("rest_n"), F.when(rest, at).cast("long").alias("book_at"),
    )


def _verdicts(spark, sf_dir):
    got = reconcile.reconciled(feed_rows(spark, sf_dir), gap_seconds=DAY)
    none = lambda c: F.coalesce(c, F.lit(-1).cast("long")).alias(c)
    off = F.round(F.coalesce("mismatch_bps", F.lit(-1.0)), 6).alias("mismatch_bps")
    return got.select("token", "n", "at", none("window_start"), "reasons", off, "repaired", "trades_repaired", none("last_seq"), none("last_trade_at"), none("last_book_at"))


NOW = "TIMESTAMP_NTZ '2023-06-15 12:00:00'"
#: A payload of each kind, made of the order's key and date; the same text in both languages.
_KINDS = [
    ('{"close_ts": "', "epoch", '"}'),
    ('{"status": "open", "end_time": ', "millis", "}"),
    ('{"meta": {"resolution_ts": "', "iso", 'Z"}, "title": "ends 2025-01-01"}'),
    ('{"question": "Will it end by ', "slashed", ' or not?"}'),
    ('{"title": "It Ends ', "us", ' at noon"}'),
    ('{"slug": "until ', "eu", ' at last"}'),
    ('{"question": "by ', "us_short", '?"}'),
    ('{"description": "not before ', "eu_short", '"}'),
    ('{"close_ts": "soon", "status": "Closed", "title": "Who wins?"}', "none", ""),
    ('{"title": "31 february 2024", "description": "ends 2025-01-01", "k": ', "key", "}"),
]


def payloads(spark, sf_dir):
    d = F.to_timestamp(F.expr("o_orderdate + INTERVAL 28 YEARS"))
    say = {"epoch": F.unix_seconds(d).cast("string"), "millis": (F.unix_seconds(d) * 1000).cast("string"), "iso": F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), "slashed": F.date_format(d, "yyyy/MM/dd"), "us": F.date_format(d, "MMMM d, yyyy"),
           "eu": F.date_format(d, "d MMMM yyyy"), "us_short": F.date_format(d, "MMMM d"), "eu_short": F.date_format(d, "d MMMM"), "none": F.lit(""), "key": F.col("o_orderkey").cast("string")}
    made = F.lit(None).cast("string")
    for k, (a, kind, z) in enumerate(_KINDS):
        made = F.when(F.col("o_orderkey") % len(_KINDS) == k, F.concat(F.lit(a), say[kind], F.lit(z))).otherwise(made)
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("market_id"), made.alias("payload"))


def _resolutions(spark, sf_dir):
    now = F.expr(NOW)
    p = payloads(spark, sf_dir).withColumn("resolves", dates.resolution(F.col("payload"), now))
    ttr = selector.ttr_bucket(F.col("resolves"), now, F.get_json_object("payload", "$.status"))
    return p.select("market_id", F.coalesce(F.unix_seconds("resolves"), F.lit(-1).cast("long")).alias("resolves"), ttr.alias("ttr"))


QUERIES = {"feed_reconcile": _verdicts, "resolution_times": _resolutions}
_FEED = f"""e AS (SELECT user_id AS token, event_id AS n, CASE WHEN event_type IN ('purchase', 'view') THEN 'trade' WHEN event_type IN ('click', 'signup') THEN 'book' ELSE 'rest' END AS kind, value,
    date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) * 1000000 AS at0 FROM events),
  c AS (SELECT *, CASE WHEN token % 5 > 0 THEN sum((kind = 'trade')::INT) OVER (PARTITION BY token ORDER BY n)::BIGINT END AS q, at0 - CASE WHEN kind <> 'rest' AND n % 23 = 0 THEN {2 * DAY * 1_000_000} ELSE 0 END AS "at", row_number() OVER (PARTITION BY token ORDER BY n) AS k FROM e),
  r AS (SELECT token, n, kind, "at", k, CASE WHEN kind = 'trade' THEN q + (n % 29 = 0)::INT END AS seq, CASE WHEN (kind = 'rest' AND n % 10 = 0) OR (kind = 'book' AND n % 6 > 0) THEN round(value) END AS mid, CASE WHEN kind = 'rest' THEN q + n % 3 END AS rest_seq,
    at0 - 3600000000 AS rest_at, n % 4 AS rest_n, at0 AS book_now FROM c),
  s AS (SELECT token, 0::BIGINT AS k, NULL::BIGINT AS last_seq, NULL::BIGINT AS trade_at, NULL::BIGINT AS book_at, NULL::DOUBLE AS last_mid, NULL::BIGINT AS done_at, FALSE AS gap, FALSE AS reg, '' AS kind, 0::BIGINT AS n, 0::BIGINT AS "at", NULL::BIGINT AS window_start, '' AS reasons, NULL::DOUBLE AS off, FALSE AS repaired, 0::BIGINT AS repairs
      FROM (SELECT DISTINCT token FROM r) UNION ALL
    SELECT token, k, CASE WHEN kind = 'trade' THEN greatest(last_seq, seq) WHEN fix THEN greatest(last_seq, rest_seq) ELSE last_seq END, CASE WHEN kind = 'trade' THEN greatest(trade_at, "at") WHEN fix THEN greatest(trade_at, rest_at) ELSE trade_at END,
      CASE WHEN kind = 'book' THEN greatest(book_at, "at") WHEN fix THEN greatest(book_at, book_now) ELSE book_at END, CASE WHEN kind = 'book' OR fix THEN coalesce(mid, last_mid) ELSE last_mid END, CASE WHEN kind = 'rest' THEN greatest(done_at, "at") ELSE done_at END,
      NOT fix AND (gap OR coalesce(kind = 'trade' AND seq <> last_seq + 1, FALSE)), NOT fix AND (reg OR coalesce(kind = 'trade' AND "at" < trade_at, FALSE) OR coalesce(kind = 'book' AND "at" < book_at, FALSE)), kind, n, "at", coalesce(done_at, trade_at), why, bps, fix, CASE WHEN fix THEN rest_n ELSE 0 END FROM
    (SELECT *, kind = 'rest' AND (why <> '' OR coalesce(bps > 10, FALSE)) AS fix FROM
    (SELECT r.*, last_seq, trade_at, book_at, last_mid, done_at, gap, reg, CASE WHEN r.kind = 'rest' THEN abs(mid - last_mid) / greatest(abs(mid), abs(last_mid), 1e-8) * 10000 END AS bps,
      CASE WHEN r.kind = 'rest' THEN concat_ws(',', CASE WHEN reg THEN 'timestamp_regression' END, CASE WHEN gap THEN 'sequence_gap' END, CASE WHEN last_seq IS NOT NULL THEN CASE WHEN rest_seq > last_seq + 1 THEN 'rest_seq_ahead' END WHEN trade_at IS NULL THEN 'heuristic_reconcile_tick'
        WHEN (r."at" - trade_at) // 1000000 > {DAY} THEN 'heuristic_trade_stale' END) ELSE '' END AS why FROM s JOIN r ON r.token = s.token AND r.k = s.k + 1)))"""


def _payload_sql() -> str:
    d = "(o_orderdate + INTERVAL 28 YEARS)"
    say = {"epoch": f"epoch({d})::BIGINT::VARCHAR", "millis": f"(epoch({d})::BIGINT * 1000)::VARCHAR", "iso": f"strftime({d}, '%Y-%m-%dT%H:%M:%S')", "slashed": f"strftime({d}, '%Y/%m/%d')", "us": f"strftime({d}, '%B %-d, %Y')", "eu": f"strftime({d}, '%-d %B %Y')",
           "us_short": f"strftime({d}, '%B %-d')", "eu_short": f"strftime({d}, '%-d %B')", "none": "''", "key": "o_orderkey::VARCHAR"}
    return "CASE o_orderkey % {} {} END".format(len(_KINDS), " ".join(f"WHEN {k} THEN '{a}' || {say[kind]} || '{z}'" for k, (a, kind, z) in enumerate(_KINDS)))


def _instant_sql(c: str) -> str:
    number = f"CASE WHEN regexp_full_match(trim({c}), '-?[0-9]+([.][0-9]+)?') THEN {c}::DOUBLE END"
    return f"CASE WHEN {number} IS NOT NULL THEN CASE WHEN {number} > 1e10 THEN {number} / 1000 WHEN {number} > 0 THEN {number} END ELSE epoch(try_cast(replace({c}, 'Z', '') AS TIMESTAMP)) END"


def _text_sql(c: str) -> str:
    m = "(" + "|".join(dates.MONTHS) + ")"
    month = "list_position([" + ", ".join(f"'{x}'" for x in dates.MONTHS) + "], {})"
    t = f"lower(trim({c}))"
    part = lambda p, i: f"regexp_extract({t}, '{p}', {i})"
    day = lambda y, mo, d: f"epoch(try_cast(lpad(({y})::VARCHAR, 4, '0') || '-' || lpad(({mo})::VARCHAR, 2, '0') || '-' || lpad(({d})::VARCHAR, 2, '0') AS TIMESTAMP))"
    iso, mdy, dmy = r"\b(20[0-9]{2})[-_/](0[1-9]|1[0-2])[-_/](0[1-9]|[12][0-9]|3[01])\b", rf"\b{m}\s+([0-3]?[0-9]),?\s+(20[0-9]{{2}})\b", rf"\b([0-3]?[0-9])\s+{m},?\s+(20[0-9]{{2}})\b"
    md, dm, now = rf"\b{m}\s+([0-3]?[0-9])\b", rf"\b([0-3]?[0-9])\s+{m}\b", "epoch(TIMESTAMP '2023-06-15 12:00:00')"

    def short(mo: str, d: str) -> str:
        this, then = day("2023", mo, d), day("2024", mo, d)
        best = f"CASE WHEN {this} >= {now} THEN {this} WHEN {this} < {now} THEN {then} END"
        return f"CASE WHEN {best} - {now} <= {400 * DAY} THEN {best} END"

    return f"""CASE WHEN regexp_matches({t}, '{iso}') THEN {day(part(iso, 1), part(iso, 2), part(iso, 3))} WHEN regexp_matches({t}, '{mdy}') THEN {day(part(mdy, 3), month.format(part(mdy, 1)), part(mdy, 2))}
  WHEN regexp_matches({t}, '{dmy}') THEN {day(part(dmy, 3), month.format(part(dmy, 2)), part(dmy, 1))} WHEN regexp_matches({t}, '{md}') THEN {short(month.format(part(md, 1)), part(md, 2))}
  WHEN regexp_matches({t}, '{dm}') THEN {short(month.format(part(dm, 2)), part(dm, 1))} END"""


def _resolution_sql() -> str:
    field = lambda *path: "json_extract_string(payload, '$.{}')".format(".".join(path))
    parts = [_instant_sql(field(k)) for k in dates.RESOLUTION] + [_instant_sql(field(p, k)) for p in dates.NESTED for k in dates.RESOLUTION] + [_text_sql(field(k)) for k in dates.TEXTS]
    return f"coalesce({', '.join(parts)})"


ORACLES = {
    "feed_reconcile": f"""WITH RECURSIVE {_FEED} SELECT token, n, "at", coalesce(window_start, -1) AS window_start, reasons, round(coalesce(off, -1), 6) AS mismatch_bps, repaired, repairs AS trades_repaired, coalesce(last_seq, -1) AS last_seq,
  coalesce(trade_at, -1) AS last_trade_at, coalesce(book_at, -1) AS last_book_at FROM s WHERE kind = 'rest'""",
    "resolution_times": f"""WITH p AS (SELECT o_orderkey AS market_id, {_payload_sql()} AS payload FROM orders), r AS (SELECT market_id, payload, {_resolution_sql()} AS r FROM p)
  SELECT market_id, coalesce(r::BIGINT, -1) AS resolves, CASE WHEN r IS NULL THEN CASE WHEN lower(json_extract_string(payload, '$.status')) IN ('resolved', 'closed', 'ended') THEN '0_24h' ELSE 'unknown' END WHEN r - epoch(TIMESTAMP '2023-06-15 12:00:00') <= {DAY} THEN '0_24h'
  WHEN r - epoch(TIMESTAMP '2023-06-15 12:00:00') <= {7 * DAY} THEN '1_7d' WHEN r - epoch(TIMESTAMP '2023-06-15 12:00:00') <= {45 * DAY} THEN '7_30d' ELSE '30d_plus' END AS ttr FROM r""",
}
