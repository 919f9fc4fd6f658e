"""Payloads of books, trades and candles as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsons
from .catalog import _first, _text, where_set

#: The names under which payloads give each field.
TRADE = {"event_ts": ["event_ts", "timestamp", "ts", "created_at", "createdAt"], "price": ["price"], "size": ["size", "amount"], "side": ["side"], "trade_hash": ["trade_hash", "hash", "id"], "seq": ["seq", "sequence"]}
CANDLE = {"start_ts": ["start", "start_ts", "ts", "timestamp"], "end_ts": ["end", "end_ts"], "open": ["open", "o"], "high": ["high", "h"], "low": ["low", "l"], "close": ["close", "c"], "volume": ["volume", "v"]}
EIGHT = "decimal(28,8)"


def quantised(c: Column, digits: int = 8) -> Column:
    """Rounded half to even to so many decimals; null for what is no number."""
    return F.bround(c.try_cast("decimal(38,18)"), digits).cast(f"decimal(28,{digits})")


def _number(v: Column) -> Column:
    return quantised(_text(v))


def instant(v: Column) -> Column:
    """Seconds, milliseconds above 1e10, or ISO 8601."""
    iso = lambda t: F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"), t.try_cast("timestamp"))
    seconds = lambda n: F.timestamp_seconds(F.when(n > 1e10, n / 1000).otherwise(n))
    return jsons.let(_text(v), lambda t: F.coalesce(jsons.let(t.try_cast("double"), seconds), iso(t)))


def levels(side: Column, bids: bool, depth: int | None = None) -> Column:
    """A side of a book, a variant, as array<struct<price, size>>: objects with price and size (or amount) or pairs of
    both, others left out; bids from the highest price and size down, asks from the lowest up; the first `depth`."""

    def level(x: Column) -> Column:
        named = lambda m: F.struct(_number(F.try_element_at(m, F.lit("price"))).alias("price"), _number(_first(m, ["size", "amount"])).alias("size"))
        placed = lambda a: F.struct(_number(F.get(a, F.lit(0))).alias("price"), _number(F.get(a, F.lit(1))).alias("size"))
        return F.coalesce(jsons.let(jsons.as_map(x), lambda m: F.when(m.isNotNull(), named(m))), jsons.let(jsons.as_array(x), lambda a: F.when(a.isNotNull(), placed(a))))

    items = F.filter(F.transform(jsons.as_array(side), level), lambda x: x["price"].isNotNull() & x["size"].isNotNull())
    ordered = F.sort_array(items, asc=not bids)
    out = ordered if depth is None else F.slice(ordered, 1, max(0, depth))
    return F.coalesce(out, F.array().cast(f"array<struct<price:{EIGHT},size:{EIGHT}>>"))


def books(payloads: DataFrame, depth: int | None = None) -> DataFrame:
    """payloads (payload, received: the time to fall back on) with event_ts, bids, asks and mid: the payload's own, else
    half way between the best prices. Rows that hold no object are left out."""
    df = where_set(payloads, jsons.as_map(jsons.parsed(F.col("payload"))), "_m")
    at = lambda k: F.try_element_at("_m", F.lit(k))
    df = df.withColumns({"event_ts": F.coalesce(instant(_first(F.col("_m"), ["event_ts", "timestamp", "ts"])), F.col("received")), "bids": levels(at("bids"), True, depth), "asks": levels(at("asks"), False, depth)})
    half = (F.get("bids", F.lit(0))["price"] + F.get("asks", F.lit(0))["price"]) / 2
    return df.withColumn("mid", F.coalesce(_number(at("mid")), quantised(half))).drop("_m", "payload")


def trades(payloads: DataFrame) -> DataFrame:
    """payloads (payload: a list, or an object with a list of trades or data) to one row per trade that has time, price
    and size, with side (buy, sell, unknown), trade_hash and seq; the others' number is the difference to their lists."""
    from ..functions.text import side

    rows = F.explode(jsons.envelope_rows(jsons.parsed(F.col("payload")))).alias("_r")
    r = F.col("_r")
    keep = [c for c in payloads.columns if c != "payload"]
    df = payloads.select(*keep, rows)
    row = F.struct(instant(_first(r, TRADE["event_ts"])).alias("event_ts"), _number(_first(r, TRADE["price"])).alias("price"), _number(_first(r, TRADE["size"])).alias("size"), side(F.coalesce(_text(_first(r, TRADE["side"])), F.lit(""))).alias("side"), _text(_first(r, TRADE["trade_hash"])).alias("trade_hash"), _text(F.coalesce(*[F.try_element_at(r, F.lit(k)) for k in TRADE["seq"]])).try_cast("long").alias("seq"))
    whole = jsons.let(row, lambda x: F.when(x["event_ts"].isNotNull() & x["price"].isNotNull() & x["size"].isNotNull(), x))
    return where_set(df, whole, "_t").select(*keep, "_t.*")


def candles(payloads: DataFrame) -> DataFrame:
    """payloads (payload: a list of candles) to one row per candle with a start before its end and all five numbers."""
    rows = F.explode(jsons.envelope_rows(jsons.parsed(F.col("payload")))).alias("_r")
    r, keep = F.col("_r"), [c for c in payloads.columns if c != "payload"]
    row = F.struct(*[instant(_first(r, CANDLE[c])).alias(c) for c in ("start_ts", "end_ts")], *[_number(F.coalesce(*[F.try_element_at(r, F.lit(k)) for k in CANDLE[c]])).alias(c) for c in ("open", "high", "low", "close", "volume")])
    numbers = ("open", "high", "low", "close", "volume")

    def judged(x: Column) -> Column:
        whole = x["end_ts"] > x["start_ts"]
        for c in numbers:
            whole = whole & x[c].isNotNull()
        return F.when(whole, x)

    return where_set(payloads.dropna(subset=keep).select(*keep, rows) if keep else payloads.select(rows), jsons.let(row, judged), "_c").select(*keep, "_c.*")
