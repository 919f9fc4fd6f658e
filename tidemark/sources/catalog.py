"""Market payloads as rows: markets, their tokens and their outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsons

#: The names under which payloads give each field, the first that has a value counting.
ALIASES = {
    "market_id": ["market_id", "marketId", "id", "condition_id", "conditionId"],
    "slug": ["slug"],
    "title": ["title", "question"],
    "description": ["description"],
    "category": ["category"],
    "rule_text": ["rule_text", "rules", "resolution_criteria", "resolutionCriteria"],
}
TIMES = {
    "created_ts": ["created_ts", "createdAt", "created_at", "created"],
    "updated_ts": ["updated_ts", "updatedAt", "updated_at", "updated"],
    "resolution_ts": ["resolution_ts", "resolvedAt", "resolveDate", "resolutionDate"],
}
TOKEN = {"token_id": ["token_id", "tokenId", "id"], "outcome": ["outcome", "name", "label"]}
EXPLICIT = ["winningOutcome", "winning_outcome", "resolvedOutcome", "resolved_outcome", "outcome"]
RESOLVED = ["resolvedAt", "closedTime", "endDateIso", "updatedAt"]
CERTAIN = 0.99
INFERRED = "inferred:outcomePrices_unique_max_ge_0.99"


def _truthy(v: Column) -> Column:
    """Whether a value is there, and not null, empty, zero or false."""
    return v.isNotNull() & ~F.is_variant_null(v) & ~jsons.let(F.to_json(v), lambda t: t.isin("false", '""', "[]", "{}") | F.coalesce(t.try_cast("double") == 0, F.lit(False)))


def _text(v: Column) -> Column:
    """A plain value as trimmed text, null if blank."""
    return jsons.let(v, lambda x: F.nullif(F.trim(jsons.plain(x)), F.lit("")))


def _first(m: Column, names: list[str]) -> Column:
    """The first value of the names that is there and says something."""
    return F.get(F.filter(F.transform(F.array(*map(F.lit, names)), lambda n: F.try_element_at(m, n)), _truthy), F.lit(0))


def instant(v: Column) -> Column:
    """Seconds since 1970 as a number, or ISO 8601, UTC if it says nothing else; null for other text."""
    iso = lambda t: F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"), t.try_cast("timestamp"))
    return jsons.let(v, lambda x: jsons.let(_text(x), lambda t: F.when(F.schema_of_variant(x).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.timestamp_seconds(t.try_cast("double"))).otherwise(iso(t))))


def as_list(v: Column) -> Column:
    """A list, or the text of one, as an array of variants; null for anything else."""
    opened = lambda x: jsons.let(x.try_cast("string"), lambda t: F.when(F.trim(t).startswith("["), F.try_parse_json(t)))
    return jsons.let(v, lambda x: F.coalesce(jsons.as_array(x), F.when(F.substring(F.to_json(x), 1, 1) == '"', jsons.as_array(opened(x)))))


def status(m: Column) -> Column:
    at = lambda k: F.try_element_at(m, F.lit(k))
    is_true = lambda k: F.coalesce(F.to_json(at(k)) == "true", F.lit(False))
    said = F.lower(_text(at("status")))
    return F.coalesce(said, F.when(is_true("resolved"), "resolved").when(is_true("closed"), "closed").when(is_true("active"), "active").otherwise("unknown"))


def parsed(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """payloads with m, the fields of the object in column; rows that hold no object are left out."""
    return where_set(payloads, jsons.as_map(jsons.parsed(F.col(column))), "m")


def where_set(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """rows with value under name, those without one left out. As a generator it is evaluated once: a filter would be
    pushed below the projection with all that value is made of, and JSON parsed again for each place that names it."""
    return rows.select("*", F.explode(F.filter(F.array(value), lambda x: x.isNotNull())).alias(name))


def markets(payloads: DataFrame) -> DataFrame:
    """payloads (payload: JSON, ingested_at) to one row per payload that names a market: its fields under whichever name
    they come, the status, and audit, the payload in canonical form. A title falls back on the id."""
    m = F.col("m")
    df = where_set(parsed(payloads), _text(_first(m, ALIASES["market_id"])), "market_id")
    df = df.select("*", *[_text(_first(m, names)).alias(c) for c, names in ALIASES.items() if c != "market_id"], *[instant(_first(m, names)).alias(c) for c, names in TIMES.items()], status(m).alias("status"), jsons.canonical(F.to_variant_object(m)).alias("audit"))
    return df.withColumn("title", F.coalesce("title", "market_id")).drop("m", "payload")


def latest(rows: DataFrame) -> DataFrame:
    """markets() to one row per market: that updated last, unknown times first, equal ones by the audit text."""
    best = F.max(F.struct(F.col("updated_ts").isNotNull().alias("known"), "updated_ts", "audit", *[c for c in rows.columns if c not in ("market_id", "updated_ts", "audit")])).alias("r")
    return rows.groupBy("market_id").agg(best).select("market_id", *[f"r.{c}" for c in rows.columns if c != "market_id"])


def tokens(payloads: DataFrame) -> DataFrame:
    """(market_id, outcome, token_id) of each payload: from its list of tokens, else from the lists of outcomes and token
    ids side by side up to the shorter one's end; of one outcome's tokens the last counts."""
    m = F.col("m")
    at = lambda k: F.try_element_at(m, F.lit(k))
    pair = lambda t: F.struct(_text(_first(t, TOKEN["outcome"])).alias("outcome"), _text(_first(t, TOKEN["token_id"])).alias("token_id"))
    own = jsons.as_array(at("tokens"))
    listed = F.transform(F.filter(F.transform(own, jsons.as_map), lambda t: t.isNotNull()), pair)
    names, ids = as_list(at("outcomes")), as_list(at("clobTokenIds"))
    zipped = jsons.let(F.struct(names.alias("o"), ids.alias("t")), lambda z: F.when(z["o"].isNotNull() & z["t"].isNotNull(), F.transform(F.slice(F.arrays_zip(z["o"].alias("o"), z["t"].alias("t")), F.lit(1), F.least(F.size(z["o"]), F.size(z["t"]))), lambda x: F.struct(_text(x["o"]).alias("outcome"), _text(x["t"]).alias("token_id")))))
    whole = lambda a: F.filter(a, lambda x: x["outcome"].isNotNull() & x["token_id"].isNotNull())
    pairs = jsons.let(whole(listed), lambda a: F.when(F.size(a) > 0, a).otherwise(whole(zipped)))
    df = where_set(parsed(payloads).select("m"), _text(_first(m, ALIASES["market_id"])), "market_id").withColumn("_row", F.monotonically_increasing_id())
    rows = df.select("_row", "market_id", F.posexplode(pairs).alias("i", "x"))
    return rows.groupBy("_row", "market_id", F.col("x.outcome").alias("outcome")).agg(F.max_by("x.token_id", "i").alias("token_id")).drop("_row")


def _label(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(t)), "\\s+", " "))


def outcomes(payloads: DataFrame) -> DataFrame:
    """(market_id, resolved, outcome, resolved_ts, source) of each payload that names a market: an outcome it states, by
    place in its list or by label, else the only one whose price is the largest and at least CERTAIN, else unresolved."""
    m = F.col("m")
    at = lambda k: F.try_element_at(m, F.lit(k))

    def stated(key: Column, names: Column) -> Column:
        def said(v: Column) -> Column:
            place = F.when(F.schema_of_variant(v) == "BIGINT", v.try_cast("long"))
            same = lambda text: F.get(F.filter(F.transform(names, _text), lambda t: _label(t) == _label(text)), F.lit(0))
            return F.when((place >= 0) & (place < F.size(names)), _text(F.get(names, place.cast("int")))).otherwise(jsons.let(_text(v), lambda text: F.when(names.isNull(), text).otherwise(F.coalesce(same(text), text))))

        return F.struct(jsons.let(F.try_element_at(m, key), said).alias("outcome"), F.concat(F.lit("explicit:"), key).alias("source"))

    def priced(names: Column, prices: Column) -> Column:
        pairs = F.transform(F.slice(F.arrays_zip(names.alias("o"), prices.alias("p")), F.lit(1), F.least(F.size(names), F.size(prices))), lambda x: F.struct(_text(x["p"]).try_cast("decimal(38,18)").alias("p"), _text(x["o"]).alias("o")))
        fit = F.filter(pairs, lambda x: x["o"].isNotNull() & (x["p"] >= 0) & (x["p"] <= 1))
        top = jsons.let(fit, lambda a: jsons.let(F.array_max(F.transform(a, lambda x: x["p"])), lambda p: F.when(p >= CERTAIN, F.filter(a, lambda x: x["p"] == p))))
        return jsons.let(top, lambda w: F.when(F.size(w) == 1, F.struct(F.get(w, F.lit(0))["o"].alias("outcome"), F.lit(INFERRED).alias("source"))))

    df = where_set(parsed(payloads), _text(_first(m, ALIASES["market_id"])), "market_id").withColumns({"_names": as_list(at("outcomes")), "_prices": as_list(at("outcomePrices"))})
    said = F.get(F.filter(F.transform(F.array(*map(F.lit, EXPLICIT)), lambda k: stated(k, F.col("_names"))), lambda x: x["outcome"].isNotNull()), F.lit(0))
    when = F.coalesce(*[instant(at(k)) for k in RESOLVED])
    df = df.select("market_id", F.coalesce(said, F.when(F.col("_names").isNotNull() & F.col("_prices").isNotNull(), priced(F.col("_names"), F.col("_prices")))).alias("s"), when.alias("at"))
    found = F.col("s").isNotNull()
    return df.select("market_id", found.alias("resolved"), F.col("s.outcome").alias("outcome"), F.when(found, F.col("at")).alias("resolved_ts"), F.coalesce("s.source", F.lit("unresolved")).alias("source"))
