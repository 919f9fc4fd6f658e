"""Payloads of claims and checklists held against their rules: what is wrong with each as rows, and what takes the place
of one that is wrong. Rules are tables compiled into one expression over VARIANT; no row leaves its task for it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.jsons import as_array, as_map, canonical, let, parsed, plain, text_at

ISSUES = "array<struct<path:string,code:string,reason:string>>"


@dataclass(frozen=True)
class Rule:
    """What a field must be: its kind, whether it may be missing, bounds of its length or value, values, pattern."""

    kind: str
    required: bool = False
    low: float | None = None
    high: float | None = None
    values: tuple = ()
    pattern: str | None = None
    unique: bool = False


@dataclass(frozen=True)
class Schema:
    """Fields of an object, the rules of the objects in its lists, and how long such a list may be."""

    fields: dict[str, Rule]
    lists: dict[str, Schema] = field(default_factory=dict)
    most: dict[str, int] = field(default_factory=dict)


#: The rules of both payloads, the largest numbers of claims and sources, the flag of an invalid payload.
STANCES = ("support", "oppose", "neutral", "unknown")
_SOURCE = {"url": Rule("string", True, 1, 4096), "title": Rule("string", high=2000), "published_at": Rule("string"), "quote": Rule("string", high=4000)}
_HEAD = {"market_id": Rule("string", True, 1, 256), "generated_at": Rule("string", True), "meta": Rule("object")}
_RAW = Schema(
    {"claim_text": Rule("string", True, 1, 4000), "stance": Rule("string", True, values=STANCES), "confidence": Rule("number", low=0, high=1), "sources": Rule("array", True)},
    {"sources": Schema({**_SOURCE, "source_type": Rule("string", values=("primary", "secondary", "unknown"))})},
)
_CANONICAL = Schema({"claim_canonical": Rule("string", True, 1, 4000), "claim_hash": Rule("string", True, pattern="^[a-f0-9]{64}$"), "source_urls": Rule("array", True, unique=True), "evidence_count": Rule("integer", low=0)})
_ITEM = Schema(
    {"item_id": Rule("string", True, 1, 128), "statement": Rule("string", True, 1, 4000), "status": Rule("string", True, values=("supported", "contradicted", "insufficient", "unknown")), "sources": Rule("array", True), "resolution_aware": Rule("boolean")},
    {"sources": Schema({**_SOURCE, "stance": Rule("string", values=STANCES)})},
)
CLAIMS = Schema({"schema_version": Rule("any", True, values=("claim_extract.v1",)), **_HEAD, "claims": Rule("array", True), "canonical_claims": Rule("array")}, {"claims": _RAW, "canonical_claims": _CANONICAL}, {"claims": 80, "canonical_claims": 25})
CHECKLIST = Schema({"schema_version": Rule("any", True, values=("evidence_checklist.v1",)), **_HEAD, "items": Rule("array", True)}, {"items": _ITEM})
MOST_SOURCES = 10
INVALID = "llm_invalid_output"
CODES = {"claims": "max_raw_claims_exceeded", "canonical_claims": "max_canonical_claims_exceeded"}


def _kind(v: Column) -> Column:
    """Only plain values are asked for their schema, which else goes through all that an object or list holds."""
    one = let(F.schema_of_variant(v), lambda s: F.when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").otherwise("number"))
    return F.when(as_map(v).isNotNull(), "object").when(as_array(v).isNotNull(), "array").otherwise(one)


def _issue(bad: Column, path: Column, code: str, reason: Column) -> Column:
    return F.when(bad, F.struct(path.alias("path"), F.lit(code).alias("code"), reason.cast("string").alias("reason")))


def _field(m: Column, path: Column, name: str, rule: Rule) -> Column:
    here = F.concat(path, F.lit(f".{name}"))
    def judged(e: Column) -> Column:
        kind, text, number = e["kind"], e["text"], e["number"]
        want = {"any": F.lit(True), "integer": (kind == "number") & (number % 1 == 0)}.get(rule.kind, kind == rule.kind)
        found = [_issue(e["has"] & ~want, here, "schema:type", F.lit(rule.kind))]
        if rule.values:
            code = "schema:const" if rule.kind == "any" else "schema:enum"
            found.append(_issue(e["has"] & ~((kind == "string") & text.isin(*rule.values)), here, code, F.lit(name)))
        if rule.pattern:
            found.append(_issue((kind == "string") & ~text.rlike(rule.pattern), here, "schema:pattern", F.lit(name)))
        if rule.unique:
            items = F.transform(as_array(e["v"]), lambda x: canonical(x))
            found.append(_issue(F.size(F.array_distinct(items)) < F.size(items), here, "schema:uniqueItems", F.lit(name)))
        size, codes = (number, ("minimum", "maximum")) if rule.kind in ("number", "integer") else (F.char_length(text), ("minLength", "maxLength"))
        holds = kind == ("number" if rule.kind in ("number", "integer") else "string")
        if rule.low is not None:
            found.append(_issue(holds & (size < rule.low), here, f"schema:{codes[0]}", F.lit(name)))
        if rule.high is not None:
            found.append(_issue(holds & (size > rule.high), here, f"schema:{codes[1]}", F.lit(name)))
        return F.array(*found)

    def described(v: Column) -> Column:
        return let(_kind(v), lambda k: let(F.struct(v.alias("v"), F.lit(True).alias("has"), k.alias("kind"), F.when(k == "string", v.try_cast("string")).alias("text"), F.when(k == "number", v.try_cast("double")).alias("number")), judged))

    missing = F.array(_issue(F.lit(rule.required), path, "schema:required", F.lit(name))).cast(ISSUES)
    return F.when(F.map_contains_key(m, name), let(F.try_element_at(m, F.lit(name)), described).cast(ISSUES)).otherwise(missing)


def _sources(m: Column, path: Column) -> Column:
    """Too many sources of a claim, and those whose canonical URL an earlier one of it has: the URLs are sorted with
    their places and compared with the one before."""
    urls = F.transform(as_array(F.try_element_at(m, F.lit("sources"))), lambda s: text_at(as_map(s), "url"))
    named = F.transform(as_array(F.try_element_at(m, F.lit("source_urls"))), plain)
    form = lambda u: let(F.nullif(T.stripped(u), F.lit("")), lambda s: F.coalesce(T.canonical_url(s), s))

    def judged(us: Column) -> Column:
        order = F.array_sort(F.filter(F.transform(us, lambda u, j: F.struct(form(u).alias("u"), j.alias("j"))), lambda x: x["u"].isNotNull()))
        again = let(order, lambda o: F.filter(F.zip_with(o, F.concat(F.array(F.lit(None).cast("struct<u:string,j:int>")), o), lambda a, b: F.when(a["u"] == b["u"], a)), lambda x: x.isNotNull()))
        many = _issue(F.size(us) > MOST_SOURCES, F.concat(path, F.lit(".sources")), "max_sources_per_claim_exceeded", F.concat(F.size(us), F.lit(f" exceeds {MOST_SOURCES}")))
        twice = F.transform(again, lambda x: F.struct(F.concat(path, F.lit(".sources["), x["j"], F.lit("].url")).alias("path"), F.lit("duplicate_source_url").alias("code"), x["u"].alias("reason")))
        return F.coalesce(F.concat(F.array(many).cast(ISSUES), twice.cast(ISSUES)), F.array().cast(ISSUES))

    return let(F.coalesce(urls, named), judged)


def _items(items: Column, path: Column, schema: Schema, depth: int) -> Column:
    one = lambda x, i: _object(x, F.concat(path, F.lit("["), i, F.lit("]")), schema, depth)
    return F.coalesce(F.flatten(F.transform(items, one)), F.array().cast(ISSUES))


def _object(v: Column, path: Column, schema: Schema, depth: int = 0) -> Column:
    def judged(m: Column) -> Column:
        others = F.array_sort(F.array_except(F.map_keys(m), F.array(*map(F.lit, sorted(schema.fields)))))
        parts = [_field(m, path, n, r).cast(ISSUES) for n, r in schema.fields.items()]
        parts.append(F.array(_issue(F.size(others) > 0, path, "schema:additionalProperties", F.array_join(others, ","))).cast(ISSUES))
        if depth == 1:
            parts.append(_sources(m, path))
        for name, inner in schema.lists.items():
            items, at = as_array(F.try_element_at(m, F.lit(name))), F.concat(path, F.lit(f".{name}"))
            parts.append(_items(items, at, inner, depth + 1))
            if name in schema.most:
                parts.append(let(F.size(items), lambda n: F.array(_issue(n > schema.most[name], at, CODES[name], F.concat(n, F.lit(f" exceeds {schema.most[name]}")))).cast(ISSUES)))
        return F.concat(*parts)

    code = "payload_type" if depth == 0 else "schema:type"
    none = F.array(F.struct(path.alias("path"), F.lit(code).alias("code"), F.lit("object").alias("reason"))).cast(ISSUES)
    return F.coalesce(let(as_map(v), lambda m: F.when(m.isNotNull(), judged(m))), none)


def issues(payload: Column, schema: Schema = CLAIMS) -> Column:
    """What is wrong with a payload's text as an array of (path, code, reason), sorted; empty if nothing is. Text that is
    null, no JSON or no object has one issue, payload_type. The form of times and URLs is not judged; a missing or
    unknown name is an issue of the object, by its path."""
    return F.array_sort(F.array_compact(let(parsed(payload), lambda v: _object(v, F.lit("$"), schema))))


def outcome(rows: DataFrame, key: str, schema: Schema = CLAIMS, version: str = "claim_extract.v1") -> DataFrame:
    """rows (key, market_id, payload) with issues, used_fallback, no_trade_flags and the payload that goes on as canonical
    JSON: its own if nothing is wrong, else one without claims that names what was wrong and is flagged."""
    df = rows.select(key, "market_id", "payload", issues(F.col("payload"), schema).alias("issues"))
    at = F.coalesce(text_at(as_map(parsed(F.col("payload"))), "generated_at"), F.lit("unknown"))
    none = F.array().cast("array<string>")
    errors = F.transform("issues", lambda i: F.struct(i["code"].alias("code"), i["path"].alias("path"), i["reason"].alias("reason")))
    instead = F.to_json(F.struct(none.alias("claims"), none.alias("claims_raw"), errors.alias("errors"), at.alias("generated_at"), F.col("market_id").cast("string").alias("market_id"), F.array(F.lit(INVALID)).alias("no_trade_flags"), F.lit(version).alias("schema_version")))
    bad = F.size("issues") > 0
    return df.select(key, "issues", bad.alias("used_fallback"), F.when(bad, F.array(F.lit(INVALID))).otherwise(none).alias("no_trade_flags"), canonical(F.when(bad, parsed(instead)).otherwise(parsed(F.col("payload")))).alias("payload"))
