"""JSON of unknown shape: canonical text and hash, search by key, filling of what is missing, rows of an envelope. All as
column expressions over VARIANT and its text, where the keys of objects are sorted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRING = r'"(?:[^"\\]|\\.)*"'
_NUMBER = r"-?[0-9][0-9.eE+-]*"
#: Keys of an envelope that hold rows, in their order, and those that a row doesn't inherit.
CONTAINERS = ["events", "data", "items", "results", "trades", "book_updates", "books"]
OWN = ["events", "items", "results", "trades", "book_updates", "books", "data", "seq", "sequence", "offset"]


def let(value: Column, f) -> Column:
    """f of a value that is evaluated once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def parsed(text: Column) -> Column:
    """Null for text that is no JSON."""
    return F.try_parse_json(text)


def compact(v: Column) -> Column:
    """The text of a variant without blanks, keys sorted at every depth."""
    return F.to_json(v)


def _ascii(token: Column) -> Column:
    """A string's characters beyond ASCII as \\u and four hexadecimal digits of UTF-16."""
    part = lambda s: F.when(s.rlike(r"^[\x00-\x7f]"), s).otherwise(F.regexp_replace(F.lower(F.hex(F.encode(s, "UTF-16BE"))), "(....)", r"\\u$1"))
    whole = F.array_join(F.transform(F.regexp_extract_all(token, F.lit(r"[\x00-\x7f]+|[^\x00-\x7f]+"), F.lit(0)), part), "")
    return F.when(F.char_length(token) == F.octet_length(token), token).otherwise(whole)


def _rounded(token: Column, decimals: int) -> Column:
    x = F.round(token.try_cast("double"), decimals)
    plain = F.regexp_replace(F.regexp_replace(x.try_cast(f"decimal(38,{decimals})").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(token.rlike(r"^-?[0-9]+$"), token).when(x == 0, "0").otherwise(F.coalesce(plain, token))


def canonical(v: Column, decimals: int = 6) -> Column:
    """JSON text that is the same for equal values: keys sorted, no blanks, ASCII, fractions rounded to so many places,
    no negative zero. A whole number is written without a fraction however it came."""
    tokens = F.regexp_extract_all(compact(v), F.lit(f'{_STRING}|{_NUMBER}|[^"0-9-]+'), F.lit(0))
    one = lambda t: F.when(t.startswith('"'), _ascii(t)).when(t.rlike(r"^[0-9-]"), _rounded(t, decimals)).otherwise(t)
    return F.array_join(F.transform(tokens, one), "")


def canonical_hash(v: Column, decimals: int = 6) -> Column:
    return F.sha2(canonical(v, decimals), 256)


def find_int(v: Column, fields: list[str]) -> Column:
    """The first whole number under the first of the fields that has one at any depth: of one field's values those come
    first that a depth-first walk over sorted keys meets first, which is their order in the compact text."""
    text = compact(v)

    def values(field: str) -> Column:
        key = field.replace("\\", "\\\\").replace("'", "")
        found = F.regexp_extract_all(text, F.lit(rf'[{{,]"{key}":({_STRING}|{_NUMBER})'), F.lit(1))
        return F.get(F.array_compact(F.transform(found, lambda t: F.when(F.trim(F.regexp_replace(t, '^"|"$', "")).rlike("^[+-]?[0-9]+$"), F.trim(F.regexp_replace(t, '^"|"$', "")).try_cast("long")))), F.lit(0))

    return F.coalesce(*[values(f) for f in fields])


def find_text(v: Column, field: str) -> Column:
    """The first text that is not blank under the field at any depth, in the order of find_int()."""
    found = F.regexp_extract_all(compact(v), F.lit(rf'[{{,]"{field}":({_STRING})'), F.lit(1))
    return F.get(F.filter(F.transform(found, lambda t: F.trim(F.try_parse_json(t).try_cast("string"))), lambda t: t != ""), F.lit(0))


def as_map(v: Column) -> Column:
    """An object's fields, null for anything else. Unlike the schema, the cast does not go into what the fields hold."""
    return v.try_cast("map<string,variant>")


def as_array(v: Column) -> Column:
    """A list's items, null for anything else."""
    return v.try_cast("array<variant>")


def plain(v: Column) -> Column:
    """A plain value as text, null for JSON's null and for objects and lists."""
    return F.when(as_map(v).isNull() & as_array(v).isNull(), v.try_cast("string"))


def _empty(v: Column) -> Column:
    fields, items = as_map(v), as_array(v)
    blank = let(F.when(fields.isNull() & items.isNull(), F.to_json(v)), lambda t: F.coalesce(t.rlike(r'^"(\\[tnrf]|\s)*"$'), F.lit(False)))
    return v.isNull() | F.is_variant_null(v) | F.when(fields.isNotNull(), F.size(fields) == 0).when(items.isNotNull(), F.size(items) == 0).otherwise(blank)


def fill_missing(existing: Column, incoming: Column, depth: int = 6) -> Column:
    """existing with what it lacks (null, blank text, empty object or list) from incoming; objects are filled key by key
    down to so many levels, below which an object that is not empty stays as it is; a list that is not empty stays."""
    value = F.when(_empty(existing), incoming).otherwise(existing)
    if depth == 0:
        return value
    maps = F.struct(as_map(existing).alias("e"), as_map(incoming).alias("i"))
    return F.coalesce(let(maps, lambda m: F.when(m["e"].isNotNull() & m["i"].isNotNull(), F.to_variant_object(F.map_zip_with(m["e"], m["i"], lambda _, a, b: fill_missing(a, b, depth - 1))))), value)


def _over(a: Column, b: Column) -> Column:
    """The entries of two maps; b's go first."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x))


def _items(v: Column) -> Column:
    """The objects of a list."""
    return F.filter(F.transform(as_array(v), as_map), lambda m: m.isNotNull())


def envelope_rows(v: Column) -> Column:
    """The rows of a message as maps of variants: the objects of a list; or those under the first container key that has
    any, with the plain values of the envelope and of their own data; or the message itself."""
    none = F.create_map().cast("map<string,variant>")
    at = lambda m, k: F.try_element_at(m, F.lit(k))
    own = lambda m: _over(F.coalesce(as_map(at(m, "data")), none), F.map_filter(m, lambda k, _: k != "data"))

    def inner(top: Column) -> Column:
        def under(flat: Column) -> Column:
            lent = F.map_filter(flat, lambda k, x: ~k.isin(OWN) & as_map(x).isNull() & as_array(x).isNull())
            held = lambda x: F.coalesce(let(_items(x), lambda i: F.when(F.size(i) > 0, i)), let(as_map(x), lambda m: F.when(m.isNotNull(), F.array(m))))
            first = F.coalesce(*[F.when(F.map_contains_key(top, k), held(at(top, k))) for k in CONTAINERS])
            return F.coalesce(let(first, lambda ms: F.when(ms.isNotNull(), let(lent, lambda lt: F.transform(ms, lambda m: _over(lt, own(m)))))), F.array(flat))

        return F.when(top.isNotNull(), let(own(top), under))

    return let(v, lambda x: F.coalesce(_items(x), let(as_map(x), inner), F.array().cast("array<map<string,variant>>")))


def text_at(row: Column, key: str) -> Column:
    """A plain value of a row as text, null for JSON's null and for objects and lists."""
    return let(F.try_element_at(row, F.lit(key)), plain)


def channel(row: Column) -> Column:
    """trade, orderbook or unknown, by what the row says it is, else by its shape."""
    said = F.lower(F.coalesce(*[F.nullif(F.trim(text_at(row, k)), F.lit("")) for k in ("channel", "type", "event", "topic")]))
    has = lambda k: F.try_element_at(row, F.lit(k)).isNotNull() & ~F.is_variant_null(F.try_element_at(row, F.lit(k)))
    shape = F.when(has("price") & (has("size") | has("amount")), "trade").when(has("bids") | has("asks"), "orderbook").otherwise("unknown")
    return F.when(said.contains("trade"), "trade").when(said.contains("book"), "orderbook").otherwise(shape)
