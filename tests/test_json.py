"""Messages of unknown shape against plain Python, over all of them."""

import hashlib
import json
import re
from decimal import ROUND_HALF_UP, Decimal

from tidemark.plans import json_queries as Q

SF = "/root/testdata/sf0.001"
NONE = object()


def _load(text):
    try:
        return json.loads(text, parse_float=Decimal)
    except ValueError:
        return NONE


def _canonical(x):
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_canonical(x[k])}" for k in sorted(x)) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(_canonical, x)) + "]"
    if isinstance(x, Decimal):
        r = x.quantize(Decimal("0.000001"), ROUND_HALF_UP)
        return "0" if r == 0 else format(r, "f").rstrip("0").rstrip(".")
    return json.dumps(x)


def _walk(x, key):
    if isinstance(x, dict):
        for k in sorted(x):
            if k == key:
                yield x[k]
            yield from _walk(x[k], key)
    elif isinstance(x, list):
        for y in x:
            yield from _walk(y, key)


def _int(x):
    if isinstance(x, bool) or not isinstance(x, (int, str)):
        return None
    return int(x) if re.fullmatch(r"[+-]?[0-9]+", str(x).strip()) else None


def _find(x):
    return next((i for f in Q.FIELDS for v in _walk(x, f) for i in [_int(v)] if i is not None), None)


def _blank(x):
    return x is None or x in ({}, []) or (isinstance(x, str) and not x.strip())


def _fill(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: _fill(a.get(k), b.get(k)) for k in {*a, *b}}
    return b if _blank(a) else a


def _flat(m):
    data = m.get("data")
    return {**(data if isinstance(data, dict) else {}), **{k: v for k, v in m.items() if k != "data"}}


def _rows(x):
    if isinstance(x, list):
        return [m for m in x if isinstance(m, dict)]
    if not isinstance(x, dict):
        return []
    lent = {k: v for k, v in _flat(x).items() if not isinstance(v, (dict, list)) and k not in ("events", "items", "results", "trades", "book_updates", "books", "data", "seq", "sequence", "offset")}
    for key in ("events", "data", "items", "results", "trades", "book_updates", "books"):
        v = x.get(key)
        if isinstance(v, list) and any(isinstance(m, dict) for m in v):
            return [{**lent, **_flat(m)} for m in v if isinstance(m, dict)]
        if isinstance(v, dict):
            return [{**lent, **_flat(v)}]
    return [_flat(x)]


def _channel(m):
    said = next((str(m[k]).lower() for k in ("channel", "type", "event", "topic") if m.get(k) is not None and str(m[k]).strip()), "")
    if "trade" in said or "book" in said:
        return "trade" if "trade" in said else "orderbook"
    if m.get("price") is not None and (m.get("size") is not None or m.get("amount") is not None):
        return "trade"
    return "orderbook" if m.get("bids") is not None or m.get("asks") is not None else "unknown"


def _messages(spark):
    return {r["id"]: _load(r["raw"]) for r in Q.messages(spark, SF).collect()}


def test_canonical_text_hash_and_numbers_found(spark):
    want = _messages(spark)
    for r in Q.QUERIES["message_hashes"](spark, SF).collect():
        x = want[r["id"]]
        if x is NONE:
            assert (r["canonical"], r["hash"], r["seq"]) == (None, None, None)
        else:
            assert r["canonical"] == _canonical(x) and r["hash"] == hashlib.sha256(_canonical(x).encode()).hexdigest() and r["seq"] == _find(x)


def test_rows_of_envelopes(spark):
    got = {}
    for r in Q.QUERIES["message_rows"](spark, SF).orderBy("id", "i").collect():
        got.setdefault(r["id"], []).append((r["channel"], r["token_id"], r["fields"]))
    for i, x in _messages(spark).items():
        rows = [] if x is NONE else _rows(x)
        assert got.get(i, []) == [(_channel(m), None if m.get("token_id") is None else str(m["token_id"]), _canonical(m)) for m in rows]


def test_missing_values_are_filled(spark):
    m = _messages(spark)
    got = {r["id"]: r["filled"] for r in Q.QUERIES["messages_filled"](spark, SF).collect()}
    assert len(got) > 900
    for i, text in got.items():
        a, b = m[i - 1], m[i + len(Q.SHAPES)]
        a, b = (None if x is NONE else x for x in (a, b))
        x = _fill(a, b)
        assert (text or "null") == _canonical(x)


def test_payloads_are_parsed_once(spark):
    """Each name of a parsed message would else stand for parsing it anew: 262 times in one row's expression."""
    from tidemark.sources import clob

    rows = spark.sql("""SELECT 1L AS key, payload FROM VALUES ('{"id": 1, "ts": 1}'), ('[]'), ('{') AS t(payload)""")
    for made in (clob.trades(rows), clob.candles(rows)):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("parseJson(payload") == 1
