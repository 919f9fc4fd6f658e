"""Payloads read as rows against plain Python, over all of them."""

import json
import re
from datetime import UTC, datetime
from decimal import ROUND_HALF_EVEN, Decimal, InvalidOperation

from tidemark.plans import source_queries as Q
from tidemark.sources import catalog

SF = "/root/testdata/sf0.001"


def _payloads(df, key):
    out = []
    for r in df.collect():
        try:
            out.append((r[key], json.loads(r["payload"], parse_float=Decimal)))
        except ValueError:
            out.append((r[key], None))
    return out


def _text(x):
    if x is None or isinstance(x, (dict, list)):
        return None
    return (str(x).lower() if isinstance(x, bool) else str(x)).strip() or None


def _first(m, names):
    return next((m[n] for n in names if m.get(n)), None)


def _time(x, milliseconds=False):
    t = _text(x)
    if t is None or isinstance(x, bool):
        return -1
    if isinstance(x, (int, Decimal)) or (milliseconds and re.fullmatch(r"[0-9.]+", t)):
        n = float(t)
        return int(n / 1000 if milliseconds and n > 1e10 else n)
    try:
        d = datetime.fromisoformat(t.replace("Z", "+00:00"))
    except ValueError:
        return -1
    return int((d if d.tzinfo else d.replace(tzinfo=UTC)).timestamp())


def _list(x):
    if isinstance(x, str) and x.strip().startswith("["):
        try:
            x = json.loads(x)
        except ValueError:
            return None
    return x if isinstance(x, list) else None


def _markets(spark):
    return [(k, m, _text(_first(m, catalog.ALIASES["market_id"]))) for k, m in _payloads(Q.market_payloads(spark, SF), "key") if isinstance(m, dict)]


def test_markets(spark):
    got = {r["market_id"]: r for r in Q.QUERIES["catalog_markets"](spark, SF).collect()}
    want = {}
    for _, m, i in _markets(spark):
        if i:
            said = _text(m.get("status"))
            status = said.lower() if said else next((k for k in ("resolved", "closed", "active") if m.get(k) is True), "unknown")
            want[i] = (*[_text(_first(m, catalog.ALIASES[c])) for c in ("slug", "description", "category", "rule_text")], _text(_first(m, catalog.ALIASES["title"])) or i, status, *[_time(_first(m, catalog.TIMES[c])) for c in ("created_ts", "updated_ts", "resolution_ts")])
    assert {i: tuple(r[c] for c in ("slug", "description", "category", "rule_text", "title", "status", "created_ts", "updated_ts", "resolution_ts")) for i, r in got.items()} == want and len(want) > 100


def test_tokens(spark):
    want = []
    for _, m, i in _markets(spark):
        if not i:
            continue
        out = []
        for t in m["tokens"] if isinstance(m.get("tokens"), list) else []:
            if isinstance(t, dict):
                out.append((_text(_first(t, catalog.TOKEN["outcome"])), _text(_first(t, catalog.TOKEN["token_id"]))))
        out = [x for x in out if all(x)]
        names, ids = _list(m.get("outcomes")), _list(m.get("clobTokenIds"))
        if not out and names is not None and ids is not None:
            out = [x for x in ((_text(o), _text(t)) for o, t in zip(names, ids)) if all(x)]
        want += [(i, o, t) for o, t in dict(out).items()]
    assert sorted(map(tuple, Q.QUERIES["catalog_tokens"](spark, SF).collect())) == sorted(want)


def _outcome(m):
    names, prices = _list(m.get("outcomes")), _list(m.get("outcomePrices"))
    label = lambda t: " ".join(t.lower().split())
    for k in catalog.EXPLICIT:
        v = m.get(k)
        if isinstance(v, int) and not isinstance(v, bool) and names is not None and 0 <= v < len(names):
            if _text(names[v]):
                return _text(names[v]), f"explicit:{k}"
            continue
        t = _text(v)
        if t:
            same = next((_text(n) for n in names or [] if _text(n) and label(_text(n)) == label(t)), t)
            return same, f"explicit:{k}"
    scored = []
    for n, p in zip(names or [], prices or []):
        try:
            d = Decimal(str(p))
        except InvalidOperation:
            continue
        if _text(n) and 0 <= d <= 1:
            scored.append((d, _text(n)))
    top = max((d for d, _ in scored), default=Decimal(0))
    best = [n for d, n in scored if d == top]
    return (best[0], catalog.INFERRED) if top >= Decimal("0.99") and len(best) == 1 else (None, "unresolved")


def test_outcomes(spark):
    want = []
    for _, m, i in _markets(spark):
        if i:
            o, source = _outcome(m)
            at = next((t for k in catalog.RESOLVED for t in [_time(m.get(k))] if t != -1), -1)
            want.append((i, o is not None, o, at if o is not None else -1, source))
    assert sorted(map(tuple, Q.QUERIES["catalog_outcomes"](spark, SF).collect()), key=str) == sorted(want, key=str)
    assert {w[4].split(":")[0] for w in want} == {"explicit", "inferred", "unresolved"}


def _number(x):
    t = _text(x)
    if t is None or not re.fullmatch(r"[+-]?[0-9]*[.]?[0-9]+([eE][+-]?[0-9]+)?", t):
        return None
    return Decimal(t).quantize(Decimal("0.00000001"), ROUND_HALF_EVEN)


def _levels(side, bids):
    out = []
    for x in side if isinstance(side, list) else []:
        pair = (x.get("price"), _first(x, ["size", "amount"])) if isinstance(x, dict) else tuple(x[:2]) if isinstance(x, list) and len(x) > 1 else (None, None)
        pair = tuple(map(_number, pair))
        if None not in pair:
            out.append(pair)
    return sorted(out, reverse=bids)[:2]


def test_books(spark):
    want = {}
    for i, m in _payloads(Q.event_payloads(spark, SF, Q.BOOKS), "event_id"):
        if isinstance(m, dict):
            bids, asks = _levels(m.get("bids"), True), _levels(m.get("asks"), False)
            at = _time(_first(m, ["event_ts", "timestamp", "ts"]), True)
            mid = _number(m.get("mid"))
            if mid is None and bids and asks:
                mid = ((bids[0][0] + asks[0][0]) / 2).quantize(Decimal("0.00000001"), ROUND_HALF_EVEN)
            say = lambda side: " ".join(f"{p:f}x{s:f}" for p, s in side)
            want[i] = (at if at != -1 else 1704067200, say(bids), say(asks), None if mid is None else f"{mid:f}")
    assert {r["event_id"]: (r["event_ts"], r["bids"], r["asks"], r["mid"]) for r in Q.QUERIES["payload_books"](spark, SF).collect()} == want


def test_trades(spark):
    want = []
    for i, m in _payloads(Q.event_payloads(spark, SF, Q.TRADES), "event_id"):
        rows = m if isinstance(m, list) else [m["data"]] if isinstance(m, dict) and isinstance(m.get("data"), dict) else m.get("trades", []) if isinstance(m, dict) else []
        for r in rows:
            if not isinstance(r, dict):
                continue
            at, price, size = _time(_first(r, ["event_ts", "timestamp", "ts", "created_at", "createdAt"]), True), _number(r.get("price")), _number(_first(r, ["size", "amount"]))
            if at == -1 or price is None or size is None:
                continue
            side = {"bid": "buy", "s": "sell"}.get((_text(r.get("side")) or "").lower(), "unknown")
            seq = next((_text(r[k]) for k in ("seq", "sequence") if r.get(k) is not None), None)
            want.append((i, at, f"{price:f}", f"{size:f}", side, _text(_first(r, ["trade_hash", "hash", "id"])), int(seq) if seq and seq.isdigit() else None))
    assert sorted(map(tuple, Q.QUERIES["payload_trades"](spark, SF).collect()), key=str) == sorted(want, key=str)


def test_candles(spark):
    got = Q.QUERIES["payload_candles"](spark, SF).collect()
    assert len(got) == 1000 and all((r["end_ts"] - r["start_ts"], r["high"], r["low"], r["close"]) == (3600, "1.00000000", "0.00000000", "0.50000000") for r in got)
