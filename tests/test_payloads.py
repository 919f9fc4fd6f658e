"""Payloads of claims against plain Python over all of them, samples of strata, and evaluations of odd selections."""

import json

from pyspark.sql import functions as F

from tidemark.operators import evaluation, payloads
from tidemark.plans import payload_queries as Q

SF = "/root/testdata/sf0.001"
TYPES = {"string": str, "array": list, "object": dict, "boolean": bool}


def _url(u):
    u = u.strip()
    if not u.startswith("http"):
        return u
    rest = u.split("#")[0].split("?utm_source")[0].split("://")[1]
    host, _, path = rest.partition("/")
    return f"https://{host.lower().removeprefix('www.')}/{path}"


def _text(u):
    return None if u is None or isinstance(u, (dict, list)) else str(u)


def _claim(c, path, out):
    us = c.get("sources")
    if isinstance(us, list):
        us = [_text(s.get("url")) if isinstance(s, dict) else None for s in us]
    elif isinstance(c.get("source_urls"), list):
        us = [_text(u) for u in c["source_urls"]]
    else:
        return
    if len(us) > 10:
        out.append((f"{path}.sources", "max_sources_per_claim_exceeded"))
    seen = set()
    for j, u in enumerate(us):
        if u is None or not u.strip():
            continue
        out += [(f"{path}.sources[{j}].url", "duplicate_source_url")] * (_url(u) in seen)
        seen.add(_url(u))


def _check(x, path, schema, out, depth=0):
    if not isinstance(x, dict):
        out.append((path, "schema:type" if depth else "payload_type"))
        return
    out += [(path, "schema:additionalProperties")] * bool(set(x) - set(schema.fields))
    for name, rule in schema.fields.items():
        at = f"{path}.{name}"
        if name not in x:
            out += [(path, "schema:required")] * rule.required
            continue
        v = x[name]
        number = isinstance(v, (int, float)) and not isinstance(v, bool)
        ok = {"any": True, "number": number, "integer": number and v % 1 == 0}.get(rule.kind, isinstance(v, TYPES.get(rule.kind, ())))
        out += [(at, "schema:type")] * (not ok)
        if rule.values and v not in rule.values:
            out.append((at, "schema:const" if rule.kind == "any" else "schema:enum"))
        if rule.pattern and isinstance(v, str) and not (len(v) == 64 and set(v) <= set("0123456789abcdef")):
            out.append((at, "schema:pattern"))
        if rule.unique and isinstance(v, list) and len({json.dumps(i) for i in v}) < len(v):
            out.append((at, "schema:uniqueItems"))
        if rule.kind == "string" and isinstance(v, str):
            out += [(at, "schema:minLength")] * (len(v) < (rule.low or 0)) + [(at, "schema:maxLength")] * (len(v) > (rule.high or 1e9))
        if rule.kind in ("number", "integer") and number:
            out += [(at, "schema:minimum")] * (rule.low is not None and v < rule.low) + [(at, "schema:maximum")] * (rule.high is not None and v > rule.high)
    if depth == 1:
        _claim(x, path, out)
    for name, inner in schema.lists.items():
        if isinstance(x.get(name), list):
            out += [(f"{path}.{name}", payloads.CODES[name])] * (len(x[name]) > schema.most.get(name, 10**9)) if name in schema.most else []
            for i, item in enumerate(x[name]):
                _check(item, f"{path}.{name}[{i}]", inner, out, depth + 1)


def _expected(text, schema=payloads.CLAIMS):
    out = []
    try:
        x = json.loads(text)
    except (ValueError, TypeError):
        x = None
    _check(x, "$", schema, out)
    return sorted(out)


def test_claim_payloads_against_plain_python(spark):
    rows = {r["id"]: r["payload"] for r in Q.claim_payloads(spark, SF).collect()}
    got = {i: [] for i in rows}
    for r in Q.QUERIES["claim_payload_issues"](spark, SF).collect():
        got[r["id"]].append((r["path"], r["code"]))
    assert {i: sorted(v) for i, v in got.items()} == {i: _expected(t) for i, t in rows.items()}
    assert len({c for v in got.values() for _, c in v}) >= 13
    for r in Q.QUERIES["claim_payload_outcomes"](spark, SF).collect():
        want, out = _expected(rows[r["id"]]), json.loads(r["payload"])
        assert (r["used_fallback"], r["n_issues"], r["flags"]) == (bool(want), len(want), payloads.INVALID if want else "")
        if want:
            assert out["claims"] == [] and sorted((e["path"], e["code"]) for e in out["errors"]) == want
        else:
            assert out == json.loads(rows[r["id"]])


def test_checklists_and_odd_payloads(spark):
    head = {"schema_version": "evidence_checklist.v1", "market_id": "m", "generated_at": "t"}
    item = {"item_id": "i", "statement": "s" * 5000, "status": "supported", "sources": [{"url": "a", "stance": "no"}, {"url": " a "}], "resolution_aware": "yes"}
    texts = [json.dumps({**head, "items": []}), json.dumps({**head, "items": [item]}), None, "", "null", "{}"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, payload string").select("id", payloads.issues(F.col("payload"), payloads.CHECKLIST).alias("i"))
    got = {r["id"]: [(i["path"], i["code"]) for i in r["i"]] for r in df.collect()}
    assert got == {n: _expected(t, payloads.CHECKLIST) for n, t in enumerate(texts)}
    assert ("$.items[0].sources[1].url", "duplicate_source_url") in got[1] and got[0] == []


def test_stratified_takes_small_runs_whole_and_draws_alike(spark):
    rows = spark.range(200).select(F.when(F.col("id") < 5, "small").otherwise("large").alias("run"), F.when(F.col("id") != 7, F.col("id")).alias("market_id"), (F.col("id") % 3).cast("string").alias("bucket"), F.lit(None).cast("string").alias("category"))
    draw = lambda df: sorted((r["run"], r["market_id"], r["bucket"], r["category"]) for r in evaluation.stratified(df, 20, F.lit("s")).collect())
    first = draw(rows)
    assert [r[1] for r in first if r[0] == "small"] == list(range(5)) and sum(r[0] == "large" for r in first) == 20
    assert first == draw(rows.repartition(7).unionByName(rows)) and {r[3] for r in first} == {"unknown"}
    assert draw(rows.limit(0)) == []


def test_evaluation_of_versions_without_examples(spark):
    versions = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "version string")
    latest = spark.sql("SELECT * FROM VALUES ('a', 1L, TIMESTAMP_NTZ '2024-01-01'), ('b', 2L, TIMESTAMP_NTZ '2024-01-01') AS t(version, selection_run_id, decision_ts)")
    selected = spark.createDataFrame([(1, "t", None), (1, "t", "x"), (1, None, "x"), (2, None, "x")], "selection_run_id long, token_id string, ttr string")
    examples = spark.sql("SELECT 't' AS token_id, TIMESTAMP_NTZ '2024-01-01' AS t, 0.5D AS price_prob, 1 AS y, 0.5D AS p_b, 'missing_price' AS status")
    got = {r["version"]: r for r in evaluation.evaluate(versions, latest, selected, examples).collect()}
    assert {v: r["status"] for v, r in got.items()} == {"a": "ok", "b": "empty_selection", "c": "missing_selection"}
    a = got["a"]
    assert (a["n_tokens"], a["n_examples"], a["skipped_missing_price"], a["brier_a"], a["price_p50"], a["ttr_buckets"]) == (1, 0, 1, 0.0, 0.0, {"unknown": 1, "x": 1})


def test_book_probability_leaves_out_what_is_no_price(spark):
    from tidemark.operators import micro

    level = "array<struct<price:double,size:double>>"
    rows = [(1, [(1.5, 1.0), (0.4, 1.0), (-1.0, 1.0)], [(-0.2, 1.0), (0.6, 1.0)]), (2, [(float("nan"), 1.0), (0.0, 1.0)], [(0.6, 1.0)]), (3, [], [(0.5, 1.0)]), (4, None, None)]
    df = spark.createDataFrame(rows, f"id int, bids {level}, asks {level}")
    got = {r["id"]: r["p"] for r in df.select("id", micro.book_probability(F.col("bids"), F.col("asks")).alias("p")).collect()}
    assert got == {1: 0.5, 2: None, 3: None, 4: None}
