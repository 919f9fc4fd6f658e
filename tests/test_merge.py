"""Merged tables and owners of tokens."""

import random

import pytest

from tidemark.sinks.merge import MergeTable, TokenOwners

SHAPE = "token int, seq int, ingested_at long, price double"


def _table(spark, path, **more):
    schema = spark.createDataFrame([], SHAPE).schema
    return MergeTable(spark, f"file://{path}", schema, ["token", "seq"], ["ingested_at"], buckets=5, **more)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_order_and_replays_do_not_matter(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 9), rnd.choice([None, 1, 2]), rnd.randint(0, 20), rnd.choice([0.25, 0.5])) for _ in range(200)]
    batches = [rows[a : a + 50] for a in range(0, 200, 50)]
    best = {}
    for r in rows:
        best[r[:2]] = max(best.get(r[:2], r), r, key=lambda x: x[2:])
    for k, order in enumerate(([0, 1, 2, 3], [3, 1, 1, 0, 2, 3])):
        t = _table(spark, tmp_path / str(k))
        for b in order:
            t.merge(spark.createDataFrame(batches[b], SHAPE))
        assert _rows(t.read()) == sorted(best.values(), key=str)
    assert t.vacuum() > 0 and _rows(t.read()) == sorted(best.values(), key=str)


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = _table(spark, tmp_path)
    t.merge(spark.createDataFrame([(k, 1, 1, 0.5) for k in range(40)], SHAPE))
    before = t.version()[1]
    t.merge(spark.createDataFrame([(3, 1, 2, 0.75)], SHAPE))
    number, after = t.version()
    assert number == 2 and sum(before[b] != after[b] for b in after) == 1 and t.read().count() == 40
    assert t.merge(spark.createDataFrame([], SHAPE)) == 2


def test_an_unfinished_or_rival_merge_is_not_seen(spark, tmp_path):
    t = _table(spark, tmp_path)
    t.merge(spark.createDataFrame([(1, 1, 1, 0.5)], SHAPE))
    (tmp_path / "versions" / "0000000002").write_text("0\tdata/none/_bucket=0\n")  # has no end mark
    assert _rows(t.read()) == [(1, 1, 1, 0.5)]
    with pytest.raises(Exception, match="exist"):
        t.merge(spark.createDataFrame([(1, 1, 2, 0.75)], SHAPE))
    assert _rows(t.read()) == [(1, 1, 1, 0.5)]


def test_first_writer_and_ties(spark, tmp_path):
    t = _table(spark, tmp_path, first=True)
    for rows in ([(1, 1, 5, 0.5), (2, 1, 4, 0.5)], [(1, 1, 3, 0.9), (2, 1, 4, 0.25)]):
        t.merge(spark.createDataFrame(rows, SHAPE))
    assert _rows(t.read()) == [(1, 1, 3, 0.9), (2, 1, 4, 0.25)]


def test_first_owner_keeps_a_token(spark, tmp_path):
    shape = "market_id string, outcome string, token_id string, at long"
    claims = [("m1", "YES", "a", 1), ("m2", "YES", "a", 2), ("m1", "NO", "b", 1), ("m1", "YES", "c", 5), ("m3", "YES", "c", 4), ("m2", "NO", None, 1)]
    want = ([("m1", "NO", "b"), ("m1", "YES", "a"), ("m3", "YES", "c")], [("m1", "YES", "c", "m3", "YES"), ("m2", "YES", "a", "m1", "YES")])
    for k, order in enumerate(([0, 1, 2, 3, 4, 5], [3, 1, 5, 0, 4, 2, 1])):
        o = TokenOwners(spark, f"file://{tmp_path}/{k}", spark.createDataFrame([], shape).schema, buckets=3)
        for i in order:
            o.merge(spark.createDataFrame([claims[i]], shape))
        assert (_rows(o.tokens()), _rows(o.conflicts())) == want
