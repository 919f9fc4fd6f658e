"""The feed's state in batch and stream, and dates in texts."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.plans.feed_queries import feed_rows
from tidemark.streaming import feed, reconcile

SF = "/root/testdata/sf0.001"
S = 1_000_000
SHAPE = "token string, n long, kind string, at long, seq long, mid double, rest_seq long, rest_at long, rest_n long, book_at long"


def _trade(n, at, seq):
    return ("a", n, "trade", at * S, seq, None, None, None, None, None)


def _rest(n, at, seq=None, mid=None):
    return ("a", n, "rest", at * S, None, mid, seq, None, 2, None)


def _reasons(spark, rows, **args):
    got = reconcile.reconciled(spark.createDataFrame(rows, SHAPE), **args).orderBy("n").collect()
    return [(r["reasons"], r["repaired"]) for r in got]


def test_each_reason(spark):
    assert _reasons(spark, [_rest(1, 0), _trade(2, 10, 1), _rest(3, 20, 2), _rest(4, 21, 3), _trade(5, 22, 4), _trade(6, 21, 6), _rest(7, 30)]) == [
        ("heuristic_reconcile_tick", True), ("", False), ("rest_seq_ahead", True), ("timestamp_regression,sequence_gap", True)
    ]
    assert _reasons(spark, [_trade(1, 10, None), _rest(2, 70), _rest(3, 71)]) == [("", False), ("heuristic_trade_stale", True)]
    assert _reasons(spark, [_trade(1, 10, 5), _trade(2, 11, 9), _rest(3, 12)], sequences=False) == [("", False)]
    book = ("a", 1, "book", 5 * S, None, 100.0, None, None, None, None)
    assert _reasons(spark, [book, _trade(2, 6, 1), _rest(3, 7, None, 100.05), _rest(4, 8, None, 101.0), _rest(5, 9, None, 101.0)]) == [("", False), ("", True), ("", False)]


def test_a_restarted_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    rows = feed_rows(spark, SF)
    want = sorted(map(str, reconcile.reconciled(rows, gap_seconds=86400).collect()))
    assert len({r for w in want for r in ("timestamp_regression", "sequence_gap", "rest_seq_ahead", "heuristic_trade_stale") if r in w}) == 4
    cut = rows.approxQuantile("n", [0.25, 0.5, 0.75], 0.0)
    ends = [-1, *cut, 10**12]
    for k in range(4):
        # Each part is written once, and the query is started anew for each: only its checkpoint carries the state over.
        rows.where((F.col("n") > ends[k]) & (F.col("n") <= ends[k + 1])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = reconcile.reconciled(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), gap_seconds=86400)
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == want


def test_streams_deduplicate_and_count_as_batches_do(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_type").alias("channel"), F.col("user_id").alias("token"), F.col("ts").cast("timestamp").alias("ts"))
    twice = e.unionByName(e.where("token % 3 = 0"))
    key = ["channel", "token", "ts"]
    want = feed.throughput(feed.deduplicated(e, key, "ts"), "ts", "1 day").drop("tokens")
    twice.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(twice.schema).parquet(str(tmp_path / "in"))
    q = feed.deduplicated(src, key, "ts", "60 days").groupBy("channel").count().writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("seen").collect())) == sorted(map(tuple, want.groupBy("channel").agg(F.sum("messages")).collect()))


CASES = [
    ("Ends 2026-03-01.", "2026-03-01"), ("by 2026_12/31 or so", "2026-12-31"), ("March 7, 2026", "2026-03-07"), ("on 7 MARCH 2026", "2026-03-07"), ("March 7 2026 and 2027-01-01", "2027-01-01"),
    ("by june 20", "2023-06-20"), ("by june 15", "2024-06-15"), ("1 january", "2024-01-01"), ("february 30", None), ("31 april 2026", None), ("2026-02-30", None), ("february 29", None), ("maybe 7", None), ("", None), (None, None), ("march 77", None),
]


def test_dates_in_text(spark):
    df = spark.createDataFrame(CASES, "t string, want string")
    now = F.expr("TIMESTAMP '2023-06-15 12:00:00'")
    got = df.select("t", "want", F.date_format(dates.date_in_text(F.col("t"), now), "yyyy-MM-dd").alias("got")).collect()
    assert [(r["t"], r["got"]) for r in got] == [(r["t"], r["want"]) for r in got]
    assert df.where("t = 'by june 20'").select(dates.date_in_text(F.col("t")).alias("d")).first()["d"] is None


@pytest.mark.parametrize("text,want", [("1700000000", 1700000000), ("1700000000000", 1700000000), ("1700000000.5", 1700000000), ("-5", None), ("0", None), ("2024-01-01T00:00:00Z", 1704067200), ("2024-01-01 01:00:00+01:00", 1704067200), ("2024-01-01", 1704067200), ("2024", 2024), ("soon", None), ("99999999999999999999", None), ("2024-13-01", None)])
def test_instants(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.unix_seconds(dates.instant(F.col("t"))).alias("s")).first()["s"] == want
