import duckdb
import pytest

from tidemark.plans import allocation_queries, claim_queries, evaluation_queries, feed_queries, forecast_queries, news_queries, payload_queries, registry_queries, sink_queries, source_queries
from tidemark.plans import market_queries as markets
from tidemark.plans import queries as plans

MODULES = (plans, markets, forecast_queries, sink_queries, allocation_queries, feed_queries, claim_queries, news_queries, source_queries, registry_queries, evaluation_queries, payload_queries)
QUERIES, ORACLES = {k: v for m in MODULES for k, v in m.QUERIES.items()}, {k: v for m in MODULES for k, v in m.ORACLES.items()}

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "orders", "lineitem", "events", "documents", "labels", "part", "pages", "benchmark")


def _rows(frame):
    cols = sorted(frame.columns)
    return sorted(map(str, frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert _rows(QUERIES[name](spark, SF).toPandas()) == _rows(con.sql(ORACLES[name]).df())


def test_asof_gate_and_ties(spark):
    from tidemark.operators.asof import asof_join

    rows = spark.sql("""SELECT * FROM VALUES (1, 10L, TIMESTAMP_NTZ '2024-01-01 10:00:00', TIMESTAMP_NTZ '2024-01-01 10:05:00', 'bound'),
        (1, 11L, TIMESTAMP_NTZ '2024-01-01 10:00:00', TIMESTAMP_NTZ '2024-01-01 10:05:01', 'late') AS r(k, id, event_ts, ingested_at, v)""")
    spine = spark.sql("SELECT 1 AS k, TIMESTAMP_NTZ '2024-01-01 10:00:00' AS t UNION ALL SELECT 1, TIMESTAMP_NTZ '2024-01-01 09:59:59' UNION ALL SELECT 2, TIMESTAMP_NTZ '2024-01-01 10:00:00'")
    got = {(r["k"], r["t"].second): r["v"] for r in asof_join(spine, rows, "k", "id", ["v"]).collect()}
    assert got == {(1, 0): "bound", (1, 59): None, (2, 0): None}


def test_asof_lets_no_row_without_times_or_key_through(spark):
    from tidemark.operators.asof import asof_join

    rows = spark.sql("""SELECT * FROM VALUES (1, 10L, TIMESTAMP_NTZ '2024-01-01 10:00:00', CAST(NULL AS TIMESTAMP_NTZ), 'unknown'),
        (2, 11L, CAST(NULL AS TIMESTAMP_NTZ), TIMESTAMP_NTZ '2024-01-01 09:00:00', 'unknown'),
        (CAST(NULL AS INT), 12L, TIMESTAMP_NTZ '2024-01-01 09:00:00', TIMESTAMP_NTZ '2024-01-01 09:00:00', 'no key') AS r(k, id, event_ts, ingested_at, v)""")
    spine = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ '2024-01-02 00:00:00'), (2, TIMESTAMP_NTZ '2024-01-02 00:00:00'), (CAST(NULL AS INT), TIMESTAMP_NTZ '2024-01-02 00:00:00') AS s(k, t)")
    assert [r["v"] for r in asof_join(spine, rows, "k", "id", ["v"]).collect()] == [None] * 3


def test_calibration_averages_clamped_probabilities(spark):
    from tidemark.operators.scoring import calibration

    got = {r["bin"]: r["mean_p"] for r in calibration(spark.createDataFrame([(1.5, 1.0), (0.95, 1.0), (-0.5, 0.0)], "p double, y double")).collect()}
    assert abs(got[9] - 0.975) < 1e-12 and got[0] == 0.0


def test_asof_carries_rows_over_spans_of_time(spark):
    from tidemark.operators.asof import asof_many

    day = "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(cast(id AS int))"
    rows = spark.range(0, 400, 37).selectExpr("1 AS k", "id", f"{day} AS event_ts", f"{day} + INTERVAL 2 DAYS AS ingested_at", "id * 10 AS v")
    spine = spark.range(400).selectExpr("1 AS k", f"{day} AS t").unionByName(spark.sql("SELECT 1 AS k, CAST(NULL AS TIMESTAMP_NTZ) AS t"))
    for split in (86400, 7 * 86400, 10**9):
        got = asof_many(spine, {"now": (rows, "id", ["v"], 0), "before": (rows, "id", ["v"], 10 * 86400)}, "k", 0, split)
        for r in got.selectExpr("datediff(t, '2024-01-01') AS d", "now.v AS now", "before.v AS before").collect():
            last = lambda d: None if d is None or d < 0 else d // 37 * 370
            assert (r["now"], r["before"]) == (last(None if r["d"] is None else r["d"] - 2), last(None if r["d"] is None else r["d"] - 10))


def test_articles_are_prepared_once(spark, tmp_path):
    """The hashes of an article are made for one table that all steps read, not again for the last one."""
    from pyspark.sql import functions as F

    from tidemark.operators import dedupe

    rows = spark.sql("SELECT id AS n, id, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS published_at, 'd' AS domain, concat('u', id DIV 2) AS url FROM range(6)")
    source = f"{tmp_path}/articles"
    rows.write.parquet(source)
    a = spark.read.parquet(source).withColumns({"content_hash": F.sha2("url", 256), "title_hash": F.lit(None).cast("string")})
    got = dedupe.outcomes(a)
    assert not any(f.startswith(f"file://{source}") for f in got.inputFiles())
    assert sorted((r["n"], r["article_id"]) for r in got.collect()) == [(i, i // 2 * 2) for i in range(6)]


def test_claims_join_the_first_alike_cluster(spark):
    """Blank texts are alike, a shorter text takes over, null texts are empty."""
    from tidemark.operators import claims

    rows = [(1, 4, "a b c d", "2024-01-01", "x"), (1, 2, "A, b c!", "2024-01-02", "x"), (1, 9, None, None, None), (1, 3, "!", None, None), (1, 5, "c d e f g", "2024-01-03", "x"), (2, 1, "a b c d", "2024-01-01", "x"), (None, 7, "a", None, None)]
    d = spark.createDataFrame(rows, "market_id long, claim_id long, text string, published_at string, domain string")
    got = sorted((r["market_id"], r["cluster_id"], r["claim_ids"], r["representative_id"], r["representative_text"]) for r in claims.clusters(d).collect())
    assert got == [(1, 1, [2, 4], 2, "A, b c!"), (1, 2, [5], 5, "c d e f g"), (1, 3, [3, 9], 9, ""), (2, 1, [1], 1, "a b c d")]
    assert "MapInArrow" in claims.clusters(d)._jdf.queryExecution().executedPlan().toString()
