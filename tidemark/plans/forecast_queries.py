"""Registered queries of the fitted calibrators, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrators, scoring
from .queries import _FORECASTS, _forecasts, _rounded, _table


def _points(rows, keys):
    return rows.groupBy(*keys, "p").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("positives"))


def _isotonic(spark, sf_dir):
    return _rounded(calibrators.isotonic(_points(_forecasts(spark, sf_dir), ["lang"]), ["lang"]), "lower", "upper", "value")


def _platt(spark, sf_dir):
    return _rounded(calibrators.platt(_points(_forecasts(spark, sf_dir), ["lang"]), ["lang"]), "slope", "intercept")


def _group(c="doc_id"):
    """Most documents in one group, the others in small ones."""
    return F.greatest(F.col(c) % 10 - 6, F.lit(0)).alias("g")


def _switch(spark, sf_dir):
    rows = _forecasts(spark, sf_dir).withColumn("g", _group())
    docs = _table(spark, sf_dir, "documents").select("doc_id", _group(), ((F.col("n_chars") % 1000) / 999.0).alias("p"))
    got = calibrators.calibrated(_points(rows, ["g"]), docs.select("g", "p").distinct(), ["g"])
    return docs.join(got, ["g", "p"]).select("doc_id", "g", "kind", F.round("value", 6).alias("p_cal"))


def _forward(spark, sf_dir):
    rows = _forecasts(spark, sf_dir).select((F.col("doc_id") % 30).alias("t"), "doc_id", "p", "y")
    return calibrators.walk_forward(rows, ["doc_id"])


ENDS = ["p_cal", "low_50", "high_50", "low_90", "high_90"]


def _forward_report(spark, sf_dir):
    rows = _forward(spark, sf_dir).select("kind", F.explode(F.array(F.struct(F.lit("raw").alias("which"), "p"), F.struct(F.lit("calibrated").alias("which"), F.round("p_cal", 9).alias("p")))).alias("e"), "y").select("e.*", "y")
    return _rounded(scoring.report(rows, "which"), "brier", "log_loss", "ece", "mce").where("NOT overall").drop("overall")


QUERIES = {
    "isotonic_pools": _isotonic,
    "platt_fit": _platt,
    "calibrator_switch": _switch,
    "walk_forward": lambda s, d: _rounded(_forward(s, d).drop("p"), *ENDS),
    "walk_forward_report": _forward_report,
}


def _pools(h: str, key: str, name: str = "iso") -> str:
    """Isotonic pools of the counts h (key, p, n, s) by the max-min formula: {name}(key, lower, upper, n, positives, value)."""
    return f"""{name}_c AS (SELECT *, sum(n) OVER w AS cn, sum(s) OVER w AS cs FROM {h} WINDOW w AS (PARTITION BY {key} ORDER BY p)),
  {name}_m AS (SELECT a.{key}, a.p AS a, b.p, (b.cs - a.cs + a.s)::DOUBLE / (b.cn - a.cn + a.n)::DOUBLE AS m FROM {name}_c a JOIN {name}_c b ON a.{key} = b.{key} AND b.p >= a.p),
  {name}_l AS (SELECT {key}, p, min(m) OVER (PARTITION BY {key}, a ORDER BY p DESC) AS m FROM {name}_m), {name}_v AS (SELECT {key}, p, max(m) AS value FROM {name}_l GROUP BY ALL),
  {name} AS (SELECT {key}, min(p) AS lower, max(p) AS upper, sum(n)::BIGINT AS n, sum(s)::BIGINT AS positives, value FROM {name}_v JOIN {h} USING ({key}, p) GROUP BY {key}, value)"""


def _steps(h: str, key: str, name: str = "fit") -> str:
    """Platt's slope and intercept after 80 steps over the counts h (key, p, n, s)."""
    return f"""{name}_x AS (SELECT {key}, ln(q / (1 - q)) AS x, n, s FROM (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM {h})),
  {name}_i AS (SELECT {key}, 0 AS i, 1::DOUBLE AS slope, 0::DOUBLE AS intercept FROM (SELECT DISTINCT {key} FROM {h}) UNION ALL
    SELECT {key}, i + 1, slope - 0.2::DOUBLE * (ga / m + 0.001::DOUBLE * slope), intercept - 0.2::DOUBLE * gb / m FROM (SELECT i.{key}, i.i, any_value(slope) AS slope, any_value(intercept) AS intercept, sum(n) AS m,
      sum((n / (1 + exp(-(slope * x + intercept))) - s) * x) AS ga, sum(n / (1 + exp(-(slope * x + intercept))) - s) AS gb FROM {name}_i i JOIN {name}_x x ON i.{key} = x.{key} WHERE i.i < 80 GROUP BY ALL)),
  {name} AS (SELECT {key}, slope, intercept FROM {name}_i WHERE i = 80)"""


def _value(asked: str, key: str, n: str) -> str:
    """The calibrated values of asked (key, p, ...)."""
    return f"""(SELECT a.*, CASE WHEN {n} >= 30 THEN 'isotonic' ELSE 'platt' END AS kind, CASE WHEN {n} >= 30 THEN coalesce(o.value, (SELECT max(value) FROM iso z WHERE z.{key} = a.{key}))
    ELSE 1 / (1 + exp(-(coalesce(slope, 1) * ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))) + coalesce(intercept, 0)))) END AS value
    FROM {asked} a ASOF LEFT JOIN iso o ON a.{key} = o.{key} AND a.p <= o.upper LEFT JOIN fit ON a.{key} = fit.{key})"""


_BY_LANG = "h AS (SELECT lang, p, count(*) AS n, sum(y) AS s FROM f GROUP BY ALL)"
_FORWARD = f"""WITH RECURSIVE {_FORECASTS}, r AS (SELECT doc_id % 30 AS t, doc_id, p, y, row_number() OVER (ORDER BY doc_id % 30, doc_id) AS place FROM f), times AS (SELECT t AS j, min(place) - 1 AS n_train FROM r GROUP BY 1),
  h AS (SELECT j, p, count(*) AS n, sum(y) AS s FROM times JOIN r ON r.t < j GROUP BY ALL), hi AS (SELECT h.* FROM h JOIN times USING (j) WHERE n_train >= 30), lo AS (SELECT h.* FROM h JOIN times USING (j) WHERE n_train < 30),
  {_pools("hi", "j")}, {_steps("lo", "j")}, asked AS (SELECT DISTINCT j, p, n_train FROM times JOIN r ON r.t <= j), val AS {_value("asked", "j", "a.n_train")},
  late AS (SELECT j, abs(y - value) AS miss, count(*) OVER (PARTITION BY j) AS c, row_number() OVER (PARTITION BY j ORDER BY abs(y - value)) AS k FROM times JOIN r ON r.t < j JOIN val USING (j, p)
    WHERE place > times.n_train - least(greatest(20, ceil(times.n_train * 0.25::DOUBLE)), times.n_train)),
  wide AS (SELECT j, max(miss) FILTER (k = greatest(1, ceil(c * 0.5::DOUBLE))) AS q5, max(miss) FILTER (k = greatest(1, ceil(c * 0.9::DOUBLE))) AS q9 FROM late GROUP BY j),
  out AS (SELECT r.t, doc_id, r.p, y, val.n_train::BIGINT AS n_train, kind, value AS p_cal, coalesce(q5, 0.15) AS q5, coalesce(q9, 0.35) AS q9 FROM r JOIN val ON r.t = val.j AND r.p = val.p LEFT JOIN wide ON r.t = wide.j)"""
ORACLES = {
    "isotonic_pools": f"WITH {_FORECASTS}, {_BY_LANG}, {_pools('h', 'lang')} SELECT lang, round(lower, 6) AS lower, round(upper, 6) AS upper, n, positives, round(value, 6) AS value FROM iso",
    "platt_fit": f"WITH RECURSIVE {_FORECASTS}, {_BY_LANG}, {_steps('h', 'lang')} SELECT lang, round(slope, 6) AS slope, round(intercept, 6) AS intercept FROM fit",
    "calibrator_switch": f"""WITH RECURSIVE {_FORECASTS}, h AS (SELECT greatest(doc_id % 10 - 6, 0) AS g, p, count(*) AS n, sum(y) AS s FROM f GROUP BY ALL), sized AS (SELECT *, sum(n) OVER (PARTITION BY g) AS all_n FROM h),
  hi AS (SELECT * FROM sized WHERE all_n >= 30), lo AS (SELECT * FROM sized WHERE all_n < 30), {_pools("hi", "g")}, {_steps("lo", "g")},
  d AS (SELECT doc_id, greatest(doc_id % 10 - 6, 0) AS g, (n_chars % 1000) / 999.0 AS p, (SELECT max(all_n) FROM sized z WHERE z.g = greatest(documents.doc_id % 10 - 6, 0)) AS m FROM documents)
  SELECT doc_id, g, kind, round(value, 6) AS p_cal FROM {_value("d", "g", "coalesce(a.m, 0)")}""",
    "walk_forward": f"""{_FORWARD} SELECT t, doc_id, y, n_train, kind, round(p_cal, 6) AS p_cal, round(greatest(0, p_cal - q5), 6) AS low_50, round(least(1, p_cal + q5), 6) AS high_50,
  round(greatest(0, p_cal - q9), 6) AS low_90, round(least(1, p_cal + q9), 6) AS high_90 FROM out""",
    "walk_forward_report": f"""{_FORWARD}, x AS (SELECT 'raw' AS which, p, y FROM out UNION ALL SELECT 'calibrated', round(p_cal, 9), y FROM out), q AS (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS q, least(floor(p * 10), 9) AS bin FROM x),
  c AS (SELECT which, bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy, sum((p - y) * (p - y)) AS sb, sum(-(y * ln(q) + (1 - y) * ln(1 - q))) AS sl FROM q GROUP BY ALL),
  g AS (SELECT which, sum(n)::BIGINT AS n, sum(sb) / sum(n) AS brier, sum(sl) / sum(n) AS log_loss, sum(abs(sp - sy)) / sum(n) AS ece, max(abs(sp - sy) / n) AS mce FROM c GROUP BY ALL)
  SELECT which, n, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(ece, 6) AS ece, round(mce, 6) AS mce, concat_ws(',', CASE WHEN n < 40 THEN 'too_few' END, CASE WHEN ece > 0.08 THEN 'ece_too_high' END) AS gates FROM g""",
}
