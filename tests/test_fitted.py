"""Calibrators against plain Python."""

import math
import random

import pytest

from tidemark.operators import calibrators as C


def _pav(points):
    blocks = []
    for p, y in points:
        blocks.append([p, p, 1, y])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            a, z, n, s = blocks.pop()
            blocks[-1] = [blocks[-1][0], z, blocks[-1][2] + n, blocks[-1][3] + s]
    return [tuple(b) for b in blocks]


@pytest.mark.parametrize("parts", [1, 5, 16])
def test_pools_equal_the_sequential_ones_ties_included(spark, parts):
    rnd = random.Random(parts)
    rows = [(k, i, rnd.randint(0, 30) / 30, int(rnd.random() < 0.5)) for i in range(1200) for k in ([1] if i % 3 else [2])]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        src = spark.createDataFrame([(k, i, p, 1, y) for k, i, p, y in rows], "k int, i int, p double, n long, positives long")
        got = C.isotonic(src, ["k"], ["i"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for k in (1, 2):
        want = _pav([(p, y) for kk, i, p, y in sorted(rows, key=lambda r: (r[2], r[1])) if kk == k])
        assert sorted((r["lower"], r["upper"], r["n"], r["positives"]) for r in got if r["k"] == k) == sorted(want)


def test_platt_equals_a_loop(spark):
    rnd = random.Random(3)
    rows = [(k, 0.02 + 0.96 * rnd.random(), int(rnd.random() < 0.3 * k)) for k in (1, 2, 3) for _ in range(25 * k)]
    got = {r["k"]: r for r in C.platt(spark.createDataFrame([(k, p, 1, y) for k, p, y in rows], "k int, p double, n long, positives long"), ["k"]).collect()}
    for key in (1, 2, 3):
        xy = [(math.log(q / (1 - q)), y) for k, p, y in rows if k == key for q in [min(max(p, 1e-6), 1 - 1e-6)]]
        a, b = 1.0, 0.0
        for _ in range(80):
            e = [(1 / (1 + math.exp(-(a * x + b))) - y, x) for x, y in xy]
            a, b = a - 0.2 * (sum(d * x for d, x in e) / len(xy) + 1e-3 * a), b - 0.2 * sum(d for d, _ in e) / len(xy)
        assert abs(got[key]["slope"] - a) < 1e-9 and abs(got[key]["intercept"] - b) < 1e-9


def test_predictions_between_below_and_above_pools(spark):
    pools = spark.createDataFrame([(1, 0.1, 0.2, 2, 0, 0.0), (1, 0.3, 0.5, 2, 1, 0.5), (1, 0.7, 0.8, 1, 1, 1.0)], "k int, lower double, upper double, n long, positives long, value double")
    asked = spark.createDataFrame([(1, p) for p in (0.0, 0.2, 0.25, 0.5, 0.6, 0.8, 0.9, 7.0)] + [(2, 0.5)], "k int, p double")
    got = {(r["k"], r["p"]): r["value"] for r in C.predict_isotonic(asked, pools, ["k"]).collect()}
    assert got == {(1, 0.0): 0.0, (1, 0.2): 0.0, (1, 0.25): 0.5, (1, 0.5): 0.5, (1, 0.6): 1.0, (1, 0.8): 1.0, (1, 0.9): 1.0, (1, 7.0): 1.0, (2, 0.5): None}


def test_no_row_learns_from_its_own_time_or_later(spark):
    rnd = random.Random(9)
    rows = [(t, i, round(rnd.random(), 2), int(rnd.random() < 0.4)) for i in range(240) for t in [i // 24]]
    shape = "t int, i int, p double, y int"
    before = {r["i"]: r for r in C.walk_forward(spark.createDataFrame(rows, shape), ["i"]).collect()}
    # Outcomes from time 5 on are turned round: nothing up to time 5 may change, though much after it does.
    after = {r["i"]: r for r in C.walk_forward(spark.createDataFrame([(t, i, p, 1 - y if t >= 5 else y) for t, i, p, y in rows], shape), ["i"]).collect()}
    keep = ("n_train", "kind", "p_cal", "low_50", "high_50", "low_90", "high_90")
    assert len(before) == 240
    for t, i, p, _ in rows:
        same = all(before[i][c] == after[i][c] for c in keep)
        assert same if t <= 5 else True
        if t == 0:
            q = min(max(p, 1e-6), 1 - 1e-6)
            assert before[i]["n_train"] == 0 and abs(before[i]["p_cal"] - q) < 1e-12 and abs(before[i]["high_90"] - min(1, q + 0.35)) < 1e-12
    assert any(before[i]["p_cal"] != after[i]["p_cal"] for t, i, _, _ in rows if t > 5)
    assert {before[i]["kind"] for t, i, _, _ in rows if t == 1} == {"platt"} and {before[i]["kind"] for t, i, _, _ in rows if t > 1} == {"isotonic"}
