"""Keys of the line join: no similar pair without one in common, and their number follows that of the words only."""

import random
from collections import Counter, defaultdict

import pytest

pytest.importorskip("tidemark.llm.setjoin")
from tidemark.llm import setjoin

SIZES = [4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 15, 18, 19, 23, 24, 29, 30, 37, 38, 47, 48, 59, 60, 74, 75, 93, 94, 117, 118, 300, 1020, 1100]


def keys_of(spark, rows):
    df, out = spark.createDataFrame(rows, "cid long, keys array<int>"), defaultdict(set)
    for part in range(setjoin.PARTS):
        for key, cid in setjoin.share_rows(df, part, "cid").collect():
            out[cid].add((part, key))
    return out


@pytest.mark.parametrize("rare", [0, 0.15, 0.6])
def test_similar_sets_share_a_key(spark, rare):
    rng = random.Random(5)
    number = lambda: 2 * rng.getrandbits(30) + (rng.random() < rare)
    rows, pairs = [], []
    for n in SIZES * 12:
        a = [number() for _ in range(n)]
        b = rng.sample(a, rng.randint(-(-n * 4 // 5), n)) + [number() for _ in range(rng.randint(0, n // 4))]
        if 5 * len(set(a) & set(b)) >= 4 * len(set(a) | set(b)):
            pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows), sorted(a)), (len(rows) + 1, sorted(b))]
    keys = keys_of(spark, rows)
    assert len(pairs) > 150 and all(keys[a] & keys[b] for a, b in pairs)
    assert sum(map(len, keys.values())) < 2 * sum(len(s) for _, s in rows)


def test_sets_that_share_frequent_words_only_seldom_meet(spark):
    """Every set has all of 20 frequent words: keys of a few of them would let all pairs meet under each."""
    rng = random.Random(6)
    frequent = [2 * rng.getrandbits(30) for _ in range(20)]
    rows = [(i, sorted(rng.sample(frequent, 12) + [2 * rng.getrandbits(30) + 1 for _ in range(28)])) for i in range(1000)]
    met = Counter(k for keys in keys_of(spark, rows).values() for k in keys)
    assert sum(m * (m - 1) // 2 for m in met.values()) < 20_000  # of 499,500 pairs
