"""Keys of long sets: no similar pair without one in common, and far fewer of them than triples of a prefix."""

import random

import pytest

pytest.importorskip("tidemark.llm.setjoin")
from pyspark.sql import functions as F

from tidemark.llm import lines, setjoin


def test_similar_long_sets_share_a_key_and_keys_are_few(spark):
    rng = random.Random(3)
    rows, pairs = [], []
    for k in range(300):
        n = rng.choice([31, 32, 35, 39, 40, 41, 48, 49, 50, 51, 62, 63, 64, 80, 99, 100, 126, 300])
        a = [rng.getrandbits(56) for _ in range(n)]
        b = rng.sample(a, rng.randint(-(-n * 4 // 5), n)) + [rng.getrandbits(56) for _ in range(rng.randint(0, n // 4))]
        if 5 * len(set(a) & set(b)) >= 4 * len(set(a) | set(b)) and max(len(a), len(b)) >= setjoin.LONG:
            pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows), a), (len(rows) + 1, b)]
    df = spark.createDataFrame(rows, "cid long, s array<long>")
    keys = {r[0]: set(r[1]) for r in df.select("cid", setjoin.long_keys_of(F.col("s"), F.size("s")).alias("k")).collect()}
    assert len(pairs) > 60 and all(keys[a] & keys[b] for a, b in pairs)
    assert all(len(keys[i]) <= len(s) for i, s in rows if len(s) >= setjoin.LONG)
    assert not any(keys[i] for i, s in rows if len(s) < 32)


def test_classes_of_long_lines_of_frequent_words_have_few_keys(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "rarity_class", lambda n: 63)
    docs = spark.createDataFrame([(1, 0, " ".join(f"w{i}" for i in range(80)))], "id long, t long, text string")
    got = lines._classes(docs, lines._rarity(docs, "text"), 1).select(F.size("keys")).first()[0]
    assert got <= 80  # triples of its prefix are 969
