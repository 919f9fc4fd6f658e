"""Inverted lists read by blocks and as wholes."""

import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tidemark.llm.toxicity")
from tidemark.llm import toxicity


def test_lists_are_read_at_once_where_few_blocks_fall_away(monkeypatch):
    rng = random.Random(2)
    made = [Counter(f"t{int(rng.paretovariate(0.6)) % 400}" for _ in range(60)) for _ in range(1400)]
    labels = np.array([rng.random() < 0.1 for _ in made], int)
    terms = [w for c in made for w in c]
    index = toxicity.Index(list(range(len(made))), labels, terms, np.repeat(np.arange(len(made)), [len(c) for c in made]), np.array([float(v) for c in made for v in c.values()]))
    queries = [*made[:20], *[Counter(rng.choices(terms, k=50)) for _ in range(20)], Counter(), Counter(["unknown"])]
    parts = []
    monkeypatch.setattr(toxicity.Index, "part", lambda self, take, *rest, f=toxicity.Index.part: parts.append(len(take)) or f(self, take, *rest))
    got, read = [index.nearest(c, i) for i, c in enumerate(queries)], len(parts)
    monkeypatch.setattr(toxicity, "WHOLE", 2)  # by blocks alone
    want, by_blocks = [index.nearest(c, i) for i, c in enumerate(queries)], len(parts) - read
    assert all((a == c).all() and (b == d).all() for (a, b), (c, d) in zip(got, want, strict=True))
    assert index.blocks > 20 and read <= 2 * len(queries) < by_blocks
