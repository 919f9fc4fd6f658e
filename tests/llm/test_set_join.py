"""What the line join writes, and that nothing similar is lost where lines share most of their words."""

import random

import pytest

pytest.importorskip("tidemark.llm.lines")
from tidemark.llm import lines


def test_line_join_writes_no_rows_of_keys(spark, monkeypatch):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    made = [rng.sample(vocabulary, 20) for _ in range(200)]
    for k in range(200):
        line = list(made[k % 3 if k < 120 else k])
        line[rng.randrange(20)] = f"new{k}"
        made.append(line)
    rng.shuffle(made)
    docs = spark.createDataFrame([(i, "\n".join(" ".join(w) for w in made[4 * i : 4 * i + 4])) for i in range(100)], "doc_id long, text string")
    seen, want = [], {}
    for i, w in enumerate(made):
        s = frozenset(w)
        want[i // 4] = want.get(i // 4, 0) + any(5 * len(s & t) >= 4 * len(s | t) for t in seen)
        seen.append(s)
    rows = {}

    def counted(df, name, put=lines.written):
        out = put(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(lines, "written", counted)
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(docs).collect()}
    assert got == want and sum(want.values()) > 150
    # 400 lines have about 2,000 keys, nearly all of them shared by many lines.
    assert all(n <= 400 for name, n in rows.items() if name != "candidates") and rows["candidates"] <= 4 * 400
