"""The first pass of the decontamination hashes a quarter of the blocks of a text, and misses no window of the benchmark."""

import pytest

pytest.importorskip("tidemark.llm.decontaminate")
from tidemark.llm import decontaminate as D


def test_each_window_holds_a_block_of_the_first_pass_at_any_place(spark):
    item = [f"it{i}" for i in range(D.WINDOW)]
    rows = [(n, " ".join([f"w{n}x{i}" for i in range(n)] + item + [f"z{n}x{i}" for i in range(3)])) for n in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    known = {r["h"] for r in D.block_hashes(bench, "item_id", "text", "o", ([], []), 1).collect()}
    got: dict[int, list[int]] = {}
    for r in D.block_hashes(docs, "doc_id", "text", "o", ([], [])).collect():
        got.setdefault(r["o"], []).append(r["h"])
    for n, text in rows:
        assert known & set(got[n]) and len(got[n]) <= len(text.split()) / D.BLOCK * 2
    assert {r["doc_id"] for r in D.flag(docs, bench).where("contaminated").collect()} == set(range(9))


def test_punctuation_goes_from_both_ends_of_words_as_btrim_takes_it(spark):
    words = ["(a)", "--", "a--b", "…“x-y”.", "--a--", "§", "a---------b!!", "‐a", "'tis", "«»x‹", "é,", "(", "3.5%", "°°1", "a…b…"]
    text = "\t " + " \n\x0b ".join(words) + "\r"
    df = spark.createDataFrame([(1, text)], "id long, text string")
    got = D._sequences(df, "id", "text", "o", False).select("r").first()["r"]
    bare = [w.strip(D.PUNCTUATION) for w in words]
    want = spark.createDataFrame([(w,) for w in bare if w], "w string").selectExpr("xxhash64(w) h").collect()
    assert got == [r["h"] for r in want]
