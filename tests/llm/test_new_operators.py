"""Operators 11 to 13 against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import hardnegatives, prefixtrie, queries, sumsquares

SF = "/root/testdata/sf0.001"


# Operator 11


def _tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def _holds(rows, texts, capacity=1024):
    """Pieces tile every text, windows are filled without gaps, and no window needs padding."""
    tok, ids = _tokenizer(), {}
    for i, t in texts:
        ids.setdefault(i, []).append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_window.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for i, want in ids.items():
        got = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc[i])
        if len(want) == 1:
            at = 0
            for start, length, crc, total in got:
                assert (start, total) == (at, len(want[0])) and crc == zlib.crc32(want[0][start : start + length].tobytes())
                at += length
            assert at == len(want[0])
        else:
            assert sum(n for _, n, _, _ in got) == sum(map(len, want))
    for w in by_window.values():
        at = 0
        for r in sorted(w, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)


def test_packing_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    _holds(queries.op11_sum_of_squares(spark, SF).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_packing_of_odd_rows(spark):
    rows = [(1, None, "a", 5), (2, "", "b", 5), (None, "no id", "c", 5), (3, "twice", "d", 5), (3, "twice", "d", 5), (4, "long " * 9000, "e", 5), (5, "<|endoftext|> x", "f", 5), (6, "x" * 5000, "g", 5), (7, "é́ 漢字 🙂  \x85", "h", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, members string, offset int")
    _holds(sumsquares.pack_documents(docs).collect(), [r[:2] for r in rows])
    assert sumsquares.pack_documents(docs.limit(0)).collect() == []


def test_ids_are_the_tokenizers(spark):
    import public_tokenizers

    enc, tok = sumsquares.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")), _tokenizer()
    rnd = random.Random(5)
    parts = ["the", "Éionier", "Straße", " ", "  ", "\n\n", "\t", "12", "3.5", "'s", "n't", "\xa0", "—", "漢字", "привет", "Ελλάς", "ŀ", "²", "x́", "_", "don't", "<|", "€5", "ß", "İ", "\x1c", "ǅ", "ª"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert enc.encode(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_level_minimises_the_sum_of_squares():
    rnd = random.Random(1)
    levels = sumsquares.Levels(32)
    for _ in range(3000):
        size = rnd.choice([3, 5, 8, 11, 13, 20, 31])
        n = levels.counts.copy()
        options = {}
        for h in [0, *np.flatnonzero(n[:32]).tolist()]:
            if h + size <= 32:
                m = n.copy()
                m[h] -= h > 0
                m[h + size] += h + size < 32
                options[h] = int((m[1:32] ** 2).sum())
        best = min(options.values())
        assert options[levels.level(size)] == best
        levels.add(size, [(0, 0, size, 0, size)], b"\0" * 4 * size)
        assert levels.open == levels.counts[1:].sum() == sum(map(len, levels.windows))


# Operator 12


def _mined(rows, low=30, high=90, k_pos=5, k_neg=10):
    kept = [(r, i, label, [int(np.floor(256 * float(x))) for x in v]) for r, (i, label, v, _) in enumerate(rows) if None not in (i, label, v) and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {r for r, x in enumerate(rows) if x[3]}
    out = []
    for r, i, label, v in kept:
        if r not in anchors:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, q, m == label) for q, j, m, w in kept if q != r]
        for s, p, _, _ in sorted(x for x in scored if x[3])[:k_pos]:
            fits = sorted(x for x in scored if not x[3] and low * -s <= 100 * -x[0] <= high * -s)[:k_neg]
            out += [(i, p, n, j, -s, -t) for n, (t, j, _, _) in enumerate(fits, 1)]
    return sorted(out)


def _rows(seed, n, dims, ids=None):
    rnd = random.Random(seed)
    return [(k if ids is None else rnd.choice(ids), rnd.randint(0, 3), [rnd.choice([-0.5, -0.1, 0.0, 0.3, 0.7]) for _ in range(dims)], k % 7 == 0) for k in range(n)]


@pytest.mark.parametrize("seed,n,dims,cell", [(1, 400, 3, 40), (2, 300, 8, 1000), (3, 60, 1, 10)])
def test_negatives_with_ties(spark, seed, n, dims, cell):
    rows = _rows(seed, n, dims)
    got = hardnegatives.mine(spark.createDataFrame(rows, "id long, label int, v array<float>, anchor boolean"), cell_rows=cell)
    assert sorted(map(tuple, got.collect())) == _mined([(i, m, np.float32(v).tolist(), a) for i, m, v, a in rows])


def test_negatives_of_odd_rows(spark):
    base = _rows(4, 120, 4)
    odd = [(None, 1, [0.1] * 4, True), (1000, None, [0.1] * 4, True), (1001, 1, None, True), (1002, 1, [0.1, None, 0.1, 0.1], True), (1003, 1, [0.1, float("nan"), 0.1, 0.1], True), (1004, 1, [0.1, float("inf"), 0.1, 0.1], False), (1005, 1, [0.7, 0.7], True), (1006, 2, [], True), (1007, 0, [0.3] * 4, None)]
    twice = [base[0], base[0], base[7], (base[3][0], base[5][1], base[3][2], False)]
    rows = base + odd + twice
    want = _mined(rows)
    got = hardnegatives.mine(spark.createDataFrame([(*x, "r", 5) for x in rows], "id long, label int, v array<double>, anchor boolean, cell string, q int"), cell_rows=30)
    assert sorted(map(tuple, got.collect())) == want
    empty = spark.createDataFrame([], "id long, label int, v array<double>, anchor boolean")
    assert hardnegatives.mine(empty).collect() == []


def test_boxes_are_pruned_and_no_row_is_lost():
    rng = np.random.default_rng(0)
    v = rng.integers(-200, 200, (2000, 3))
    tiles = list(hardnegatives.tiles(v))
    assert sorted(np.concatenate(tiles).tolist()) == list(range(2000)) and max(map(len, tiles)) <= hardnegatives.LEAF
    leaves = [{"n": len(t), "lo": v[t].min(0).tobytes(), "hi": v[t].max(0).tobytes(), "vectors": v[t].tobytes(), "labels": np.zeros(len(t), np.int64).tobytes(), "ids": t.astype(np.int64).tobytes(), "rows": t.astype(np.int64).tobytes()} for t in tiles]
    tree, seen = hardnegatives.Tree(leaves), []
    a = rng.integers(-200, 200, 3)
    got = tree.search(a, np.array([-(2**62)]), np.array([2**62]), 5, lambda leaf: seen.append(1) or np.ones(len(leaf["ids"]), bool))[0]
    assert [i for _, i, _ in got] == sorted(range(2000), key=lambda i: (-int(v[i] @ a), i))[:5] and len(seen) < len(tiles) / 2
    big = np.array([2**26, -(2**26), 2**26])
    assert tree.search(big, np.array([-(2**62)]), np.array([2**62]), 1, lambda leaf: np.ones(len(leaf["ids"]), bool))[0][0][0] == -max(int(x @ big) for x in v)


# Operator 13


def _trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            key = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, key, (role or "", text or "")))
    convs = {c: [x[3] for x in sorted(t)] for c, t in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    nodes = {}
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            nodes.setdefault(tuple(rebuilt[c][:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in members if len(rebuilt[c]) == len(path))
        out.append((members[0], len(path), nodes[path[:-1]][0] if path else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block,shard", [(1, 3), (2, 4), (3, 100), (256, 4096)])
def test_trie_in_blocks_and_shards(spark, block, shard):
    rnd = random.Random(block)
    rows = [(c, t if rnd.random() < 0.9 else None, rnd.choice(["user", "assistant", None]), rnd.choice(["é", "b", "", None])) for c in range(0, 60) for t in range(rnd.choice([1, 2, 3, 5, 12])) if c % 11]
    rows += [(c, 0, "user", "only") for c in (100, 105, 107)] + [(200, t, "user", "same") for t in range(40)] + [(203, t, "user", "same") for t in range(40)]
    got = prefixtrie.trie(spark.createDataFrame(rows, CONVERSATIONS).repartition(3), block, shard)
    assert sorted(map(tuple, got.collect()), key=str) == _trie(rows)


def test_trie_of_odd_tables(spark):
    rows = [(None, 0, "user", "x"), (7, None, None, None), (7, None, None, None), (7, 1, "a", "long " * 20000), (7, 1, "a", "long " * 20000), (8, 5, "", "")]
    wide = spark.createDataFrame([(*r, "n", 1) for r in rows], CONVERSATIONS + ", name string, depth int")
    assert sorted(map(tuple, prefixtrie.trie(wide).collect()), key=str) == _trie(rows)
    assert prefixtrie.trie(wide.limit(0)).collect() == []
    assert prefixtrie.trie(wide.where("conv_id IS NULL")).collect() == []
