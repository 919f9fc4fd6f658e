import math
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, lines, mixing, packing, pii, quality, simhash, substrings, toxicity, url_lists

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", None, 0), (3, "  \n\n ", "en", "a", 4), (4, long, "en", "a", 1), (5, long, "en", "a", 1), (6, "one", None, "a", 3)]
    return spark.createDataFrame(rows, SCHEMA)


def test_packing_whole_and_tight(docs):
    x = packing.pack_documents(docs).toPandas()
    sums = x.groupby("sequence_id").length.sum()
    assert sums.max() <= 4096 and len(sums) <= -(-sums.sum() // 4096) + 1
    y = x.sort_values(["sequence_id", "offset"])
    assert (y.groupby("sequence_id").length.cumsum() - y.length == y.offset).all()
    assert x.groupby("doc_id").length.sum().size == docs.count()


def test_simhash_against_all_pairs(docs):
    got = [(r["id"], r["f"], r["component"]) for r in simhash.groups(docs).collect()]
    up = {i: i for i, _, _ in got}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, (a, f, _) in enumerate(got):
        for b, g, _ in got[:i]:
            if ((f ^ g) & (1 << 64) - 1).bit_count() <= 3:
                p, q = sorted((find(a), find(b)))
                up[q] = p
    assert all(find(i) == c for i, _, c in got)


def test_simhash_hash_is_sparks(spark):
    want = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert simhash.fingerprint("A b C") == want & (1 << 64) - 1


def test_lines_against_brute_force(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen, want = [], {}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        for line in (r["text"] or "").split("\n"):
            s = frozenset(WORD.findall(line.translate(low)))
            if len(s) >= 5:
                want[r["doc_id"]] = want.get(r["doc_id"], 0) + any(5 * len(s & t) >= 4 * len(s | t) for t in seen)
                seen.append(s)
    got = lines.dedup_lines(docs).collect()
    assert all(r["n_removed"] == want.get(r["doc_id"], 0) for r in got) and sum(want.values()) > 0


def test_substrings_against_brute_force(docs):
    seen, want = set(), {}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        w = WORD.findall(r["text"] or "")
        hit = [False] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                hit[i : i + 20] = [True] * 20
            seen.add(k)
        want[r["doc_id"]] = " ".join(x for x, h in zip(w, hit, strict=True) if not h)
    assert {r["id"]: r["kept"] for r in substrings.remove_repeats(docs).collect()} == want


def test_decontamination_finds_copies_and_new_parameters(spark):
    bench = spark.createDataFrame([(1, "A train from Boston travels 60 km in 2 hours and then stops at Boston for 15 minutes")], "item_id long, text string")
    rows = [(1, "Intro here. A train from Paris travels 80 km in 3 hours and then stops at Paris for 10 minutes"), (2, "nothing of that kind is in this text at all, it only speaks of the weather"), (3, None), (4, "A train from Paris travels 80 km in 3 hours and then stops at London for 10 minutes")]
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.flag(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_pii_checksums_and_context():
    kinds = lambda t: [s[0] for s in pii.find(t)[0]]
    assert kinds("card 4111 1111 1111 1111") == ["card"] and kinds("card 4111 1111 1111 1112") == []
    assert kinds("IBAN DE89 3704 0044 0532 0130 00") == ["iban"] and "iban" not in kinds("IBAN DE88 3704 0044 0532 0130 00")
    assert kinds("IBAN BE68 5390 0754 7034 PAID") == ["iban"] and kinds("IBAN BE68 5390 0754 7034 12") == ["iban"]
    assert kinds("ssn 123-45-6789") == ["national_id"] and kinds("part 123-45-6789") == []


def test_url_list_intervals(spark):
    e = spark.createDataFrame([("bad.example.com", 10, True), ("bad.example.com", 20, False)], "key string, ts long, listed boolean")
    c = spark.createDataFrame([(i, "http://x.Bad.example.com/a", t) for i, t in enumerate((9, 10, 19, 20))] + [(4, None, 15)], "page_id long, url string, fetch_ts long")
    assert {r["id"]: r["blocked"] for r in url_lists.apply(c, e).collect()} == {0: False, 1: True, 2: True, 3: False, 4: False}


def test_mixing_beats_uniform_and_keeps_base(docs):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = mixing.score(docs, held).toPandas()
    assert len(got) == docs.count() and got[got.held_out].bits_per_byte.mean() < 3.5 and (got.score < 0).all()


def test_toxicity_held_out(docs, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    got = toxicity.score(docs, toxicity.fit(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))).toPandas()
    assert got.score.between(0, 1).all() and len(got) == docs.count()


def test_toxicity_neighbours_against_brute_force(docs, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    ix = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    def vector(text):
        v = {}
        for t, n in toxicity._counts(text).items():
            v[t] = (1 + math.log(n)) * (ix.weight[ix.number[t]] if t in ix.number else ix.unseen)
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    known = [vector(texts[i]) for i in ix.names]
    for text in [*list(texts.values())[:60], None, "", "only words unseen before: zzzyq"]:
        q = vector(text)
        want = sorted(((sum(x * v.get(t, 0) for t, x in q.items()), -d) for d, v in enumerate(known)), key=lambda p: (-round(p[0], 9), -p[1]))
        want = [c for c, _ in want if c > 0][: toxicity.K]
        best, cosine = ix.nearest(toxicity._counts(text))
        assert np.allclose(cosine, want) and len(best) == len(want)


def test_toxicity_without_labels(odd, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {round(r["score"], 6) for r in toxicity.score(odd, toxicity.fit(odd, none)).collect()} == {round(1 / (1 + math.exp(-(6 * 0.1 - 3))), 6)}


@pytest.mark.parametrize("empty", [True, False])
def test_odd_and_empty_tables(odd, empty, spark):
    d = odd.limit(0) if empty else odd
    n = d.count()
    assert quality.quality(d).count() == n
    assert packing.pack_documents(d).select("doc_id").distinct().count() == n
    assert simhash.groups(d).count() == n
    assert lines.dedup_lines(d).count() == n
    assert substrings.remove_repeats(d).count() == n
    assert decontaminate.flag(d, spark.createDataFrame([], "item_id long, text string")).count() == n
    assert mixing.score(d, F.lit(False)).count() == n
    assert pii.detect(d).count() == n


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF).toPandas()
    assert 0 < got.doc_id.nunique() < 200 and Path(SF).exists()


def test_near_dedup_against_all_pairs(docs, spark):
    import corpus_pipeline

    made = " ".join(f"word{i}" for i in range(100)).split()
    extra = [(10_001 + k, " ".join(made[:50] + [f"new{k}"] + made[51:]), "en", "a", 1) for k in range(3)] + [(10_010, " ".join(made), "en", "a", 1)]
    extra += [(10_020, " ".join(made[:80] + ["other"] * 20), "en", "a", 1), (10_030, "", "en", "a", 0), (10_031, None, "en", "a", 0)]
    both = docs.unionByName(spark.createDataFrame(extra, SCHEMA).select([F.col(c).cast(docs.schema[c].dataType) for c in docs.columns]))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, up = {}, {}
    for r in both.collect():
        w = WORD.findall((r["text"] or "").translate(low))
        sets[r["doc_id"]] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        up[r["doc_id"]] = r["doc_id"]

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, both, SF).select("doc_id").collect()}
    assert got == {a for a in sets if find(a) == a} and 10_001 in got and not {10_002, 10_003, 10_010} & got


def test_line_query_removes_short_lines(docs, spark, tmp_path):
    from tidemark.llm import queries

    made = [(10_001, "Read more\n\nhome\none two three four"), (10_002, "read MORE\n\nHome\nmore to read\none two three four five"), (10_003, "one two three\n")]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string").select([F.col(c).cast(docs.schema[c].dataType) for c in ("doc_id", "text")]))
    both.write.parquet(f"{tmp_path}/documents.parquet")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen, want = [], {}
    for r in sorted(both.collect(), key=lambda r: r["doc_id"]):
        for line in (r["text"] or "").split("\n"):
            if s := frozenset(WORD.findall(line.translate(low))):
                want[r["doc_id"]] = want.get(r["doc_id"], 0) + any(5 * len(s & t) >= 4 * len(s | t) for t in seen)
                seen.append(s)
    got = {r["doc_id"]: r["n_removed"] for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: want.get(i, 0) for i in got} and (got[10_001], got[10_002], got[10_003]) == (0, 3, 0)


def test_decontamination_finds_capitals_altered_copies_long_names_and_short_items(spark):
    item = "A train from Boston travels 60 km in 2 hours and then stops at Boston for 15 minutes before it goes on to the coast with all of its guests still on board"
    bench = spark.createDataFrame([(1, item), (2, "Ravens rarely eat green apples"), (3, "A boat leaves Rome with 12 sailors today")], "item_id long, text string")
    rows = [
        (1, "Read this: " + item.upper()),
        (2, item.replace("stops at Boston", "stops at London").replace("from Boston", "from Paris")),
        (3, "They say a boat leaves New York City with 90 sailors today or so"),
        (4, "I have heard that ravens rarely eat green apples in winter"),
        (5, "ravens eat apples rarely and green boats leave with sailors in the morning"),
    ]
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.flag(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: [1], 2: [1], 3: [3], 4: [2], 5: []}


def test_packing_ids_against_whole_texts(docs, spark):
    """Pieces, starts, lengths and checksums are those of the tokenizer's ids of whole texts."""
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    made = ["It's we'll 'so ''s _a_b 12'34 ÀÉ Straße", "é'S DON'T", "İstanbul Σας ΣΑΣ", "x²y ½ ª ﬁ", "日本語 <|endoftext|> text", "a\x85b\x1cb …---", "", None, "word " * 9000]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(made)], "doc_id long, text string"))
    want = set()
    for r in both.collect():
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(r["doc_id"], k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))}
    got = [tuple(r) for r in packing.pieces(both).collect()]
    assert len(got) == len(want) and set(got) == want


def test_mixing_base_against_brute_force(docs):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    rows = [(r["doc_id"], [*WORD.findall((r["text"] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))), None], r["h"]) for r in docs.withColumn("h", held).collect()]
    c = {}
    for _, w, h in rows:
        for x in w if not h else ():
            c[x] = c.get(x, 0) + 1
    n, v = sum(c.values()), len(c)
    got = {r["id"]: r for r in mixing.score(docs, held).collect()}
    for i, w, h in rows:
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (h, len(w), sum(x in c for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((c.get(x, 0) + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    text = " ".join(f"w{i}" for i in range(40))
    d = spark.createDataFrame([(None, text), (None, "other " + text), (5, text), (5, text), (5, "five words stand here alone")], "doc_id long, text string")
    kept = sorted((r["id"] is None, r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(d).collect())
    assert len(kept) == 5 and kept[:3] == [(False, 5, 0), (False, 40, 40), (False, 40, 40)] and sum(k[2] == 40 for k in kept[3:]) == 1
    assert mixing.score(d, F.lit(False)).count() == 5 and lines.dedup_lines(d, least=1).count() == 5
    assert simhash.groups(d).count() == 5 and packing.pack_documents(d).count() == 5


def test_stages_keep_columns_named_like_new_ones(spark):
    import corpus_pipeline

    text = "the cat and the dog walk to the house of a friend and then they go home"
    d = spark.createDataFrame([(1, text, "KEEP", 7)], "doc_id long, text string, kept string, n_lines int")
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.line_dedup, corpus_pipeline.near_dedup, corpus_pipeline.benchmark_decontamination):
        assert [tuple(r) for r in stage(spark, d, SF).collect()] == [(1, text, "KEEP", 7)]


def test_mixing_scores_each_text_by_itself():
    """Texts of several bytes a character end elsewhere in bytes than in characters; batches must not cut any short."""
    import numpy as np
    import pyarrow as pa

    texts = ["plain words " * 40, "\u00e9\u4e16\u754c " * 90, "A short ONE", "", None, "\u4e16" * 300, "tail " * 100]
    rows = pa.table({"id": range(len(texts)), "text": pa.array(texts, pa.string()), "held_out": [False] * len(texts), "block": pa.array([0] * len(texts), pa.int32())})
    g = mixing.gather(rows)
    ctx, nxt, n = g["ctx"].to_numpy().view(np.uint64), g["next"].to_numpy(), g["n"].to_numpy()
    model, mixer = mixing.Model(ctx[nxt >= 0], nxt[nxt >= 0], n[nxt >= 0]), mixing.Mixer()
    seen = 0
    for at, part in mixing._parts(rows):
        together = mixer.costs(*mixing._prepared(model, mixer, part, 0.0))
        for i, low, bits in zip(at, part, together, strict=True):
            assert low == (texts[i] or "").translate(mixing_lower).encode()
            assert abs(bits - mixer.costs(*mixing._prepared(model, mixer, [low], 0.0))[0]) < 1e-3
            seen += 1
    assert seen == len(texts)


mixing_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_every_capture_has_its_row(spark):
    rows = [(1, "http://a.b.c/x", 10), (1, "http://a.b.c/x", 10), (None, "http://a.b.c/y", 10), (None, "http://a.b.c/y", 30), (2, None, 10), (3, "http://c/", None), (4, "nonsense", 10)]
    captures = spark.createDataFrame([(*r, "k", 0) for r in rows], "page_id long, url string, fetch_ts long, key string, id int")
    entries = spark.createDataFrame([("b.c", 5, True), ("b.c", 20, False), ("a.b.c", 25, True), (None, 1, True), ("c", None, True)], "key string, ts long, listed boolean")
    want = sorted([(1, "a.b.c", 10, True, "b.c")] * 2 + [(None, "a.b.c", 10, True, "b.c"), (None, "a.b.c", 30, True, "a.b.c"), (2, "", 10, False, None), (3, "c", None, False, None), (4, "", 10, False, None)], key=str)
    assert sorted(map(tuple, url_lists.apply(captures, entries).collect()), key=str) == want
    url_lists.BROADCAST_ROWS, most = 0, url_lists.BROADCAST_ROWS
    try:
        assert sorted(map(tuple, url_lists.apply(captures, entries).collect()), key=str) == want
    finally:
        url_lists.BROADCAST_ROWS = most
    assert {r["blocked"] for r in url_lists.apply(captures, entries.limit(0)).collect()} == {False} and url_lists.apply(captures.limit(0), entries).collect() == []


def test_hosts_of_disguised_urls(spark):
    want = {"http://user:pw@Evil.com/": "evil.com", "http://evil.com./": "evil.com", "http://evil.com\\@good.com/": "evil.com", "http://[::1]:80/a": "[::1]", "https://a.b:8080?x=@c": "a.b", "no url": "", None: ""}
    got = spark.createDataFrame([(u,) for u in want], "u string").select("u", url_lists.host_of(F.col("u")).alias("h"))
    assert {r["u"]: r["h"] for r in got.collect()} == want


def test_mixing_weights_learn_from_every_training_text(spark, monkeypatch):
    """One set of weights for all blocks, taught by all training texts, also where no id has some remainder; held-out texts
    teach nothing."""
    import zlib

    import numpy as np

    rows = [(i, f"row {i} tells of a house by the river and of the people who live there " * 3) for i in range(400) if zlib.crc32(str(i).encode()) % 7 not in (2, 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    used = []
    kept = mixing._weights
    monkeypatch.setattr(mixing, "_weights", lambda *a: used.append(kept(*a)) or used[-1])
    assert mixing.score(d, F.lit(False)).count() == len(rows)
    monkeypatch.setattr(mixing, "BLOCK", 10_000)
    assert mixing.score(d, F.lit(False)).count() == len(rows)
    start = mixing.Mixer().w
    assert len(used) == 2 and all(w.shape == start.shape and np.abs(w - start).max() > 0.1 for w in used)
    assert mixing.score(d, F.lit(True)).count() == len(rows) and np.array_equal(used[2], start)
