"""Personal data and benchmark passages against literal readings of what they are, over all documents."""

import hashlib
import re
import unicodedata
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.llm import decontaminate as D
from tidemark.llm.queries import op5_pii, op9_decontamination

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _digits(s):
    return re.sub("[^0-9]", "", s)


def _luhn(d):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def _base(text):
    """The four kinds as their definitions say, one pattern after the other over the whole text."""
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(_digits(m)) <= 19 and _luhn(_digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(_digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, good in kinds for m in re.finditer(p, text) if good(m[0])]


MADE = [
    "a@b.co a@b a@@b.c x.y%z@q-r.s.t. +1 (202) 555-0175 +12 345 67 +1234567890123456 1.2.3.4 256.1.1.1 1.2.3.4.5 01.002.3.255",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 +4111111111111111 5500 0000 0000 0004 12 " * 3,
    "é😀 a@b.co 😀😀 192.168.0.1 ü +44 20 7946 0958 GB82 WEST 1234 5698 7654 32 und GB82 WEST 1234 5698 7654 33 SSN 123-45-6789",
    "",
    "\n\n 1.1.1.1\n2.2.2.2 " + "9" * 400 + " " + "a" * 3000 + "@" + "b." * 500 + "c",
]


def test_pii_against_its_definitions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate([*MADE, None])], "doc_id long, text string")
    docs.select("doc_id", "text").unionByName(made).write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    rows = op5_pii(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    kinds = defaultdict(int)
    for r in rows:
        text, spans = texts[r["doc_id"]], _base(texts[r["doc_id"]])
        joined = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest(), r["doc_id"]
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        found = r["spans"].split(",") if r["spans"] else []
        assert found[: len(joined)] == joined
        for s in found:
            kind, a, b = s.split(":")
            kinds[kind] += 1
            if kind == "iban":
                code = text[int(a) : int(b)].replace(" ", "")
                assert int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1
    assert min(kinds[k] for k in ("email", "ip", "card", "phone", "iban")) > 0


def _template(text):
    """Words as (what stands in the template, value or None for a literal word), and the plain lower-case words."""
    raw = WORD.findall(text or "")
    bare = [w.strip(D.PUNCTUATION) for w in raw]
    number = lambda x: re.fullmatch(r"[0-9][0-9.,]*%?", x) is not None
    out = []
    for i, x in enumerate(bare):
        if not x:
            continue
        before = i and re.search(r"[.!?:][^\w]*$", raw[i - 1].replace("_", " "))
        if number(x):
            out.append(("<n>", x))
        elif i and number(bare[i - 1]) and x.lower() in D.UNITS:
            out.append(("<u>", x.lower()))
        elif i and x != x.lower() and unicodedata.category(x[0]) == "Lu" and not before:
            out.append(("<p>", f"{out.pop()[1]} {x.lower()}" if out and out[-1][0] == "<p>" else x.lower()))
        else:
            out.append((x.lower(), None))
    return out, [x.lower() for x in bare if x]


def _windows(text, lengths=None):
    """(plain, words of the window) to its places and values; without lengths a short text is one window."""
    out = []
    for plain, seq in zip((False, True), _template(text), strict=True):
        sizes = lengths[plain] if lengths else [D.WINDOW if len(seq) >= D.WINDOW else len(seq)]
        for size in sizes:
            for i in range(len(seq) - size + 1 if size else 0):
                part = seq[i : i + size]
                slots = () if plain else tuple(v for _, v in part if v is not None)
                if len(part) - len(slots) >= D.MIN_LITERALS:
                    out.append((plain, tuple(part) if plain else tuple((k, v is None) for k, v in part), i, slots))
    return out


def _contaminated(texts, items):
    index, sizes, lengths = defaultdict(list), defaultdict(set), {False: {D.WINDOW}, True: {D.WINDOW}}
    for item, text in set(items):
        for plain, key, i, slots in _windows(text):
            index[plain, key].append((item, i, slots))
            sizes[item, plain].add(i)
            lengths[plain].add(len(key))
    found = {}
    for doc, text in texts.items():
        hits = [(item, 0 if plain else pos - i, plain, i, slots, islots) for plain, key, pos, slots in _windows(text, lengths) for item, i, islots in index.get((plain, key), ())]
        stands = defaultdict(set)
        for item, diag, _, _, slots, islots in hits:
            if slots != islots:
                for a, b in zip(islots, slots, strict=True):
                    stands[item, diag, a].add(b)
        bad = {(item, diag) for (item, diag, _), bs in stands.items() if len(bs) > 1}
        good = defaultdict(set)
        for item, diag, plain, i, slots, islots in hits:
            if slots == islots or (item, diag) not in bad:
                good[item, diag, plain].add(i)
        kept = [(item, len(at), len(at) / len(sizes[item, plain])) for (item, _, plain), at in good.items() if len(at) >= D.MIN_WINDOWS or 100 * len(at) >= D.MIN_SHARE * len(sizes[item, plain])]
        found[doc] = (bool(kept), sorted({k[0] for k in kept}), max((k[1] for k in kept), default=0), round(max((k[2] for k in kept), default=0.0), 6))
    return found


def test_decontamination_against_all_windows(spark, tmp_path):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    # Every third item once more as a document with its numbers moved on, between other words.
    moved = bench.where("item_id % 3 = 0").select((F.col("item_id") + 10**9).alias("doc_id"), F.concat(F.lit("Once more. "), F.regexp_replace("text", "[0-9]", "7"), F.lit(" And so on.")).alias("text"))
    odd = spark.createDataFrame([(2 * 10**9, None), (2 * 10**9 + 1, ""), (2 * 10**9 + 2, "... !!! --"), (2 * 10**9 + 3, "alike " * 5000)], "doc_id long, text string")
    docs.unionByName(moved).unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    bench.unionByName(bench.limit(2)).write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    want = _contaminated(texts, [(r["item_id"], r["text"]) for r in bench.collect()])
    got = {r["doc_id"]: (r["contaminated"], list(r["item_ids"]), r["leak_windows"], r["leak_share"]) for r in op9_decontamination(spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    assert {d: (got[d], want[d]) for d in want if got[d] != want[d]} == {}
    assert sum(w[0] for w in want.values()) > 10
