"""Functions of text, URLs and HTML on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.streaming import feed


def _one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("url,want", [("https://[2001:DB8::1]:80/a", "2001:db8::1"), ("http://u:p@www.A.org:8080/x", "a.org"), ("ftp://b.c", "b.c"), ("nothing", None), (None, None), ("http:///x", None), ("http://a@b@c.d/e@f", "c.d")])
def test_domains(spark, url, want):
    assert _one(spark, url, T.domain) == want


@pytest.mark.parametrize("url,want", [("HTTPS://www.X.org:81?b=2&utm_source=q&a=%7E1&gclid=3#f", "https://x.org:81/?a=~1&b=2"), (" http://a.b/c%20d?q=a+b&q= ", "http://a.b/c%20d?q=&q=a+b"), ("x", None)])
def test_canonical_urls(spark, url, want):
    assert _one(spark, url, T.canonical_url) == want


@pytest.mark.parametrize("fragment,want", [("a<b>b</b>&#233;&#xE9; &#128512;&mdash;&amp;amp; &#0; &#99999999; &x", "a b éé 😀—&amp; &#0; &#99999999; &x"), ("<p>   </p>", None), (None, None)])
def test_cleaned(spark, fragment, want):
    assert _one(spark, fragment, T.cleaned) == want


PAGES = [
    ('<script type="application/ld+json">{"@graph": [{"author": {"articleBody": " "}}, {"datePublished": "2024-03-01T10:00:00Z", "articleBody": "The \\"text\\""}]}</script><article>other</article>', None, 'The "text"', 1709287200),
    ('<script type="application/ld+json">{broken</script><meta content="Given" property="og:title"><title>No</title><p>one</p><p> </p><P>two</P>', "Given", "one two", None),
    ('<meta name="og:title" content=" "><title>T &lt;1&gt;</title><meta content="2024-03-01 10:00:00" name="article:published_time"><article><h1>A</h1>b</article>', "T <1>", "A b", 1709287200),
    ('<h1>Head</h1><time class="x" datetime="2024-03-01">', "Head", None, 1709251200),
    ("", None, None, None),
]


def test_pages(spark):
    df = spark.createDataFrame([(p,) for p, *_ in PAGES], "h string")
    got = df.select(T.html_title(F.col("h")), T.html_body(F.col("h")), F.unix_seconds(T.html_published(F.col("h")))).collect()
    assert list(map(tuple, got)) == [tuple(w) for _, *w in PAGES]


def test_small_functions(spark):
    assert [_one(spark, x, T.side) for x in ("Buy", " bid ", "S", "ask", "hold", "")] == ["buy", "buy", "sell", "sell", "unknown", "unknown"]
    assert [_one(spark, x, T.probability) for x in ("0.5", "1", "1.01", "-0.1", "x", None)] == [0.5, 1.0, None, None, None, None]
    assert [_one(spark, x, lambda c: F.unix_seconds(T.instant(c))) for x in ("20240301T100000Z", "1709287200", "1709287200000", "2024-03-01T10:00:00Z", "soon")] == [1709287200] * 4 + [None]
    lists = spark.createDataFrame([([" b", "a", "", "a "],), (None,)], "x array<string>")
    assert [r[0] for r in lists.select(T.string_list(F.col("x"))).collect()] == [["a", "b"], None]
    sets = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], [])], "a array<string>, b array<string>")
    assert [r[0] for r in sets.select(T.jaccard(F.col("a"), F.col("b"))).collect()] == [1 / 3, 1.0, 0.0]
    prices = spark.createDataFrame([(100.0, 101.0), (0.0, 0.0), (None, 1.0)], "a double, b double")
    assert [None if r[0] is None else round(r[0], 6) for r in prices.select(feed.mismatch_bps(F.col("a"), F.col("b"))).collect()] == [99.009901, 0.0, None]


def test_subscribed_rows(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "token string, n int")
    asked = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "token string")
    assert sorted(r["n"] for r in feed.subscribed(rows, asked).collect()) == [1, 3]
