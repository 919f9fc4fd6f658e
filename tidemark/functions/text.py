"""Text, URL and HTML functions as column expressions: all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsons import find_text, let, parsed

#: White space of Unicode text; parameters that only track; words that say nothing about a topic.
BLANK = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
TRACKING = ["fbclid", "gclid", "gbraid", "mc_cid", "mc_eid", "mkt_tok", "wbraid"]
#: The characters of BLANK one by one.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
STOP = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with", "will"]
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&ndash;": "–", "&mdash;": "—", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&hellip;": "…", "&euro;": "€", "&amp;": "&"}


def stripped(text: Column) -> Column:
    """Without white space at both ends, which is looked at from there: a pattern would go through the whole text."""
    return F.trim(text, F.lit(BLANKS))


def normalized(text: Column) -> Column:
    """Trimmed, in lower case, white space as single blanks; null is empty."""
    return F.coalesce(F.regexp_replace(F.lower(stripped(text)), BLANK, " "), F.lit(""))


def text_hash(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def content_hash(title: Column, body: Column, summary: Column) -> Column:
    """Hash of the body, or of title and summary where there is no body."""
    full = lambda c: F.when(stripped(c) != "", c)
    return text_hash(F.coalesce(full(body), F.concat_ws(" ", full(title), full(summary))))


def tokens(text: Column) -> Column:
    """Distinct runs of a-z and 0-9 in lower case without stop words; null has none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.array_except(found, F.array(*[F.lit(w) for w in STOP]))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def domain(url: Column) -> Column:
    """Host in lower case without user, port, leading www. and the brackets of an address; null if there is none."""
    host = F.regexp_extract(stripped(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*|[^/?#:@\[]+)", 1)
    host = F.regexp_replace(host, r"^\[", "")
    return F.nullif(F.regexp_replace(F.lower(host), r"^www\.", ""), F.lit(""))


def _form(value: Column) -> Column:
    """A query part in one spelling: decoded where that is possible, and encoded anew."""
    again = F.url_encode(F.coalesce(F.try_url_decode(value), value))
    return F.replace(F.replace(again, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """One spelling of a URL: scheme and host in lower case, no www., user or fragment, port kept, pairs of the query
    sorted and without those that track, an empty path as /. Null without scheme or host."""
    u = stripped(url)
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    port = F.regexp_extract(u, r"^[^:/?#]+://[^/?#]*?(:[0-9]+)(?:[/?#]|$)", 1)
    path = F.regexp_extract(u, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.struct(_form(F.substring_index(p, "=", 1)).alias("k"), _form(F.when(p.contains("="), F.substr(p, F.locate("=", p) + 1)).otherwise("")).alias("v")))
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).startswith("utm_") & ~F.lower(p["k"]).isin(TRACKING))
    joined = F.array_join(F.transform(F.sort_array(kept), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    full = F.concat(scheme, F.lit("://"), domain(u), port, F.when(path == "", "/").otherwise(path), F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))
    return F.when(scheme != "", full)


def _numbered(text: Column) -> Column:
    """Entities by number (&#233; or &#xe9;) as characters; those of no character stay."""
    digits = lambda p: F.regexp_extract(p, "^&#[xX]?([0-9a-fA-F]+);$", 1)
    code = lambda p: F.when(p.rlike("^&#[xX]"), F.conv(digits(p), 16, 10)).otherwise(digits(p)).try_cast("int")
    made = lambda n: F.when(n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    parts = F.regexp_extract_all(text, F.lit("&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|[^&]+|&"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^&#[0-9xX]"), F.coalesce(let(code(p), made), p)).otherwise(p)), "")


def cleaned(fragment: Column) -> Column:
    """Text of an HTML fragment: tags as blanks, the entities above and those by number decoded, white space collapsed;
    null if none is left."""
    text = let(F.regexp_replace(fragment, "<[^>]+>", " "), lambda t: F.when(t.contains("&#"), _numbered(t)).otherwise(t))
    for name, value in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(value))
    return F.nullif(stripped(F.regexp_replace(text, BLANK, " ")), F.lit(""))


def element(html: Column, tag: str) -> Column:
    """Inner HTML of the first element of this name."""
    return F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1)


def meta(html: Column, key: str) -> Column:
    """Content of the first meta tag with this property or name that has any, whichever of both comes first in it."""
    name, text = rf"(?:property|name)\s*=\s*[\"']\s*{key}\s*[\"']", r"content\s*=\s*[\"']([^\"']*[^\"'\s][^\"']*)[\"']"
    found = [F.nullif(F.trim(F.regexp_extract(html, rf"(?i)<meta\s[^>]*{p}", 1)), F.lit("")) for p in (rf"{name}[^>]*{text}", rf"{text}[^>]*{name}")]
    return F.coalesce(*found)


def linked(html: Column, key: str) -> Column:
    """The first text under key, at any depth, in the page's linked data, one script after the other."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script\s[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    return F.get(F.filter(F.transform(scripts, lambda t: find_text(parsed(F.trim(t)), key)), lambda x: x.isNotNull()), F.lit(0))


def html_title(html: Column) -> Column:
    return F.coalesce(meta(html, "og:title"), cleaned(element(html, "title")), cleaned(element(html, "h1")))


def html_body(html: Column) -> Column:
    """The article of linked data, else the article element, else all paragraphs."""
    paragraphs = F.regexp_extract_all(html, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), 1)
    joined = F.array_join(F.filter(F.transform(paragraphs, cleaned), lambda p: p.isNotNull()), " ")
    return F.coalesce(linked(html, "articleBody"), cleaned(element(html, "article")), F.nullif(joined, F.lit("")))


def html_published(html: Column) -> Column:
    """Linked data, else the meta tag, else the first time element; null if it is no time."""
    shown = F.regexp_extract(html, r"(?i)<time\s[^>]*datetime\s*=\s*[\"']([^\"']+)[\"']", 1)
    return F.coalesce(*[c.try_cast("timestamp") for c in (linked(html, "datePublished"), meta(html, "article:published_time"), shown)])


def side(raw: Column) -> Column:
    s = F.lower(F.trim(raw))
    return F.when(s.isin("buy", "bid", "b"), "buy").when(s.isin("sell", "ask", "s"), "sell").otherwise("unknown")


def probability(raw: Column) -> Column:
    """As a number; null where it is none or outside 0 to 1."""
    p = raw.try_cast("double")
    return F.when((p >= 0) & (p <= 1), p)


def instant(raw: Column) -> Column:
    """ISO text, compact YYYYMMDDTHHMMSSZ, or seconds or milliseconds since 1970 (above 1e10), as a time; else null."""
    n = raw.try_cast("double")
    epoch = F.when(n > 1e10, n / 1000).otherwise(n).cast("timestamp")
    return F.coalesce(F.try_to_timestamp(raw, F.lit("yyyyMMdd'T'HHmmss'Z'")), epoch, raw.try_cast("timestamp"))


def string_list(raw: Column) -> Column:
    """Sorted distinct strings without blanks around them and without empty ones."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(raw, lambda s: F.trim(s)), lambda s: s != "")))
