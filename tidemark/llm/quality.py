"""Quality rules: a table of thresholds compiled into Spark expressions, without user functions.

Every rule is a line (name, numerator, denominator, least %, most %) over per-text counts; comparing
100 * numerator with % * denominator keeps the arithmetic in whole numbers. `metrics` adds the counts,
`verdict` the booleans; both are projections, so the whole filter is one scan without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, words

#: Frequent words of the four languages. Fixed values.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "with", "as", "on", "be", "at", "by", "this", "are", "from",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "qui", "pour", "dans", "par", "sur", "est", "au", "avec",
    "der", "die", "das", "und", "von", "den", "dem", "mit", "für", "auf", "ein", "eine", "nicht", "sich", "auch", "zu",
    "el", "los", "las", "en", "y", "se", "por", "con", "una", "para", "del", "no", "su", "al",
)

#: name, numerator, denominator, least % or None, most % or None. A rule without words in its denominator passes.
RULES = (
    ("mean_word_length", "word_chars", "n_words", 200, 1500),
    ("symbols", "n_symbols", "n_words", None, 10),
    ("marked_words", "n_marked_words", "n_words", None, 20),
    ("stop_words", "n_stop_words", "n_words", 2, None),
    ("dup_lines", "n_dup_lines", "n_lines", None, 30),
)
MIN_WORDS = 10
MOST_REPEATED = 20
WINDOW = 5


def _repeat_words(w: Column) -> Column:
    """Words inside windows of five that occur twice or more in the text. Windows are compared by 64-bit hash
    within one text only. Hashes with their places are sorted, so that equal ones are neighbours; the
    places of repeated ones, sorted again, each cover the words up to the next place, five at most."""
    n = F.size(w)
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    return hashes


def metrics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the counts as new columns beside the old ones (an old column of the same name is replaced).
    A null text has no words and no lines; long texts stay in one row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A column of this name would be shadowed below, so the helper columns carry a prefix.
    df = docs.withColumn("_w", words(F.col(text_col)))
    df = df.withColumn("_l", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
    df = df.withColumn("_h", _repeat_words(F.col("_w")))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("_s")
    twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
    df = df.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    stop = F.array(*[F.lit(x) for x in STOP_WORDS])
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
        "n_marked_words": F.size(F.filter("_w", lambda x: x.rlike("[!?#*$%&|<>~^=]{2}"))).cast("long"),
        "n_stop_words": F.size(F.filter("_w", lambda x: F.array_contains(stop, F.lower(x)))).cast("long"),
    })
    return df.drop("_w", "_l", "_h", "_s", "_p")


def verdict(counted: DataFrame, rules=RULES) -> DataFrame:
    """Adds base_failed, a boolean <rule>_ok for each rule, and kept."""
    n = F.col("n_words")
    df = counted.withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n))
    passed = {}
    for name, top, bottom, least, most in rules:
        ok = F.lit(True)
        if least is not None:
            ok = ok & (100 * F.col(top) >= least * F.col(bottom))
        if most is not None:
            ok = ok & (100 * F.col(top) <= most * F.col(bottom))
        passed[f"{name}_ok"] = ok
    df = df.withColumns(passed)
    kept = ~F.col("base_failed")
    for name in passed:
        kept = kept & F.col(name)
    return df.withColumn("kept", kept)


def quality(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """docs with counts and verdicts. Empty and null texts fail; ties and copies are judged row by row."""
    return verdict(metrics(docs, text_col), rules)


def oracle() -> str:
    """The same in DuckDB, for documents."""
    stop = ", ".join(f"'{x}'" for x in STOP_WORDS)
    rules = []
    for name, top, bottom, least, most in RULES:
        parts = [f"100 * {top} >= {least} * {bottom}"] * (least is not None) + [f"100 * {top} <= {most} * {bottom}"] * (most is not None)
        rules.append(f"({' AND '.join(parts)}) AS {name}_ok")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
x AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM x) WHERE c > 1),
p AS (SELECT doc_id, sum(least(5, coalesce(j - i, 5)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: regexp_matches(x, '[!?#*$%&|<>~^=]{{2}}')))::BIGINT AS n_marked_words,
             len(list_filter(w, lambda x: list_contains([{stop}], lower(x))))::BIGINT AS n_stop_words
      FROM w LEFT JOIN p ON w.doc_id = p.doc_id),
v AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AS base_failed, {", ".join(rules)} FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {" AND ".join(f"{r[0]}_ok" for r in RULES)}) AS kept, n_lines, n_marked_words, n_stop_words
FROM v
"""
