"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hardnegatives, lines, mixing, packing, pii, prefixtrie, quality, simhash, substrings, sumsquares, toxicity, url_lists
from .common import table


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_marked_words", "n_stop_words")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    base = F.slice("spans", 1, F.col("n_base").cast("int"))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias("doc_id"),
        *[count(k) for k in pii.BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; kept_sha256 is that of the text less its repeated lines."""
    done = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), least=1)
    return done.select("doc_id", "n_lines", "n_removed", "n_similar", F.sha2("text", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.groups(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.flag(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "contaminated", "item_ids", "leak_windows", F.round("leak_share", 6).alias("leak_share"))


def _md5_number(c):
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def op1_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages has neither fetch times nor lists: a time in January 2024 comes from the url's hash, and dated entries
    from events, of which errors list and purchases delist the hosts and domains hashed to their user."""
    captures = table(spark, sf_dir, "pages").select("page_id", "url", (F.lit(1704067200) + F.pmod(_md5_number(F.col("url")), F.lit(30 * 86400))).alias("fetch_ts"))
    names = captures.select(F.explode(url_lists.keys(url_lists.host_of(F.col("url")))).alias("key")).where("key <> ''").distinct()
    names = names.withColumn("user_id", F.pmod(_md5_number(F.col("key")), F.lit(150)))
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase"))
    events = events.select("user_id", F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts) + 1704067200").alias("ts"), (F.col("event_type") == "error").alias("listed"))
    got = url_lists.apply(captures, names.join(events, "user_id").select("key", "ts", "listed"))
    return got.withColumnRenamed("id", "page_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return mixing.score(table(spark, sf_dir, "documents"), held_out).withColumnRenamed("id", "doc_id")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = lambda: F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).withColumnRenamed("id", "doc_id")
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


def op11_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sumsquares.pack_documents(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("v"), (F.col("vec_id") % 100 == 0).alias("anchor"))
    return hardnegatives.mine(rows)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_url_lists": op1_url_lists,
    "op2_quality_rules": op2_quality_rules,
    "op3_mixing": op3_mixing,
    "op4_packing": op4_packing,
    "op5_pii": op5_pii,
    "op6_substrings": op6_substrings,
    "op7_line_dedup": op7_line_dedup,
    "op8_simhash": op8_simhash,
    "op9_decontamination": op9_decontamination,
    "op10_toxicity": op10_toxicity,
    "op11_sum_of_squares": op11_sum_of_squares,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_prefix_trie": op13_prefix_trie,
}
OP1_SQL = r"""
WITH c AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host,
             1704067200 + (('0x' || substr(md5(url), 1, 8))::BIGINT % 2592000) AS fetch_ts FROM pages),
k AS (SELECT page_id, host, fetch_ts, unnest(list_transform(range(1, greatest(len(l) - 1, 1) + 1), lambda i: array_to_string(list_slice(l, i, len(l)), '.'))) AS key
      FROM (SELECT *, string_split(host, '.') AS l FROM c)),
e AS (SELECT key, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) + 1704067200 AS ts, bool_and(event_type = 'error') AS listed
      FROM (SELECT DISTINCT key FROM k WHERE key <> '') n JOIN events ON user_id = ('0x' || substr(md5(key), 1, 8))::BIGINT % 150
      WHERE event_type IN ('error', 'purchase') GROUP BY 1, 2),
l AS (SELECT k.page_id, k.key, (SELECT arg_max(e.listed, e.ts) FROM e WHERE e.key = k.key AND e.ts <= k.fetch_ts) AS on_list FROM k),
b AS (SELECT page_id, arg_max(key, length(key)) AS listed_by FROM l WHERE on_list GROUP BY 1)
SELECT c.page_id, host, fetch_ts, listed_by IS NOT NULL AS blocked, listed_by FROM c LEFT JOIN b ON c.page_id = b.page_id
"""
OP12_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), FALSE))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""
#: h needs CRC-32, which DuckDB lacks: eight steps for each byte of the decimal number, of which the first takes it in.
OP13_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS own, conv_id - conv_id % 5 AS base, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)) AS crc FROM t GROUP BY conv_id),
k AS (SELECT c.conv_id, c.base, xor(c.crc, 4294967295) % 9 AS h, least(xor(c.crc, 4294967295) % 9, coalesce(b.own, 0)) AS lent FROM c LEFT JOIN c b ON c.base = b.conv_id),
r AS (SELECT conv_id, p - h + lent AS p, role, text FROM t JOIN k USING (conv_id) WHERE p >= h UNION ALL SELECT k.conv_id, p, role, text FROM k JOIN t ON k.base = t.conv_id WHERE p < h),
l AS (SELECT k.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY p) FILTER (p IS NOT NULL), []) AS s FROM k LEFT JOIN r USING (conv_id) GROUP BY k.conv_id),
x AS (SELECT conv_id AS c, s, unnest(range(0, len(s) + 1)) AS depth FROM l),
n AS (SELECT s[1:depth]::VARCHAR AS path, CASE WHEN depth > 0 THEN s[1:depth - 1]::VARCHAR END AS up, any_value(CASE WHEN depth > 0 THEN strlen(s[depth].text) ELSE 0 END) AS bytes, depth, min(c) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(s) = depth), '')) AS ends_sha256 FROM x GROUP BY ALL),
f AS (SELECT n.*, (SELECT count(*) FROM n b WHERE b.up = n.path AND b.depth = n.depth + 1) AS n_children FROM n),
a AS (SELECT DISTINCT s[1:depth]::VARCHAR AS path, depth, s[1:upto]::VARCHAR AS below, upto FROM (SELECT s, depth, unnest(range(depth, len(s) + 1)) AS upto FROM x)),
u AS (SELECT a.path, a.depth, sum((f.n_children = 0)::INT)::BIGINT AS n_leaves, sum((f.n_convs - 1) * f.bytes)::BIGINT AS saved_tokens FROM a JOIN f ON a.below = f.path AND a.upto = f.depth GROUP BY ALL)
SELECT f.conv_id, f.depth, g.conv_id AS parent_conv_id, f.n_convs, f.n_children, u.n_leaves, u.saved_tokens, f.ends_sha256 FROM f JOIN u ON f.path = u.path AND f.depth = u.depth LEFT JOIN n g ON f.up = g.path AND f.depth = g.depth + 1
"""
ORACLES = {"op1_url_lists": OP1_SQL, "op2_quality_rules": quality.oracle(), "op12_hard_negatives": OP12_SQL, "op13_prefix_trie": OP13_SQL}
