"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import align, centroids, license_scan, lm_score, mix, near_texts, near_vectors, packing, pii, quality, shard, token_count, url_filter

#: Folder of public tokenizer files; every executor has it.
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SHARDS = {i: 1.0 for i in range(8)}
GROWN = SHARDS | {8: 1.0}

# The five host rules of the url query, then the patterns that judge other urls.
HOST_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]
PATTERN_RULES = [
    url_filter.Rule("block", pattern="^cheap-pills^"),
    url_filter.Rule("block", pattern="^adult-x^"),
    url_filter.Rule("block", pattern="^casino^"),
    url_filter.Rule("block", pattern="^phishing^*^login^"),
    url_filter.Rule("block", pattern="^admin^"),
]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_read(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_read(spark, sf_dir, "pages"), HOST_RULES + PATTERN_RULES)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_documents(_read(spark, sf_dir, "documents"), SHARDS, GROWN).withColumn("law", F.lit("key"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE)).drop("ids")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_plan(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "virtual_finish")


def op8_near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_texts.near_texts(_read(spark, sf_dir, "documents")).drop("row")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    judged = quality.judged(docs, labels, carried=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_read(spark, sf_dir, "embeddings"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(_read(spark, sf_dir, "embeddings"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_read(spark, sf_dir, "documents"))


def _values(rules: list[url_filter.Rule]) -> str:
    return ", ".join(f"('{r.name}', '{r.host}', '{r.path}', '{r.action}')" for r in rules)


URL_SQL = rf"""
WITH place AS (
  SELECT page_id, coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1, 's'), '') AS raw_host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
p AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM place),
r(name, rule_host, rule_path, action) AS (VALUES {_values(HOST_RULES)}),
j AS (
  SELECT page_id, host, path,
    (SELECT arg_max(name, length(name)) FROM r WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule,
    lower(host || path) AS place FROM p),
k AS (
  SELECT *, CASE
    WHEN regexp_matches(place, '(^|[^a-z0-9])phishing[^a-z0-9].*[^a-z0-9]login([^a-z0-9]|$)', 's') THEN '^phishing^*^login^'
    WHEN regexp_matches(place, '(^|[^a-z0-9])cheap-pills([^a-z0-9]|$)', 's') THEN '^cheap-pills^'
    WHEN regexp_matches(place, '(^|[^a-z0-9])adult-x([^a-z0-9]|$)', 's') THEN '^adult-x^'
    WHEN regexp_matches(place, '(^|[^a-z0-9])casino([^a-z0-9]|$)', 's') THEN '^casino^'
    WHEN regexp_matches(place, '(^|[^a-z0-9])admin([^a-z0-9]|$)', 's') THEN '^admin^' END AS pattern FROM j)
SELECT page_id, host, path, rule, pattern,
  CASE WHEN rule IS NOT NULL THEN (SELECT action FROM r WHERE name = rule) WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM k
"""

WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS_SQL}) AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS shuffled FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank FROM d GROUP BY source),
s1 AS (SELECT *, [5.0, 2.0, 1.0][((source_rank - 1) % 3 + 1)::INT]::DOUBLE AS weight, (source_size * 3)::DOUBLE AS most FROM s0),
s2 AS (
  SELECT *, most / weight AS fill,
    (sum(source_size::DOUBLE) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY most / weight, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
t AS (SELECT arg_min(level, row(fill, source_rank)) AS t FROM s2 WHERE level <= fill),
s3 AS (SELECT source, source_rank, source_size, weight, least(weight * t, most) AS target FROM s2, t),
runs AS (SELECT doc_id, source, size, shuffled, count(*) AS copies, size * count(*) AS words FROM d GROUP BY doc_id, source, size, shuffled),
q AS (
  SELECT doc_id, runs.source, size, copies, words, source_rank, source_size, weight, target,
    coalesce(sum(words) OVER (PARTITION BY runs.source ORDER BY shuffled, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM runs JOIN s3 ON runs.source IS NOT DISTINCT FROM s3.source),
firsts AS (SELECT *, unnest(range(0, words::BIGINT, {mix.PACKET})) AS skipped FROM q),
parts AS (
  SELECT source_rank, weight, (epoch * source_size + start + skipped)::BIGINT AS place, least({mix.PACKET}, words - skipped)::BIGINT AS n
  FROM firsts, range(0, {mix.EPOCHS}) e(epoch)),
sorted AS (
  SELECT source_rank, n, sum(n) OVER (ORDER BY (place + n)::DOUBLE / weight, source_rank, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM parts),
total AS (SELECT sum(words) AS total FROM q),
by_source AS (SELECT source_rank, sum(greatest(0, least(n, total - (upto - n))))::BIGINT AS served FROM sorted, total GROUP BY source_rank),
each_copy AS (SELECT q.*, coalesce(by_source.served, 0) AS served, unnest(range(0, q.copies)) AS copy FROM q LEFT JOIN by_source USING (source_rank)),
c AS (SELECT *, start + copy * size AS place FROM each_copy)
SELECT doc_id, size::INT::BIGINT AS size, source_size, target,
  (greatest(0, least(size, served - place)) + greatest(0, least(size, served - place - source_size)) + greatest(0, least(size, served - place - 2 * source_size)))::BIGINT AS taken,
  (place + size)::DOUBLE / weight AS virtual_finish
FROM c
"""

QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text, {WORDS_SQL} AS w FROM documents),
wins AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM wins) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS place FROM rep) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM d),
f AS (
  SELECT rid, doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(translate(text, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
g AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    {{'symbols': CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END, 'repeats': CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END,
      'duplicate_lines': CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END}} AS s FROM f),
r AS (
  SELECT rid, lang, doc_id, base_failed, unnest([{{'rule': 'symbols', 'score': s.symbols}}, {{'rule': 'repeats', 'score': s.repeats}}, {{'rule': 'duplicate_lines', 'score': s.duplicate_lines}}], recursive := true) FROM g),
steps(rule, step, cutoff) AS (VALUES {", ".join(f"('{rule}', {i}, {c}::DOUBLE)" for rule, own in quality.CUTOFFS.items() for i, c in enumerate(own))}),
good AS (SELECT r.* FROM r JOIN labels l ON l.doc_id = r.doc_id WHERE l.quality = 1 AND NOT base_failed),
n AS (SELECT lang, rule, step, cutoff, count(*) AS n, count(*) FILTER (score > cutoff) AS k FROM good JOIN steps USING (rule) GROUP BY ALL),
level AS (SELECT {quality.DOUBT} / (3 * (SELECT count(DISTINCT coalesce(lang, chr(0))) FROM good)) AS level, {quality.RISK} / 3 AS p),
safe AS (
  SELECT lang, rule, step, cutoff, k <= n * p AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - CASE WHEN n = i THEN 0 ELSE lgamma(n - i + 1) END + i * ln(p) + (n - i) * ln(1 - p)))) <= level AS safe
  FROM n, level),
first AS (SELECT lang, rule, min(step) FILTER (NOT safe) AS failed FROM safe GROUP BY ALL),
cut AS (SELECT s.lang, s.rule, min(cutoff) AS cutoff FROM safe s JOIN first f ON s.lang IS NOT DISTINCT FROM f.lang AND s.rule = f.rule WHERE failed IS NULL OR step < failed GROUP BY ALL),
out AS (SELECT DISTINCT r.rid FROM r JOIN cut c ON r.lang IS NOT DISTINCT FROM c.lang AND r.rule = c.rule WHERE score > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM out) AS kept FROM g
"""

VECTOR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS component FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


def _cluster_sql(k: int = centroids.K, rounds: int = centroids.ROUNDS) -> str:
    """The rounds one after another; sums are exact, and their quotients floored."""
    far = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS v, embedding FROM embeddings
  WHERE len(embedding) = {centroids.WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), embedding) - 1 AS i, v AS c FROM v QUALIFY i < {k})",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT rid, arg_min(i, (d, i)) AS i, min(d) AS d FROM (SELECT rid, i, {far} AS d FROM v, c{n}) GROUP BY rid)")
        if n < rounds:
            steps.append(f"s{n} AS (SELECT i, place, sum(x) AS s, count(*) AS n FROM (SELECT i, unnest(v) AS x, unnest(range({centroids.WIDTH})) AS place FROM a{n} JOIN v USING (rid)) GROUP BY i, place)")
            steps.append(f"m{n} AS (SELECT i, list((s - (s % n + n) % n) // n ORDER BY place) AS c FROM s{n} GROUP BY i)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT i, coalesce(m{n}.c::BIGINT[], c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (i))")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, i::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY i))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (rid) JOIN c{rounds} USING (i)"""


def _rendezvous_sql(shards: dict[int, float]) -> str:
    """The shard whose MD5 gives the highest score."""
    unit = "((('0x' || substr(md5('shard:{0}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"
    return "list_max([" + ", ".join(f"{{'score': -1.0 / ln({unit.format(i)}), 'shard': {i}}}" for i in shards) + "]).shard"


# the checksum runs over the text's bytes with a table of 256 entries, made by 8 halvings of each index
SHARD_SQL = rf"""
WITH rounds AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc),
h AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes FROM documents),
d AS (
  SELECT doc_id, (len(bytes) + 1)::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(bytes, lambda b: ('0x' || b)::BIGINT)),
      lambda c, b: xor(c // 256, crc[(xor(c % 256, b) + 1)::INT])), 4294967295)::BIGINT AS text_crc32,
    {_rendezvous_sql(SHARDS)} AS shard, {_rendezvous_sql(GROWN)} AS grown_shard, substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 3) AS bucket
  FROM h, rounds)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM d
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_url_filter, op3_lm_score, op4_token_counts, op5_sharding, op6_packing, op7_mixing, op8_near_texts, op9_quality, op10_near_vectors, op11_alignment, op12_centroids, op13_pii)
}

ORACLES: dict[str, str] = {"op2_url_filter": URL_SQL, "op5_sharding": SHARD_SQL, "op7_mixing": MIX_SQL, "op9_quality": QUALITY_SQL, "op10_near_vectors": VECTOR_SQL, "op12_centroids": _cluster_sql()}
