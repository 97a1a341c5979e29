"""One query per operator, each over its whole table, and SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, byte_bpe, divergence, exact_topk, filter_audit, licenses, near_duplicates, packing, quality, sharding, token_counts, token_files, toxicity
from .common import shared_path, table
from .license_templates import PHRASES, TEMPLATES

SHARD_BYTES = 64 << 20
#: A limit at which tables of a few megabytes split too, and above any document there.
SMALL_SHARD_BYTES = 256 << 10
CAPACITY = 4096
END_ID_FILES = 2
END_ID_PACKING = 1


def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def sharding_of_small_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SMALL_SHARD_BYTES)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), path)


def op3_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op4_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score(documents, quality.fit(documents, table(spark, sf_dir, "labels")))


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op6_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "op7_token_files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), END_ID_FILES)
    return token_files.token_index(spark, out)


def op8_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), CAPACITY, END_ID_PACKING)


def op9_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_extendible_sharding,
        op2_byte_bpe,
        op3_compression_toxicity,
        op4_pairwise_quality,
        op5_cross_polytope,
        op6_pivot_top_k,
        op7_token_files,
        op8_pattern_packing,
        op9_lsh_forest_join,
        op10_token_counts,
        op11_license_templates,
        op12_source_divergence,
        op13_filter_audit,
        sharding_of_small_shards,
    )
}

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_regex(items: list) -> str:
    """A parsed template as a regular expression over words, each of which has a space behind it."""
    out = []
    for item in items:
        if isinstance(item, bytes):
            out.append(f"{item.decode()} ")
        elif item[0] == "optional":
            out.append(f"(?:{template_regex(item[1])})?")
        elif item[0] == "one":
            out.append("(?:" + "|".join("".join(f"{w.decode()} " for w in words) for words in item[1]) + ")")
        else:
            out.append(f"(?:[^ ]+ ){{{item[1]},{item[2]}}}")
    return "".join(out)


def licenses_sql() -> str:
    """Phrases by their places in the list of words, templates by regular expressions over the words in a row."""
    phrases = [(p.split(), label) for p, label in PHRASES.items()]
    stand = lambda words: " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(words))
    of_phrase = [f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {stand(words)}), lambda i: {{'at': CAST(i - 1 AS BIGINT), 'label': '{label}'}})" for words, label in phrases]
    places = f"flatten([{', '.join(of_phrase)}])"
    found = ", ".join(f"CASE WHEN regexp_matches(line, ' {template_regex(licenses.parsed(t))}') THEN '{label}' END" for label, t in TEMPLATES)
    joined = lambda x: f"array_to_string(list_sort(list_distinct({x})), ',')"
    return rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
lines AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS line FROM words),
hits AS (SELECT *, {places} AS base, list_filter([{found}], lambda x: x IS NOT NULL) AS more FROM lines)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(base) AS BIGINT) AS n_base, list_min(list_transform(base, lambda p: p['at'])) AS first_word, list_max(list_transform(base, lambda p: p['at'])) AS last_word,
{joined("list_transform(base, lambda p: p['label'])")} AS base_labels, {joined("list_concat(list_transform(base, lambda p: p['label']), more)")} AS labels,
CASE WHEN len(more) > 0 THEN CAST(1 AS DOUBLE) WHEN len(base) > 0 THEN 0.5 ELSE 0 END AS score FROM hits
"""


DIVERGENCE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
              regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
said AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM said GROUP BY ALL HAVING count(DISTINCT r) >= 3),
cell AS (SELECT lang, source, term, count(*) AS n FROM said JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM docs),
size AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM grp LEFT JOIN cell USING (lang, source) GROUP BY ALL),
voc AS (SELECT lang, count(*) AS terms, sum(lang_n) AS lang_total FROM kept GROUP BY ALL),
dense AS (SELECT size.lang, size.source, kept.term, coalesce(n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 1)) // (total + terms) AS p,
                 1 + (CAST(1000000000 AS HUGEINT) * (lang_n + 1)) // (lang_total + terms) AS q
          FROM size JOIN voc USING (lang) JOIN kept USING (lang) LEFT JOIN cell ON cell.lang = size.lang AND cell.source = size.source AND cell.term = kept.term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source),
marks AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM dense WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM marks))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

FILTERS_SQL = r"""
WITH said AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
lab AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
mask AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
                + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
                + CASE WHEN said.doc_id > min(said.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS m
         FROM said LEFT JOIN lab ON said.doc_id = lab.doc_id),
cell AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM mask GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(f, bit)),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
           FROM f a JOIN f b ON b.bit <> a.bit JOIN f c ON c.bit NOT IN (a.bit, b.bit) JOIN f d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN f e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
steps AS (SELECT filter_order, CAST(s AS INTEGER) AS step, substr(filter_order, s, 1) AS filter, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0) AS before FROM orders, range(1, 6) AS r(s)),
done AS (SELECT part, filter_order, step, filter,
                sum(CASE WHEN m & CAST(before + bit AS INTEGER) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN m & CAST(before AS INTEGER) = 0 AND m & bit > 0 THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN m & CAST(before AS INTEGER) > 0 AND m & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN m & CAST(before AS INTEGER) = 0 AND m & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN m & CAST(before AS INTEGER) = 0 AND m & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
         FROM cell, steps GROUP BY ALL)
SELECT part, filter_order, step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM done
"""

def shards_sql(limit: int) -> str:
    """Shards of ``limit`` bytes. No key alone is larger at the driver's sizes, so there are no pages."""
    return f"""
WITH rows AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
above AS (SELECT d, h >> (60 - d) AS node, sum(n_bytes) AS total, min(h) <> max(h) AS splits
          FROM rows, range(0, 61) AS t(d) GROUP BY 1, 2),
leaf AS (SELECT h, coalesce(max(d) FILTER (total > {limit} AND splits) + 1, 0) AS depth
         FROM rows JOIN above ON rows.h >> (60 - d) = node GROUP BY h)
SELECT doc_id, n_bytes, CAST(depth AS INTEGER) AS depth, h >> (60 - depth) AS bucket, CAST(0 AS BIGINT) AS page,
       CAST(total AS BIGINT) AS shard_bytes, total > {limit} AS oversized
FROM rows JOIN leaf USING (h) JOIN above ON depth = d AND h >> (60 - depth) = node
"""


ORACLE_SQL: dict[str, str] = {
    "op11_license_templates": licenses_sql(),
    "op12_source_divergence": DIVERGENCE_SQL,
    "op13_filter_audit": FILTERS_SQL,
    "op1_extendible_sharding": shards_sql(SHARD_BYTES),
    "sharding_of_small_shards": shards_sql(SMALL_SHARD_BYTES),
    "op6_pivot_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
}
