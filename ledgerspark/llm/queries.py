"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm.common import documents

#: Folder of the public vocabulary files; a parameter, never copied.
TOKENIZERS_DIR = "/opt/tokenizers"
#: Verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def vocabulary(name: str, folder: str | None = None) -> str:
    if folder is None and importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(folder or TOKENIZERS_DIR, name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerspark.llm.token_files import token_file_query

    return token_file_query(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), 2)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerspark.llm.fingerprint import fingerprint_report

    return fingerprint_report(documents(spark, sf_dir))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerspark.llm.mixing import mix_report

    return mix_report(documents(spark, sf_dir))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerspark.llm.url_filter import judge_urls

    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerspark.llm.quality import quality_report

    return quality_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerspark.llm.nearest import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerspark.llm.licences import scan_licences

    return scan_licences(documents(spark, sf_dir))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerspark.llm.language import language_report

    return language_report(documents(spark, sf_dir))


def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerspark.llm.shingle_join import component_report

    return component_report(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerspark.llm.packing import pack

    return pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), 2)


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_fingerprints": op2_fingerprints,
    "op3_source_mix": op3_source_mix,
    "op4_url_filter": op4_url_filter,
    "op5_quality": op5_quality,
    "op6_nearest": op6_nearest,
    "op7_licences": op7_licences,
    "op8_language": op8_language,
    "op9_shingle_join": op9_shingle_join,
    "op10_packing": op10_packing,
}

VALID = "embedding IS NOT NULL AND len(embedding) > 0 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))"
OP6 = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND {VALID}),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_cosine_similarity(q.e, c.e) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5"""

OP3 = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-0-' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nr FROM sizes),
weighed AS (SELECT *, CASE (nr - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM ranked),
sums AS (
  SELECT *, 3 * sum(source_size) OVER () AS goal, sum(weight) OVER () AS all_weight,
         coalesce(sum(source_size) OVER before, 0) AS sizes_before, coalesce(sum(weight) OVER before, 0) AS weights_before
  FROM weighed WINDOW before AS (ORDER BY source_size / weight, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT *, 4 * source_size * (all_weight - weights_before) <= weight * (goal - 4 * sizes_before) AS is_full FROM sums),
rest AS (SELECT *, sum(CASE WHEN is_full THEN source_size ELSE 0 END) OVER () AS fs, sum(CASE WHEN is_full THEN weight ELSE 0 END) OVER () AS fw FROM filled),
targets AS (
  SELECT source, source_size, nr, CASE WHEN is_full THEN CAST(2 * source_size AS DOUBLE)
         ELSE CAST(weight * (goal - 4 * fs) AS DOUBLE) / CAST(2 * (all_weight - fw) AS DOUBLE) END AS target FROM rest),
placed AS (
  SELECT d.doc_id, d.size, d.source, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS words,
         CAST(sum(d.size) OVER (PARTITION BY t.nr ORDER BY key, d.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, source,
       CAST(greatest(0, least(start + size, words) - start) + greatest(0, least(start + size, words - source_size) - start) AS BIGINT) AS taken
FROM placed"""



def op7_sql() -> str:
    """Plain search: every word of every text, every phrase and every alignment of a template, without index or IDF."""
    from ledgerspark.llm.licences import COMMON, PHRASES, TEMPLATES

    rows = lambda values: ", ".join(values)
    words = lambda text: "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"
    posts, sizes = [], []
    for t, (text, key, label) in enumerate(TEMPLATES):
        listed = text.split()
        begin = f" {text} ".index(f" {key} ")
        first = len(text[:begin].split())
        indexed = [(i, w) for i, w in enumerate(listed) if w not in COMMON]
        inside = [i for i, _ in indexed if first <= i < first + len(key.split())]
        posts += [f"('{w}', {t}, {i}, {str(i in inside).lower()})" for i, w in indexed]
        sizes.append(f"({t}, {len(indexed)}, {len(inside)}, '{label}')")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
w AS (SELECT rid, unnest(words) AS w, unnest(range(len(words))) AS i FROM d),
phrases(label, ph) AS (VALUES {rows(f"('{label}', {words(text)})" for text, label in PHRASES)}),
places AS (SELECT w.rid, w.i, p.label FROM w JOIN phrases p ON w.w = p.ph[1] JOIN d USING (rid) WHERE d.words[w.i + 1 : w.i + len(p.ph)] = p.ph),
base AS (SELECT rid, count(*) AS n, min(i) AS lo, max(i) AS hi, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY rid),
posts(w, t, p, is_key) AS (VALUES {rows(posts)}),
sizes(t, n_words, n_keys, label) AS (VALUES {rows(sizes)}),
votes AS (SELECT w.rid, t, w.i - p AS o, count(*) AS n, count(*) FILTER (is_key) AS keys FROM w JOIN posts USING (w) GROUP BY w.rid, t, w.i - p),
own AS (SELECT rid, list(DISTINCT label) AS labels, max(n / n_words) AS part FROM votes JOIN sizes USING (t) WHERE keys = n_keys AND n >= 0.8 * n_words GROUP BY rid)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(b.n, 0) AS n_base, b.lo AS first_word, b.hi AS last_word,
       coalesce(array_to_string(b.labels, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(o.labels, [])))), ',') AS labels,
       CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(o.part, 0.0) END AS score
FROM d LEFT JOIN base b USING (rid) LEFT JOIN own o USING (rid)"""


ORACLES: dict[str, str] = {"op3_source_mix": OP3, "op6_nearest": OP6, "op7_licences": op7_sql()}
