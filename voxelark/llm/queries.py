"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, language_model, neighbours, packing, secrets, suffix_dedup, toxicity, url_filter, warc
from .common import table
from .language_model import held_out


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document. Null and empty texts have no spans; long texts are scanned whole; repeated rows get a row each; an empty table gives none; further columns are not looked at."""
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document. Null and empty texts score as a window without words; without labels of both kinds all scores are 0; repeated rows score alike; further columns are not looked at."""
    documents = table(spark, sf_dir, "documents")
    net = toxicity.fit(*toxicity.training_rows(documents, table(spark, sf_dir, "labels")))
    scored = toxicity.score_texts(documents, net, ["doc_id"])
    held = held_out(F.col("doc_id"), 5, 0)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document. Null texts have no words; items without words have no windows; repeated rows and items stay as they are; further columns are not looked at."""
    return decontaminate.digest(decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"]))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document. Null and blank texts have no shingles and link with nothing; copies and repeated rows are one class; null ids take part in links; an empty table gives no rows."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document. Null, empty and short texts keep all; equal texts of 200 bytes cover each other; repeated rows are copies; an empty table gives no rows."""
    return suffix_dedup.digest(suffix_dedup.repeated_spans(table(spark, sf_dir, "documents")))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows a query at most. Null ids, and vectors that are null, zero or hold null or non-finite numbers, take no part; ties go to the smaller id; repeated rows count once; empty tables give no rows."""
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.filter("vec_id % 100 = 0"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a page. Null html is empty; pages without an id are responses; repeated rows of the largest id are all responses; an empty table gives no rows; further columns are not looked at."""
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a page. Null urls and those without `://` have empty hosts and paths and no rule; repeated rows get a row each; an empty table gives none."""
    rules = spark.createDataFrame(url_filter.CONTRACT_RULES, "host string, path string, action string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a piece. Null and empty texts are their end id alone; long texts are cut, none dropped; repeated rows are packed each; an empty table has no sequences."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document. Null and empty texts are their end token; null ids are training documents; repeated rows count and are scored each; an empty table gives no rows."""
    return language_model.score_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_toxicity, op3_benchmark_decontamination, op4_jaccard_join, op5_suffix_dedup, op6_nearest_neighbours, op7_warc, op8_url_filter, op9_best_fit_packing, op10_lm_scores)}

_OP8_SQL = """
WITH rules(host, path, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
best AS (SELECT p.page_id, p.host, p.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.action, length(r.host || r.path)) AS action
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.page_id, p.host, p.path)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(action, 'allow') AS verdict FROM best
"""

_OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM windows),
places AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m),
hits AS (SELECT p.doc_id, p.i, p.m, x.item_id FROM (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM places) p JOIN windows x USING (m, win)),
n AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS word FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, x.b FROM reach r JOIN sym x ON x.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.m AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) m USING (doc_id)
"""

ORACLE = {"op4_jaccard_join": _OP4_SQL, "op8_url_filter": _OP8_SQL, "op3_benchmark_decontamination": _OP3_SQL}
