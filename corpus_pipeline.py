"""Corpus pipeline: toxicity, near duplicates, decontamination, secrets, packing.

Every stage takes what the one before kept as ``docs`` and works on all of it. Further columns are
left behind, documents without an id or text go through like others, repeated rows stay unless
a stage says otherwise, texts are read whole, and empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelark.llm import decontaminate, jaccard, packing, secrets, toxicity
from voxelark.llm.common import dispose, materialize, scratch, small, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network, fitted on labelled ones among them, doesn't reject.

    Null, empty and wordless texts are scored as a window without words; repeated rows get one score;
    without labels of both kinds, or without documents, none is rejected.
    """
    net = toxicity.fit(*toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.score_texts(docs, net, COLUMNS).filter("score < 0.5").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id.

    Five-word shingles, similarity 0.8. A document is an id and a text: of rows that repeat both one
    stays, and rows of one id with different texts are judged each by its own text (ties go by
    the text's SHA-256). Rows without an id come after all others. Null and blank texts have no
    near duplicates.
    """
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16).alias("of"), F.col("text").isNull().alias("no_text"))
    docs = docs.select(COLUMNS).withColumn("key", key)
    with scratch(spark):
        found = jaccard.jaccard_components(docs, id_col="key", k=5, num=80, den=100)
        gone = materialize(found.filter("component_id <> key").select("key").distinct(), keep=True)
        again = materialize(found.groupBy("key").count().filter("count > 1").select("key").join(gone, "key", "left_anti"), keep=True)
    dispose(found)
    once = docs.join(small(gone.union(again)), "key", "left_anti")
    return once.union(docs.join(small(again), "key", "left_semi").dropDuplicates(["key"])).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window; null and wordless texts hold none, nor does any without items."""
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), COLUMNS).filter("size(hit_runs) = 0").select(COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and ``n_chars`` counted anew; null texts stay null, with null ``n_chars``."""
    return secrets.redact(docs.select(COLUMNS)).selectExpr("doc_id", "text", "lang", "source", "cast(char_length(text) as long) n_chars")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces packed into sequences; null and empty texts are their end id alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_texts), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("secret_scan", secret_scan), ("best_fit_packing", best_fit_packing),
]

#: Trained models and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's table goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, docs, sf_dir))
        dispose(before)
    out = STAGES[-1][1](spark, docs, sf_dir)
    dispose(docs)
    return out
