import random

import pytest

import corpus_pipeline as c
from voxelark.llm import jaccard

from .conftest import brute
from .test_models import texts


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = texts(random.Random(2), 400)
    item = " ".join(f"b{k}" for k in range(14))
    docs = [(i, t) for i, t, _ in rows] + [(1000, rows[1][1]), (1001, rows[4][1] + " " + item), (1002, 'password = "abcdefgh12345"'), (1003, None), (None, "no id"), (2, rows[2][1])]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 5) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, score int").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, {i for i, _, y in rows if y}


def test_stages(spark, tables):
    d, toxic = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stage = dict(c.STAGES)
    assert [n for n, _ in c.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secret_scan", "best_fit_packing"]
    kept = stage["toxicity"](spark, docs, d)
    ids = {i for i, _ in brute(kept)}
    assert kept.columns == c.COLUMNS and len(ids & toxic) <= 5 and len(ids) >= 0.95 * (405 - len(toxic))
    unique = stage["near_duplicates"](spark, docs, d)
    left = [i for i, _ in brute(unique)]
    assert 1000 not in left and 1 in left and left.count(2) == 1 and None in left and 1003 in left
    assert jaccard.jaccard_components(unique.filter("doc_id IS NOT NULL")).filter("doc_id <> component_id").count() == 0
    clean = stage["decontamination"](spark, docs, d)
    assert {i for i, _ in brute(docs)} - {i for i, _ in brute(clean)} == {1001}
    safe = dict(brute(stage["secret_scan"](spark, docs, d)))
    assert "abcdefgh12345" not in safe[1002] and safe[4] == dict(brute(docs))[4]


def test_rows_of_one_id_go_by_their_texts(spark, tables):
    rng = random.Random(4)
    text = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    a, b, d = text(60), text(60), text(60)
    rows = [(5, a), (5, a), (5, b), (6, b + " more"), (7, d), (None, d), (None, text(9)), (8, None), (8, ""), (8, "  ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string")
    kept = sorted(((-1 if i is None else i), t) for i, t in brute(c.near_duplicates(spark, docs, tables[0])))
    assert kept == sorted([(5, a), (5, b), (7, d), (-1, rows[6][1]), (8, ""), (8, ""), (8, "  ")])
    assert c.near_duplicates(spark, docs.filter("false"), tables[0]).count() == 0


def test_run(spark, tables):
    out = c.run(spark, tables[0])
    assert out.groupBy("sequence_id").sum("length").filter("`sum(length)` > 1024").count() == 0
    assert 1001 not in {r["doc_id"] for r in out.select("doc_id").collect()}
