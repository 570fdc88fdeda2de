"""The pipeline's stages on odd rows and on the smallest tables."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_llm import SCHEMA, components, odd_texts, prose, shingles


@pytest.fixture(scope="module")
def raw(spark):
    made = [(i, t, "en", "s", len(t or ""), *["x"] * 13) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(made + made[:3] + [(None, *made[2][1:])], SCHEMA)


def test_stages_keep_the_columns(spark, sf_dir, raw):
    docs = raw
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == raw.columns, name
        docs = spark.createDataFrame(docs.collect(), SCHEMA)
    assert corpus_pipeline.encode(spark, docs, sf_dir).where("NOT round_trip").count() == 0


def test_near_copies_leave_one(spark, sf_dir, raw):
    kept = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, raw, sf_dir).collect()]
    smallest = components({i: shingles(t) for i, t in enumerate(odd_texts())})
    assert sorted(i for i in kept if i is not None) == sorted(set(smallest.values()))
    assert kept.count(None) == 1


def test_near_copies_go_for_their_own_text_only(spark, sf_dir):
    rng = random.Random(4)
    a, b, c = (prose(rng, 40) for _ in range(3))
    near = a + " more"
    rows = [(1, a, "x"), (1, b, "x"), (2, a, "y"), (1, a, "z"), (3, c, "x"), (3, "", "x"), (3, None, "x"), (4, near, "x"), (4, c, "x")]
    rows += [(5, b, "x"), (5, b + " end", "x"), (6, c, "x"), (None, a, "x"), (None, a, "x"), (7, "few words", "x"), (7, "few words", "y")]
    rows += [(8, a + " also", "x"), (9, near, "x"), (10, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf_dir).select("doc_id", "text").collect()
    expected = [(1, a), (1, b), (3, c), (3, ""), (3, None), (None, a), (None, a), (7, "few words"), (10, None)]
    assert sorted(map(tuple, kept), key=repr) == sorted(expected, key=repr)
    none = corpus_pipeline.drop_near_copies(spark, docs.select("doc_id", F.lit(None).cast("string").alias("text"), "gone_id"), sf_dir)
    assert none.count() == len(rows)


def test_one_id_with_near_copies_of_itself(spark, sf_dir):
    a = prose(random.Random(7), 60)
    docs = spark.createDataFrame([(1, a), (1, a + " x"), (1, a + " y"), (2, a + " z")], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()
    assert len(kept) == 1 and kept[0].doc_id == 1


def test_encode_keeps_columns_of_its_names(spark, sf_dir):
    docs = spark.createDataFrame([(1, "some text", "a", "b")], "doc_id long, text string, IDS string, doc_ids string")
    row = corpus_pipeline.encode(spark, docs, sf_dir).first()
    assert row.doc_doc_IDS == "a" and row.doc_ids == "b" and len(row.ids) == row.n_tokens


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_empty_tables(spark, sf_dir, name, stage):
    assert stage(spark, spark.createDataFrame([], SCHEMA), sf_dir).count() == 0


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.where("NOT round_trip").count() == 0 and rows.count() > 0
