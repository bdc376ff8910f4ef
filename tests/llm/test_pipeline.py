"""The pipeline's stages in turn, on a folder of small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.llm.test_llm import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(6)
    langs = {"aa": vocabulary(200, 31), "bb": [w.replace("a", "ö") + "k" for w in vocabulary(200, 32)]}
    para = lambda k, n: " ".join(rng.choice(langs[k], n))
    rows = []
    for i in range(120):
        k = ("aa", "bb")[i % 2]
        rows.append((i, "\n".join(para(k, 30) for _ in range(3)), k, f"s{i % 3}"))
    item = para("aa", 40)
    rows[10] = (10, rows[10][1] + "\n" + item, "aa", "s1")
    rows += [(200, rows[0][1], "aa", "s0"), (201, rows[2][1].replace("\n", " "), "aa", "s2"), (202, None, "aa", "s0"), (203, "123 456", None, None), (204, para("bb", 50), None, None)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([("b1", item)], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = []
    for name, stage in C.STAGES:
        docs = C.materialize(stage(spark, docs, folder))
        left.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name != C.STAGES[-1][0]:
            assert docs.columns == COLUMNS
            assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
    language, line, join, bench, mix = left
    assert not {202, 203} & language and 204 in language and len(language) == 123
    assert 200 not in line and line == language - {200}  # all its lines stand in document 0
    assert 201 not in join and 2 in join
    assert bench == join - {10}
    assert mix <= bench and docs.agg(F.max("copies")).first()[0] <= 2


def test_run(spark, folder):
    got = C.run(spark, folder)
    assert set(COLUMNS) < set(got.columns) and got.count() > 60


def test_empty(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_copies_with_short_and_blank_lines_leave_no_husk(spark, folder):
    long = " ".join(vocabulary(30, 33))
    rows = [(1, f"Haanth.\n\n{long}"), (2, f"Haanth.\n\n{long}"), (3, f"{long}\nits own"), (4, "\n"), (5, None), (6, f"{long}\n--")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    got = {r["doc_id"]: r["text"] for r in C.line_stage(spark, docs, folder).collect()}
    assert got == {1: rows[0][1], 3: "its own", 4: "\n", 5: None}


def test_stages_with_repeats_nulls_and_clashing_columns(spark, folder):
    """Every stage takes repeated rows, nulls in any column and columns of the names used inside, and loses no clean row."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = [(None, None, None, None, None), (300, None, None, None, None), (301, "", None, None, 0), (301, "", None, None, 0)]
    docs = docs.unionByName(docs.where("doc_id in (4, 5)")).unionByName(spark.createDataFrame(odd, docs.schema))
    clash = ("_d", "_k", "_gone", "_key", "gone", "text_key", "n_hit", "hits", "row", "size_", "_lang_pred_", "_keep", "take", "whole", "key", "n_words")
    docs = docs.withColumns({c: F.lit(7) for c in clash})
    for name, stage in C.STAGES:
        before, docs = docs, C.materialize(stage(spark, docs, folder))
        assert docs.columns[: len(before.columns)] == before.columns
        assert docs.where(" and ".join(f"`{c}` = 7" for c in clash)).count() == docs.count()
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "language_id":
            assert {4, 5} < ids and not {300, 301, None} & ids and docs.where("doc_id = 4").count() == 2
    assert docs.count() > 60
