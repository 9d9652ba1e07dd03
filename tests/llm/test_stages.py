"""The pipeline's stages on odd tables, each alone and all in a row."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontam

SF = "/root/testdata/sf0.001"
ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions".split()
NAMES = ["_id", "_ID_", "_kept", "_hit", "_rejected", "predicted", "component_id", "item_id", "spans", "fp", "key", "stored"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with labels and benchmark, and documents with null ids, copies and clashing columns."""
    folder = str(tmp_path_factory.mktemp("stages"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(ITEM))], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    odd = [
        (None, "a line of its own about nothing in particular", "en", "src0", 10),
        (None, None, None, None, None),
        (900_001, None, "en", "src0", 0),
        (900_002, "", "en", None, None),
        (900_003, "repeated row of plain words", None, "src0", 3),
        (900_003, "repeated row of plain words", None, "src0", 3),
        (900_004, "before " + " ".join(ITEM) + " after", "en", "src0", 3),
        (900_005, "write to jane.doe@example.org today", "en", "src0", 3),
        (900_006, "long " + "word and more " * 40_000, "en", "src0", 3),
    ]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    return folder, docs


def wide(docs):
    return docs.select("*", *(F.lit(7).alias(n) for n in NAMES))


def plain(docs):
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stage_keeps_columns_and_takes_odd_rows(spark, tables, name, stage):
    folder, docs = tables
    got = stage(spark, wide(docs), folder)
    assert got.columns == wide(docs).columns
    # The same decisions without the other columns, and nothing from nothing.
    key = lambda r: str(r)
    expected = sorted(stage(spark, docs, folder).collect(), key=key)
    assert sorted(plain(got).collect(), key=key) == expected and len(expected) > 100
    assert {tuple(r) for r in got.select(*NAMES).distinct().collect()} == {(7,) * len(NAMES)}
    assert stage(spark, docs.limit(0), folder).collect() == []
    ids = [r.doc_id for r in expected]
    if name != "near_dedup":
        assert ids.count(900_003) == 2 and {900_001, 900_002, 900_006} <= set(ids)
    if name == "near_dedup":
        assert 900_002 not in ids
    assert (900_004 in ids) == (name != "decontamination")
    if name == "personal_data":
        assert all("jane.doe@example.org" not in (r.text or "") for r in expected)
        assert all(r.n_chars == len(r.text) for r in expected if r.doc_id == 900_005)


def test_packing_takes_odd_rows(spark, tables):
    folder, docs = tables
    packing = corpus_pipeline.STAGES[-1][1]
    got = packing(spark, wide(docs), folder).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert packing(spark, docs.limit(0), folder).collect() == []


@pytest.mark.parametrize("odd", [False, True])
def test_run_equals_its_stages(spark, tables, tmp_path, odd):
    folder, docs = tables
    base = docs if odd else docs.limit(0)
    wide(base).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    kept = {r.doc_id for r in got.collect()}
    if not odd:
        assert kept == set()
        return
    assert 900_003 in kept and 900_004 not in kept and 900_005 in kept
    assert decontam.contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).count() == 1
