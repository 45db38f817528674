import os

import pytest

import corpus_pipeline
from retort.llm import decontamination, near_dedup
from retort.llm.staging import Staging

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages_take_effect(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    stage, docs, seen = Staging(spark), documents, {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = stage.put(function(spark, docs, SF), name)
        assert docs.columns == documents.columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in seen["quality"] for i in good) >= 0.97 * len(good)
    assert len(set(seen["exact_dedup"].values())) == len(seen["exact_dedup"]) and set(seen["exact_dedup"].values()) == set(seen["quality"].values())
    assert all(r["kept"] for r in near_dedup.near_dedup(stage.spark.read.parquet(f"{stage.root}/near_dedup")).collect())
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert not any(r["contaminated"] for r in decontamination.contamination(docs, bench).collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == set(seen["decontamination"])


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _keep string, score double, sequence_id long, _t long, id long"


def _tables(spark, folder, rows):
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "this passage of ten words is in the test set"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_stages_of_odd_rows(spark, tmp_path):
    more = ("x", 0.5, 7, 8, 9)
    words = " ".join(f"w{i}" for i in range(60))
    leak = "before it this passage of ten words is in the test set and behind"
    long = "be " * 30_000
    texts = [(1, None), (2, ""), (3, words), (4, words), (5, words + " more"), (5, words + " more"), (None, words), (None, None), (6, leak), (7, long), (8, "one"), (9, " \n")]
    _tables(spark, tmp_path, [(i, t, None, "s", None if t is None else len(t), *more) for i, t in texts])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stage, ids = Staging(spark), {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = stage.put(function(spark, docs, str(tmp_path)), name)
        kept = docs.collect()
        assert docs.columns == COLUMNS.replace(" long", "").replace(" string", "").replace(" double", "").split(", ")
        assert all((r["_keep"], r["score"], r["_t"]) == ("x", 0.5, 8) for r in kept)
        ids[name] = [r["doc_id"] for r in kept]
    assert len(ids["quality"]) == 12 and sorted(i for i in ids["exact_dedup"]) == [1, 3, 5, 6, 7, 8, 9]
    assert sorted(ids["near_dedup"]) == [1, 3, 6, 7, 8, 9] and sorted(ids["decontamination"]) == [1, 3, 7, 8, 9]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == {1, 3, 7, 8, 9}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    _tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
