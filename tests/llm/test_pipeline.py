import random

import corpus_pipeline as P
import pytest
from conftest import sentence

from lodestone.llm import mixing


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(2)
    item = sentence(rng, 30)
    docs, labels = [], []
    for k in range(400):
        toxic = k % 5 == 0
        t = sentence(rng, 60) + (" nastyword vilething nastyword" if toxic else "")
        docs.append((k, t, "en", f"s{k % 4}", len(t), "extra", 1.0))
        labels.append((k, 1, int(toxic)))
    copy = docs[1][1]
    docs += [(1000, copy, "en", "s1", 5, "e", 1.0), (1001, copy + " tail", "en", "s1", 5, "e", 1.0), (1002, "word " + item, "en", "s2", 5, "e", 1.0), (1003, "123 456", "en", "s2", 5, "e", 1.0), (1004, None, "en", "s2", 5, "e", 1.0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, predicted string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    frame, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = frame.columns
    for name, stage in P.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        if name != P.STAGES[-1][0]:
            assert frame.columns == columns
        path = f"{tmp_path}/{name}"
        frame.write.parquet(path)
        frame = spark.read.parquet(path)
        seen[name] = {r.doc_id for r in frame.select("doc_id").collect()}
    clean = {k for k in range(400) if k % 5}
    assert seen["toxicity"] == clean | {1000, 1001, 1002, 1003, 1004}
    assert seen["language"] == clean | {1000, 1001, 1002}
    assert seen["duplicates"] == clean | {1002}
    assert seen["decontamination"] == clean == seen["mixing"]
    got = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == clean
    kept = spark.createDataFrame([d for d in docs if d[0] in clean], "doc_id long, text string, lang string, source string, n_chars long, a string, b double")
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.mix(kept).collect())


def test_repeated_rows_and_null_ids_leave_one(spark):
    """Copies with equal ids, without ids, and near copies leave one row; the least id, null last; other columns come along."""
    rng = random.Random(4)
    a, b, c = (sentence(rng, 40) for _ in range(3))
    rows = [(1, a, "x"), (1, a, "x"), (2, a, "y"), (None, a, "z"), (None, b, "n"), (None, b, "n"), (7, c, "p"), (7, c + " more", "q"), (8, None, "e"), (8, None, "e"), (9, "", "e"), (None, None, "e"), (3, "one two", "s"), (3, "three four", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "", r.component_id) for r in P.duplicates_stage(spark, docs, "").collect()))
    kept = [r for r in got if r[1] != 7]
    assert kept == sorted([(False, 1, a, "x"), (True, 0, b, "n"), (False, 8, "", "e"), (False, 8, "", "e"), (False, 9, "", "e"), (True, 0, "", "e"), (False, 3, "one two", "s"), (False, 3, "three four", "s")])
    assert len([r for r in got if r[1] == 7]) == 1


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_empty_documents(spark, tmp_path, name):
    d = str(tmp_path)
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert dict(P.STAGES)[name](spark, docs, d).collect() == []


def test_duplicates_over_rows_in_changing_order(spark):
    """Rows dealt round robin come in another order whenever they are computed again; the stage tells them apart all the same."""
    rng = random.Random(12)
    texts = [sentence(rng, 40) for _ in range(150)]
    rows = [(k, texts[k % 150]) for k in range(300)] + [(1000 + k, sentence(rng, 40)) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted(r.doc_id for r in P.duplicates_stage(spark, docs, "").collect())
    assert got == [*range(150), *range(1000, 1100)]
