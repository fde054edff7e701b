import os
import random

import corpus_pipeline
from daybrook.llm import queries
from tests.llm.rows import awkward, documents, edited, sentence

SF = "/root/testdata/sf0.001"


def test_stages_decide_one_after_the_other(spark, tmp_path):
    pick = random.Random(1)
    base, item = sentence(pick, 120), sentence(pick, 40)
    rows = [(i, sentence(pick, 30) + (" vileword rottenword" if i % 4 == 0 else "")) for i in range(400)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(400)]
    rows += [(500, base), (501, base), (502, edited(pick, base, 0.01)), (600, sentence(pick, 20) + " " + item), (700, None), (701, ""), (None, "no id")]
    spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id LONG, text STRING").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents(spark, rows)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "pieces":
            assert docs.columns == columns
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {i: t or "" for i, t in rows if not (i is not None and i < 400 and i % 4 == 0) and i not in (500, 502, 600, 700)}
    assert got == want


def test_stages_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id LONG, text STRING").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in ([], awkward(random.Random(2))):
        docs = documents(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert bool(docs.collect()) == bool(rows)


def test_every_operator_is_registered():
    assert [name.split("_")[0] for name in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{n}" for n in range(1, 14)]
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_run_on_the_small_table(spark):
    if os.path.isdir(SF):
        got = corpus_pipeline.run(spark, SF)
        assert got.columns == ["doc_id", "ids", "n_ids", "text"] and got.count() > 50
