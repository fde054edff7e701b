import hashlib
import random
from collections import defaultdict

from daybrook.llm import exact
from tests.llm.rows import awkward, documents


def test_copies_match_brute_force(spark):
    rows = awkward(random.Random(1)) + [(300 + i, "same text") for i in range(400)]
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    by_sha = {hashlib.sha256(text.encode()).hexdigest(): ids for text, ids in groups.items()}
    got = exact.copies(documents(spark, rows)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    for row in got:
        ids = by_sha[row["text_sha256"]]
        largest = max((i for i in ids if i is not None), default=None)
        assert row["doc_id"] in ids and row["group_size"] == len(ids) and row["keep_id"] == largest and row["kept"] == (row["doc_id"] == largest)


def test_drop_copies_keeps_one_row_of_each_text_with_all_columns(spark):
    rows = awkward(random.Random(2))
    docs = documents(spark, rows)
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    got = [(r["text"] or "", r["doc_id"]) for r in left.collect()]
    assert sorted(got, key=str) == sorted(((text, max((i for i in ids if i is not None), default=None)) for text, ids in groups.items()), key=str)


def test_empty_table_and_no_python(spark):
    docs = documents(spark, [])
    assert exact.copies(docs).collect() == [] and exact.drop_copies(docs).collect() == []
    plan = exact.copies(documents(spark, [(1, "a"), (2, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
