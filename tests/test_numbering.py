import random

from pyspark.sql import functions as F

from daybrook.operators import numbering


def test_sums_before_each_row(spark):
    pick = random.Random(1)
    rows = [(pick.choice([None, 0, 1, 2, 9]), k, pick.choice([None, 1, 5])) for k in range(500)]
    df = spark.createDataFrame(rows, "a LONG, k LONG, v LONG")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = numbering.before(df, [F.col("a"), F.desc("k")], {"seen": F.lit(1), "v_before": F.col("v")})
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    seen = total = 0
    want = {}
    for a, k, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1])):
        want[k] = (seen, total)
        seen, total = seen + 1, total + (v or 0)
    assert {r["k"]: (r["seen"], r["v_before"]) for r in got.collect()} == want
    assert set(got.columns) == {"a", "k", "v", "seen", "v_before"}
    within = numbering.within(df, ["a"], [F.desc("k")], "n").collect()
    for a in {r[0] for r in rows}:
        assert [r["n"] for r in sorted((r for r in within if r["a"] == a), key=lambda r: -r["k"])] == list(range(1, 1 + sum(r[0] == a for r in rows)))


def test_empty_and_equal_rows(spark):
    df = spark.createDataFrame([], "a LONG")
    assert numbering.numbered(df, [F.col("a")], "n").collect() == []
    same = spark.createDataFrame([(1,)] * 50, "a LONG")
    assert sorted(r["n"] for r in numbering.numbered(same, [F.col("a")], "n").collect()) == list(range(1, 51))


def test_unreadable_clocks_spread_over_all_tasks(spark, monkeypatch):
    from daybrook.plans import prompts
    from tests.test_rollup import events, note
    seen = []
    own = numbering.materialize
    monkeypatch.setattr(numbering, "materialize", lambda df, name: seen.append((name, own(df, name))) or seen[-1][1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = events(spark, [note("not a time", None, f"say {k}") for k in range(2000)])
    waiting = rows.withColumn("attribution", F.struct(F.lit(None).cast("string").alias("project_id"), F.lit(0.0).alias("confidence"), F.lit("needs_review").alias("method")))
    got = prompts.review_index(waiting, 150).select("batch_no", "idx").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got)) == [(k // 150, k % 150) for k in range(2000)]
    sizes = [r["count"] for r in dict(seen)["ranges"].groupBy("_part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1000
