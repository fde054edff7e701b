import os
import random

from pyspark.sql import functions as F

from daybrook.operators import audit, timeline
from daybrook.session import work_dir
from daybrook.sinks import store


def bodies(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "diff_clean STRING")


def test_a_batch_opens_only_the_shards_it_names(spark, monkeypatch):
    path = work_dir(spark, "diffs")
    store.append_diffs(bodies(spark, *(f"body {k}" for k in range(200)), None), path, "a")
    opened = []
    own = store.materialize
    monkeypatch.setattr(store, "materialize", lambda df, name: opened.append(own(df, name)) or opened[-1])
    store.append_diffs(bodies(spark, "body 7", "new one", "new one"), path, "b")
    fresh = {r["shard"] for r in spark.read.parquet(path).where("batch_id = 'b'").collect()}
    assert len(fresh) == 1 and len({r["shard"] for r in opened[0].collect()}) == 2
    store.append_diffs(bodies(spark, "body 7", "new one", "new one"), path, "b")        # again after a failure
    assert spark.read.parquet(path).count() == 201
    # a writer that did not see the other one
    beside = spark.read.parquet(path).where("batch_id = 'b'").withColumn("batch_id", F.lit("c"))
    store.overwrite_partitions(beside, path, "shard", "batch_id")
    assert spark.read.parquet(path).count() == 202 and store.read_diffs(spark, path).count() == 201


def test_no_bodies(spark):
    path = work_dir(spark, "diffs")
    store.append_diffs(bodies(spark, None), path, "a")
    assert not os.path.exists(path.removeprefix("file:")) or store.read_diffs(spark, path).count() == 0


def test_leak_samples_are_the_same_on_every_run(spark, capsys):
    rows = [(f"n{k}", ["kv_secret", "path"] if k % 2 else ["path"], f"t{k}") for k in range(300)]
    found = spark.createDataFrame(rows, "name STRING, codes ARRAY<STRING>, text STRING")
    some = audit.leak_samples(found, 7)
    first = sorted(map(tuple, some.collect()))
    assert first == sorted(map(tuple, audit.leak_samples(found.repartition(9), 7).collect()))
    assert [r[0] for r in first] == ["kv_secret"] * 7 + ["path"] * 7
    some.explain()
    assert "WindowGroupLimit" in capsys.readouterr().out
    assert audit.leak_samples(found.limit(0), 7).collect() == []


def test_sketches_of_days_give_the_quantiles(spark):
    from tests.test_gate import events
    pick = random.Random(6)
    late = [pick.randint(-50, 5000) for _ in range(4000)]
    rows = events(spark, [("NARRATION", {"note": "x"})]).drop("ts_wall", "recv_ts", "clock_offset_sec")
    many = rows.crossJoin(spark.createDataFrame([(k, f"2026-06-{k % 28 + 1:02d}T09:00:00Z", s) for k, s in enumerate(late)], "k INT, ts_wall STRING, s INT"))
    many = many.withColumn("recv_ts", F.when(F.col("k") % 100 == 0, F.lit("")).otherwise(F.date_format(F.to_timestamp("ts_wall") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("s").cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    sketches = timeline.lateness_sketches(many.withColumn("clock_offset_sec", F.lit("0")), "host", F.lit("h"))
    assert sketches.count() == 28
    got = timeline.lateness_quantiles(sketches, "host").first()
    kept = sorted(s for k, s in enumerate(late) if k % 100)
    assert got["n_events"] == len(kept)
    for name, rank in (("p50_sec", 0.5), ("p95_sec", 0.95)):
        place = sum(s < got[name] for s in kept) / len(kept)
        assert abs(place - rank) < 2 * timeline.RANK_ERROR
