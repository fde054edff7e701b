import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import Window
from pyspark.sql import functions as F

from daybrook.operators import sessions
from daybrook.session import work_dir
from daybrook.streaming import jobs
from tests.test_gate import NOW, events
from tests.test_sources import report

BASE = datetime(2026, 6, 21, 9, tzinfo=timezone.utc)


def test_gate_stream_appends_like_the_batch(spark):
    src, root, state = (work_dir(spark, n) for n in ("src", "root", "state"))
    rows = events(spark, [("NARRATION", {"note": f"token=abc {i}"}) for i in range(6)] + [("FILE_CHANGE", {"path": "/no/x"})])
    rows.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    jobs.run(jobs.gate_stream(stream, ["/w"], root, state, passed_at=NOW), once=True).awaitTermination()
    assert spark.read.parquet(f"{root}/events").count() == 6 and spark.read.parquet(f"{root}/drops").count() == 1


def test_report_stream_reads_a_drop_folder(spark, tmp_path):
    import json
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps([report(), report(ts_wall="2027-01-01T00:00:00Z")], indent=2))
    (tmp_path / "in" / "b.json").write_text("{nope")
    out, state = work_dir(spark, "trust"), work_dir(spark, "trust-state")
    stream = jobs.read_report_stream(spark, str(tmp_path / "in"))
    jobs.run(jobs.trust_stream(stream, out, state, now="2026-06-21T12:00:00+03:00"), once=True).awaitTermination()
    got = {r["trust"]: r["count"] for r in spark.read.parquet(out).groupBy("trust").count().collect()}
    assert got == {"validated": 1, "low_trust": 1, "rejected": 1}


def test_coalescing_with_state_equals_the_batch_fold(spark):
    rnd = random.Random(4)
    rows, t = [], 0
    for i in range(200):
        t += rnd.choice([100_000, 900_000, 2_500_000])
        rows.append((f"p{rnd.randint(0, 2)}", t, i, i // 50))
    df = spark.createDataFrame(rows, "path STRING, us LONG, arrival_seq INT, part INT")
    src = work_dir(spark, "changes")
    for part in range(4):                       # one file after the other, in time order
        df.where(F.col("part") == part).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = jobs.collect_table(jobs.coalesce_stream(stream, 2.0), "coalesced")
    batch = sessions.coalesce_changes(df.withColumn("ts", F.timestamp_micros("us")), ["path"], arrival="arrival_seq")
    assert sorted(r["arrival_seq"] for r in got.collect()) == sorted(r["arrival_seq"] for r in batch.collect())


def test_gap_sessions_hold_back_only_the_open_ones(spark):
    rows = [("u", BASE + timedelta(minutes=m)) for m in (0, 10, 20, 200, 210, 600)]
    df = spark.createDataFrame(rows, "user STRING, ts TIMESTAMP")
    src = work_dir(spark, "gaps")
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    got = jobs.collect_table(jobs.gap_session_stream(stream, "ts", "user", "60 minutes", "0 seconds"), "gap-out")
    assert sorted(r["n_events"] for r in got.collect()) == [2, 3]


def test_repeated_batches_store_their_rows_once(spark):
    from daybrook.operators import timeline
    bronze, silver, root = (work_dir(spark, n) for n in ("bronze", "silver", "root"))
    rows = events(spark, [("NARRATION", {"note": f"n{i % 3}"}) for i in range(12)]).withColumn("n", F.monotonically_increasing_id())
    rows = rows.withColumn("event_id", F.when(F.pmod("n", F.lit(3)) == 0, F.lit("")).otherwise(F.concat(F.lit("e"), F.pmod("n", F.lit(5)).cast("string"))))
    rows = rows.drop("n").cache()
    parts = [rows.where("event_id = '' or event_id < 'e2'"), rows.where("event_id >= 'e1'")]
    write = jobs.rebuild_days(bronze, silver)
    for number in (0, 1, 1, 0):
        write(parts[number], number)
    whole = timeline.reconcile(parts[0].unionByName(parts[1]))
    assert spark.read.parquet(silver).count() == whole.count() and spark.read.parquet(silver).where("event_id = ''").count() == 4
    from daybrook.operators import gate
    from daybrook.sinks import store
    gated = gate.gate(rows, ["/w"], passed_at=NOW)
    for _ in range(2):
        store.append_events(gated, root, "stream-7")
    assert store.read_events(spark, root).count() == 12


def test_an_arrival_is_one_batch_whatever_its_files(spark, monkeypatch):
    from daybrook.operators import timeline
    from daybrook.plans import queries_flow
    from daybrook.plans.activity import activity
    rows = activity(spark, "/root/testdata/sf0.001")
    wanted, batches, set_to = timeline.reconcile(rows), [], []
    build, winners = jobs.rebuild_days, timeline.dedup_winners

    def noted(bronze, silver):
        write = build(bronze, silver)
        return lambda batch, number: (batches.append((number, batch.count())), write(batch, number))

    def seen(events):
        names = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
        set_to.append([events.sparkSession.conf.get(name) for name in names])
        return winners(events)
    monkeypatch.setattr(queries_flow, "activity", lambda *_: rows.repartition(20))
    monkeypatch.setattr(jobs, "rebuild_days", noted)
    monkeypatch.setattr(jobs, "SPLIT_ROWS", 10)
    monkeypatch.setattr(timeline, "dedup_winners", seen)
    told = [sorted((r["event_id"], r["arrival_seq"], r["date_key"]) for r in df.select("event_id", "arrival_seq", "date_key").collect())
            for df in (queries_flow.stream_timeline(spark, "/root/testdata/sf0.001"), wanted)]
    assert told[0] == told[1] and len(told[0]) > 500
    assert batches == [(k, rows.where(F.col("arrival_seq") % 2 == k).count()) for k in range(2)]
    # tasks behind the shuffles follow the rows; the stream's own session had fixed them
    assert [adaptive for adaptive, _ in set_to] == ["true", "true"] and all(int(parts) >= 50 for _, parts in set_to)


def test_settings_are_put_back(spark):
    names = {"spark.sql.codegen.hugeMethodLimit": "8000", "daybrook.unset": "1"}
    before = {name: spark.conf.get(name, None) for name in names}
    with jobs.settings(spark, names):
        assert {name: spark.conf.get(name) for name in names} == names
    assert {name: spark.conf.get(name, None) for name in names} == before and before["daybrook.unset"] is None


def test_days_found_by_look_up_equal_the_batch_timeline(spark):
    import os

    from daybrook.operators import timeline
    src, root = work_dir(spark, "src"), work_dir(spark, "days")
    days = ["2026-06-01", "2026-06-02", "2026-06-05", "soon"]
    rows = events(spark, [("NARRATION", {"note": f"n{i}"}) for i in range(40)]).withColumn("n", F.monotonically_increasing_id() % 1000)
    rows = rows.withColumn("n", F.row_number().over(Window.orderBy("payload.note", "event_id")) - 1)
    rows = rows.withColumn("event_id", F.when(F.col("n") % 10 == 3, F.lit("")).otherwise(F.concat(F.lit("e"), (F.col("n") % 17).cast("string"))))
    rows = rows.withColumn("ts_wall", F.element_at(F.array(*map(F.lit, days)), (F.col("n") % 3 + 1).cast("int"))).withColumn("recv_ts", F.concat(F.lit("2026-06-09T00:00:"), F.lpad((59 - F.col("n")).cast("string"), 2, "0"), F.lit("Z")))
    rows = rows.withColumn("ts_wall", F.when(F.col("n") == 30, F.lit("soon")).otherwise(F.col("ts_wall"))).persist()
    for part in (rows.where("n < 15"), rows.where("n >= 15 and n < 38"), rows.where("n >= 38")):
        part.drop("n").coalesce(1).write.mode("append").parquet(src)
        jobs.timeline_pipeline(spark.readStream.schema(rows.drop("n").schema).parquet(src), root)
    want = timeline.reconcile(rows.drop("n"))

    def told(df):
        return sorted((r["event_id"], r["recv_ts"], str(r["date_key"])) for r in df.collect())
    assert told(spark.read.schema(want.schema).parquet(f"{root}/silver")) == told(want) and len(told(want)) > 15
    silver = f"{root}/silver".removeprefix("file:")
    before = {d: os.listdir(f"{silver}/{d}") for d in os.listdir(silver) if d.startswith("date_key")}
    lone = rows.where("n = 0").drop("n").withColumn("event_id", F.lit("alone")).withColumn("ts_wall", F.lit("2026-07-01"))
    lone.coalesce(1).write.mode("append").parquet(src)
    jobs.timeline_pipeline(spark.readStream.schema(rows.drop("n").schema).parquet(src), root)
    assert all(os.listdir(f"{silver}/{d}") == names for d, names in before.items()) and len(os.listdir(silver)) > len(before)
    rows.unpersist()


def test_the_look_up_of_days_keeps_its_state_without_python(spark):
    src, out = work_dir(spark, "ids"), work_dir(spark, "pairs")
    schema, got = "event_id STRING, date_key STRING", []

    def put(batch, number):
        got.append({tuple(r) for r in batch.collect()})
    for rows in ([("a", "1"), ("a", "2"), ("", "3"), (None, "4")], [("a", "3"), ("b", "2"), ("", "3")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        found = jobs.touched_days(spark.readStream.schema(schema).parquet(src))
        assert "Python" not in found._jdf.queryExecution().logical().toString()
        found.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", out).trigger(availableNow=True).start().awaitTermination()
    assert got == [{("1", "1"), ("2", "1"), ("3", "3"), ("4", "4")}, {("1", "1"), ("2", "1"), ("3", "1"), ("2", "2"), ("3", "3")}]
