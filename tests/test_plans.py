from pyspark.sql import functions as F

from daybrook.functions import paths
from daybrook.operators import gate, rollup
from daybrook.plans import options
from daybrook.session import rows_within, spread, work_dir
from daybrook.sinks import store
from daybrook.streaming import jobs
from tests.test_gate import NOW
from tests.test_gate import events as raw_events
from tests.test_rollup import ROWS, WANT, events


def test_options():
    o = options.options_from({"synthesis": {"entry_batch": "Adaptive", "max_input_tokens": "auto", "summary_cadence": "often", "max_batch_days": 0}, "llm": {"model": "x:free"}})
    assert (o.entry_batch, o.max_input_tokens, o.summary_cadence, o.max_batch_days, o.write_entries) == ("adaptive", 6000, "off", 7, True)
    given = [options.options_from({"synthesis": {"max_input_tokens": v}}).max_input_tokens for v in ("junk", "12", None, 30, -5)]
    assert given == [0, 12, 0, 30, 0] and options.options_from({}) == options.WriteUpOptions()
    assert (options.tier_budget("x:free"), options.tier_budget("none")) == (6000, 16_000)


def test_policy_options():
    from daybrook.operators.diffs import CapturePolicy, policy_from
    assert policy_from(None) == CapturePolicy(max_lines=400, max_bytes=65_536)
    made = policy_from({"capture_diffs": 1, "diff_max_lines": "7", "ignore_globs": ["a", "b"]}, ["b", "c"])
    assert (made.capture_diffs, made.max_lines, made.ignore_globs) == (True, 7, ("b", "c", "a"))


def test_ignore_file(column):
    text = "# c\n\n *.sql \nbuild/\n" + "#\n" * 1000 + "late\n"
    assert column(lambda: paths.ignore_globs("v"), [text]) == [["*.sql", "build/"]]


def test_export_writes_the_document_in_order(spark):
    out = work_dir(spark, "export")
    store.export_lines(rollup.document_lines(events(spark, ROWS)), out, ["project_id", "date_key"], list(rollup.PLACE))
    rows = spark.read.text(out + "/project_id=app").collect()
    assert "\n".join(r[0] for r in rows) == WANT


def test_size_check_never_fetches_more(spark):
    df = spark.range(10)
    assert rows_within(df, 5) is None and len(rows_within(df, 10)) == 10


def test_stream_metrics(spark):
    src, out, state = (work_dir(spark, n) for n in ("m-src", "m-out", "m-state"))
    rows = raw_events(spark, [("NARRATION", {"note": "token=abc"}), ("FILE_CHANGE", {"path": "/no/x"})])
    rows.coalesce(1).write.parquet(src)
    gated = jobs.with_metrics(gate.gate(spark.readStream.schema(rows.schema).parquet(src), ["/w"], passed_at=NOW))
    q = jobs.run(gated.writeStream.format("parquet").option("path", out).option("checkpointLocation", state), once=True)
    q.awaitTermination()
    assert [m for _, _, m in jobs.progress_rows(q) if m] == [{"rows": 2, "dropped": 1, "redacted": 1}]
    assert spark.read.parquet(out).where(F.col("drop_reason").isNull()).count() == 1


def test_splits_are_bounded_by_rows(spark):
    path = work_dir(spark, "packed")
    spark.range(1000).coalesce(1).write.parquet(path)
    rows = spread(spark.read.parquet(path), 50)
    assert rows.rdd.getNumPartitions() == 20 and rows.count() == 1000
    assert spread(spark.read.parquet(path), 5000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_task_behind_a_shuffle_stays_small(spark):
    from daybrook.session import TASK_BYTES, prepare
    own = spark.newSession()
    prepare(own)
    assert own.conf.get(TASK_BYTES[0]) == "16m"
    # a size that the session names stands
    own.conf.set(TASK_BYTES[0], "8m")
    assert prepare(own).conf.get(TASK_BYTES[0]) == "8m"
