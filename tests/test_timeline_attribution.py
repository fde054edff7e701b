import random

from pyspark.sql import functions as F

from daybrook.model import make_events, payload_of, source_of, validation_messages
from daybrook.operators import attribution, rulejoin, timeline


def log(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n INT, id STRING, ts STRING, recv STRING, off STRING, trust STRING")
    return make_events(df, type=F.lit("NARRATION"), source=source_of("os", "t"), ts_wall=F.col("ts"), payload=payload_of(note=F.col("n")),
                       recv_ts=F.col("recv"), event_id=F.col("id"), clock_offset_sec=F.col("off"), trust=F.col("trust"),
                       keep=("n",)).withColumnRenamed("n", "arrival_seq")


def order(spark, rows, **kw):
    return [r["arrival_seq"] for r in timeline.reconcile(log(spark, rows), ordered=True, **kw).collect()]


def test_order_by_own_time_with_offset_and_junk_last(spark):
    rows = [("a", "2026-06-21T14:00:00+03:00", "", "0", "validated"), ("b", "2026-06-21T10:00:00+03:00", "2026-06-21T14:05:00+03:00", "0", "validated"),
            ("c", "bad", "", "0", "validated"), ("d", "2026-06-21 09:00:00", "", "abc", "validated"), ("e", "2026-06-21T12:30:00+03:00", "", "-7200", "validated"),
            ("f", "2026-06-21T01:00:00Z", "", "0", "rejected")]
    assert order(spark, rows) == [1, 3, 0, 4, 2]
    assert len(order(spark, rows, keep_rejected=True)) == 6


def test_dedup_prefers_trust_then_receipt_then_arrival(spark):
    t = "2026-06-21T10:00:00Z"
    rows = [("a", t, "r2", "0", "low_trust"), ("a", t, "r9", "0", "validated"), ("b", t, "r2", "0", "validated"), ("b", t, "r1", "0", "validated"),
            ("c", t, "", "0", "validated"), ("c", t, "", "0", "validated"), ("d", t, "", "0", "validated"), ("d", t, "r5", "0", "validated"),
            ("e", t, "r1", "0", "strange"), ("e", t, "r0", "0", "low_trust"), ("", t, "", "0", "validated"), ("", t, "", "0", "validated")]
    assert sorted(order(spark, rows)) == [1, 3, 4, 7, 9, 10, 11]
    assert len(order(spark, rows, dedup=False)) == 12


def test_validation_messages(spark):
    df = spark.createDataFrame([("2", "NARRATION", "os", "a", "2026-01-01", "validated"), ("1", "X", "banana", "", "", "sure"), ("2", "NARRATION", "os", "a", "soon", None)],
                               "schema_version STRING, type STRING, kind STRING, adapter STRING, ts_wall STRING, trust STRING")
    got = [list(r["m"]) for r in df.select(validation_messages(kind="kind", adapter="adapter", source_is_object=F.lit(True)).alias("m")).collect()]
    assert got[0] == [] and len(got[1]) == 6 and got[1][0] == "schema_version must be 2" and got[2] == ["ts_wall is not a valid ISO-8601 timestamp"]


P = [{"id": "app", "signals": {"paths": ["C:\\Users\\dev\\proj\\app"], "git_remotes": ["github.com/acme/app"], "jira_prefixes": ["APP", "X-Y"],
                               "keywords": ["alpha", "beta", "gamma", "delta"], "apps": ["Code.exe"], "domains": ["app.example.com"],
                               "window_patterns": [".*board.*", "(bad", "(?P<n>zed)"]}},
     {"id": "web", "signals": {"paths": ["/home/dev/proj/web/"], "keywords": ["alpha", "omega"], "apps": ["chrome.exe"]}},
     {"id": "old", "status": "archived", "signals": {"paths": ["~/proj/old"]}}]
FIELDS = ("anchor", "process", "active_file", "path", "note", "repo", "message", "summary", "host", "cmdline")


def cases(spark, rows):
    df = spark.createDataFrame([(str(i), t, *[p.get(f) for f in FIELDS]) for i, (t, p) in enumerate(rows)], "id STRING, t STRING, " + ", ".join(f + " STRING" for f in FIELDS))
    return make_events(df, type=F.col("t"), source=source_of("os", "t"), ts_wall=F.lit("2026-01-01"), event_id=F.col("id"), payload=payload_of(**{f: F.col(f) for f in FIELDS}))


ROWS = [("FILE_CHANGE", {"path": "~/proj/app/src/a.py"}), ("FILE_CHANGE", {"path": "~/proj/app-v2/a.py"}), ("FILE_CHANGE", {"path": "~\\proj\\APP"}),
        ("GIT_COMMIT", {"repo": "x", "message": "fix app-12 now"}), ("GIT_COMMIT", {"repo": "x", "message": "fix XAPP-12 now"}), ("GIT_COMMIT", {"repo": "x", "message": "x-y-7"}),
        ("AGENT_REPORT", {"summary": "s", "repo": "GitHub.com/Acme/App"}), ("FOCUS_SESSION", {"anchor": "on App.example.com/x"}), ("FOCUS_SESSION", {"anchor": "the Board"}),
        ("NARRATION", {"note": "omega work"}), ("FOCUS_SESSION", {"anchor": "t", "process": "code.EXE"}), ("FOCUS_SESSION", {"anchor": "beta"}),
        ("FOCUS_SESSION", {"anchor": "beta gamma"}), ("FOCUS_SESSION", {"anchor": "beta gamma delta"}), ("FOCUS_SESSION", {"anchor": "alpha"}),
        ("FILE_CHANGE", {"path": "~/proj/old/x"}), ("IDLE_START", {}), ("FOCUS_SESSION", {}), ("FOCUS_SESSION", {"anchor": "zed"}), ("LONG_RUN", {"cmdline": "~/proj/web/run.sh"}),
        ("FOCUS_SESSION", {"anchor": "beta gamma delta alpha"})]
WANT = [("app", .95, "signal_path"), (None, 0, "needs_review"), ("app", .95, "signal_path"), ("app", .85, "signal_jira"), (None, 0, "needs_review"), ("app", .85, "signal_jira"),
        ("app", .82, "signal_git"), ("app", .80, "signal_domain"), ("app", .75, "signal_pattern"), ("web", .72, "signal_note"), ("app", .70, "signal_app"),
        ("app", .58, "signal_keyword"), ("app", .66, "signal_keyword"), ("app", .74, "signal_keyword"), (None, 0, "needs_review"), (None, 0, "needs_review"), (None, 0, None),
        (None, 0, "needs_review"), ("app", .75, "signal_pattern"), ("web", .95, "signal_path"), ("app", .78, "signal_keyword")]


def test_signal_scores(spark):
    got = attribution.attribute(cases(spark, ROWS), P).select(F.col("event_id").cast("int").alias("i"), "attribution.*").orderBy("i").collect()
    assert [(r["project_id"], r["confidence"], r["method"]) for r in got] == WANT
    tie = attribution.with_match(cases(spark, [ROWS[14]]), P).select("match.*").first()
    assert (tie["project_id"], tie["score"], tie["method"], tie["reason"]) == (None, .58, "ambiguous_tie", "tie between app, web")


def test_rule_joins_equal_inline_scoring(spark):
    cols = [F.col("event_id").cast("int").alias("i"), "match.*"]
    a = attribution.with_match(cases(spark, ROWS), P).select(*cols).orderBy("i").collect()
    b = rulejoin.with_match_joined(cases(spark, ROWS), P).select(*cols).orderBy("i").collect()
    assert a == b


def test_responses_fill_the_review_queue(spark):
    rows = attribution.attribute(cases(spark, ROWS), P)
    queue = {r["event_id"] for r in attribution.residue(rows).collect()}
    assert queue == {"1", "4", "14", "15"}
    said = spark.createDataFrame([("1", "web", "0.9"), ("4", "web", "0.4"), ("14", "made-up", "0.9"), ("0", "web", "0.99")], "event_id STRING, project_id STRING, confidence STRING")
    done = {r["event_id"]: r["attribution"] for r in attribution.apply_assignments(rows, said, ["app", "web"]).collect()}
    assert (done["1"]["project_id"], done["1"]["method"]) == ("web", "llm")
    assert (done["4"]["project_id"], done["4"]["confidence"], done["4"]["method"]) == (None, 0.4, "needs_review")
    assert done["14"]["project_id"] is None and done["0"]["project_id"] == "app"


def test_a_hot_id_is_one_row(spark):
    t = "2026-06-21T10:00:00Z"
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < .4 else f"x{i}", t, f"r{rnd.randint(0, 9)}", "0", "validated") for i in range(500)]
    got = order(spark, rows)
    hot = [i for i, r in enumerate(rows) if r[0] == "hot"]
    best = min(hot, key=lambda i: (rows[i][2], i))
    assert best in got and sum(i in hot for i in got) == 1


def test_shuffles_of_a_spread_table_start_with_as_many_partitions_as_its_splits(spark):
    from daybrook.session import spread
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name, None)
    try:
        spark.conf.unset(name)
        wanted = int(spark.conf.get("spark.sql.shuffle.partitions")) + 30
        spread(spark.range(wanted * 10), rows=10)
        assert int(spark.conf.get(name)) == wanted
        spread(spark.range(10), rows=10)
        assert int(spark.conf.get(name)) == wanted
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
