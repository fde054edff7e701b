import random

from pyspark.sql import functions as F

from daybrook.model import make_events, payload_of, source_of, with_keys
from daybrook.operators import rollup
from daybrook.plans import prompts, report
from daybrook.sources import registry

DAYS = [f"202606{d:02d}" for d in range(1, 11)]


def units(spark, days, **kw):
    df = spark.createDataFrame([("p", d, t) for d, t in days], "project_id STRING, date_key STRING, tokens BIGINT")
    out = {}
    for r in rollup.pack_days(df, **kw).orderBy("date_key").collect():
        out.setdefault(r["unit_no"], []).append(r["date_key"])
    return [len(v) for _, v in sorted(out.items())]


def test_packing(spark):
    small = [(d, 10) for d in DAYS]
    assert units(spark, small, mode="day") == [1] * 10
    assert units(spark, small, mode="adaptive", budget=0, max_days=3) == [3, 3, 3, 1]
    assert units(spark, small, mode="week", budget=0, max_days=7) == [7, 3]
    assert units(spark, [(d, 100) for d in DAYS[:4]] + [(DAYS[4], 9999), (DAYS[5], 1)], mode="adaptive", budget=250, max_days=30) == [2, 2, 1, 1]
    assert units(spark, [("20260601", 1), ("20260620", 1), ("junk", 1)], mode="adaptive", budget=0, max_days=7) == [1, 2]


def events(spark, rows):
    df = spark.createDataFrame([(f"e{i}", *r) for i, r in enumerate(rows)],
                               "id STRING, t STRING, ts STRING, pid STRING, anchor STRING, dur STRING, path STRING, msg STRING, files ARRAY<STRING>, note STRING")
    ev = make_events(df, type=F.col("t"), source=source_of("os", "t", "me"), ts_wall=F.col("ts"), event_id=F.col("id"), keep=("pid",), payload=payload_of(
        anchor=F.col("anchor"), duration_sec=F.col("dur"), path=F.col("path"), message=F.col("msg"), files=F.col("files"), note=F.col("note"), summary=F.col("msg"),
        satellites=F.when(F.col("t") == "DEEP_WORK", F.array(*[F.struct(F.lit(x).alias("title"), F.lit("").alias("process")) for x in "abcde"]))))
    a = F.struct(F.col("pid").alias("project_id"), F.lit(.9).alias("confidence"), F.lit("signal_path").alias("method"))
    return with_keys(ev.withColumn("attribution", a).drop("pid"))


def note(day, pid, text):
    return ("NARRATION", day, pid, None, None, None, None, None, text)


ROWS = [("FOCUS_SESSION", "2026-06-21T09:00:00Z", "app", "Editor", "12.7", None, None, None, None),
        ("DEEP_WORK", "2026-06-21T08:00:00Z", "app", None, "junk", None, None, None, None),
        ("GIT_COMMIT", "2026-06-21T10:00:00Z", "app", None, None, None, "fix", ["src/b.py", "src\\c.py"], None),
        ("FILE_CHANGE", "2026-06-21T11:00:00Z", "app", None, None, "~/x/a.py", None, None, None),
        ("FILE_CHANGE", "2026-06-21T11:30:00Z", "app", None, None, "~/y/b.py", None, None, None),
        ("AGENT_REPORT", "2026-06-21T12:00:00Z", "app", None, None, None, "did it", ["d.py", "a.py"], None),
        ("NARRATION", "2026-06-21T13:00:00Z", "app", None, None, None, None, None, "note one"),
        ("CLIPBOARD", "2026-06-21T13:30:00Z", "app", None, None, None, None, None, None),
        ("CLIPBOARD", "2026-06-21T13:40:00Z", "app", None, None, None, None, None, None),
        ("IDLE_START", "2026-06-21T14:00:00Z", "app", None, None, None, None, None, None),
        ("NARRATION", "2026-06-21T15:00:00Z", None, None, None, None, None, None, "nobody's"),
        ("NARRATION", "2026-06-21T15:00:00Z", "__unrelated__", None, None, None, None, None, "none")]
WANT = """---
## 2026-06-21

### Sessions
- 08:00 — session (0s) — also: a, b, c, d
- 09:00 — Editor (12s)

### Commits
- 10:00 — fix

### Agent activity
- 12:00 — me: did it

### Files changed
- a.py
- b.py
- c.py
- d.py

### Narration
- [13:00] "note one"

### Clipboard captures: 2

---
"""


def test_archive_document(spark):
    lines = rollup.document_lines(events(spark, ROWS)).orderBy(*[F.col(c) for c in rollup.PLACE]).collect()
    assert "\n".join(r["text"] for r in lines) == WANT
    assert rollup.archive_lines(events(spark, ROWS)).count() == 10


def test_merge_replaces_days_and_keeps_their_place(spark):
    def table(rows):
        return spark.createDataFrame(rows, "project_id STRING, date_label STRING, text STRING, label_pos BIGINT")
    old = table([("p", "2026-06-02", "two", 1), ("p", "2026-06-01", "one", 2)])
    new = table([("p", "2026-06-02", "two again", None), ("p", "2026-06-04", "four", None), ("p", "2026-06-03", "three", None), ("q", "2026-06-01", "q", None)])
    once_ = rollup.merge_sections(old, new)
    got = [(r["project_id"], r["label_pos"], r["text"]) for r in once_.orderBy("project_id", "label_pos").collect()]
    assert got == [("p", 1, "two again"), ("p", 2, "one"), ("p", 3, "three"), ("p", 4, "four"), ("q", 1, "q")]
    twice = rollup.merge_sections(once_.select("project_id", "date_label", "text", "label_pos"), new)
    assert sorted((r["project_id"], r["label_pos"], r["text"]) for r in twice.collect()) == got


def test_fingerprint(spark):
    rows = [("p", f"x{i}") for i in range(50)]

    def fp(data):
        df = spark.createDataFrame(data, "project_id STRING, v STRING").repartition(3)
        return rollup.fingerprint(df, ["project_id"], F.col("v")).first()["fingerprint"]
    mixed = rows[:]
    random.Random(2).shuffle(mixed)
    assert fp(rows) == fp(mixed)
    assert len({fp(rows), fp(rows[1:]), fp(rows + rows[:1]), fp(rows + rows[:1] * 2), fp(rows[1:] + [("p", "x0!")])}) == 5


def test_schedules(spark):
    df = spark.createDataFrame([("tue",), ("MON ",), ("daily",), ("typo",), (None,)], "d STRING")
    today = F.lit("2026-06-23").cast("date")
    assert [r[0] for r in df.select(rollup.is_due(F.col("d"), today)).collect()] == [True, False, True, True, True]
    runs = spark.createDataFrame([("22:30", "2026-06-23 22:30:00", None), ("22:30", "2026-06-23 22:29:00", None), ("22:30", "2026-06-23 23:00:00", "2026-06-23"),
                                  ("22:30", "2026-06-23 23:00:00", "2026-06-22"), ("25:00", "2026-06-23 23:00:00", None), ("x", "2026-06-23 23:00:00", None)],
                                 "t STRING, n STRING, l STRING")
    out = runs.select(rollup.run_is_due(F.col("t"), F.col("n").cast("timestamp"), F.col("l").cast("date"))).collect()
    assert [r[0] for r in out] == [True, False, False, True, False, False]


def test_report(spark):
    daily = spark.createDataFrame([(f"2026-06-{d:02d}", "app", f"day {d}", d) for d in range(1, 10)] + [("2026-06-09", "web", "nine", 9)],
                                  "run_date STRING, project_id STRING, paragraph STRING, run_seq BIGINT")
    numbered = report.sections(daily)
    one = report.standup_document(report.standup_lines(numbered), report.standup_title(report.select_sections(numbered), False), "body").first()[0]
    assert one == "## Daily standup — 2026-06-09\n\n- **app** — day 9\n- **web** — nine\n\n### Executive summary\nbody\n"
    weekly = report.select_sections(numbered, rollup=True)
    assert weekly.select("run_date").distinct().count() == 7
    assert report.standup_title(weekly, True).first()[0] == "## Work summary — 2026-06-03 → 2026-06-09"
    none = report.select_sections(numbered, date="1999-01-01")
    doc = report.standup_document(report.standup_lines(numbered, date="1999-01-01"), report.standup_title(none, False)).first()[0]
    assert doc == "## Work summary\n\n_No journal entries found for the requested period._\n"
    sums = spark.createDataFrame([("2026-W25", "# t\n\nweek"), ("2026-06", "# m\nmonth"), ("2026-W24", "old")], "period_key STRING, body STRING")
    assert tuple(report.newest_summary(sums, "week").first()) == ("2026-W25", "week") and report.newest_summary(sums, "month").first()["body"] == "month"
    pay = report.comment_payloads(spark.createDataFrame([("o/r#42", "hi"), ("bad", "x")], "target STRING, markdown STRING")).collect()
    assert (pay[0]["repository"], pay[0]["number"], pay[0]["payload"], pay[1]["target_ok"]) == ("o/r", "42", '{"body":"hi"}', False)
    cards = report.project_cards(spark.createDataFrame([("a", "# Alpha\n## Current State\nok\n"), ("b", "x")], "project_id STRING, overview STRING"),
                                 spark.createDataFrame([("b", "Beta")], "id STRING, name STRING")).orderBy("project_id").collect()
    assert [(r["name"], r["excerpt"]) for r in cards] == [("Alpha", "ok"), ("Beta", "x")]


def test_prompt_tables(spark):
    ev = events(spark, ROWS)
    chunks = prompts.activity_chunks(ev, 4)
    assert sorted((r["chunk_no"], r["n_events"]) for r in chunks.collect()) == [(0, 4), (1, 4), (2, 2)]
    known = registry.from_dicts(spark, [{"id": "app", "description": "An app", "signals": {"keywords": ["k"]}}, {"id": "b", "signals": {"entry_extract": ["x", " "]}}])
    made = prompts.entry_prompts(chunks, known).collect()
    assert {r["project_id"]: r["hints"] for r in prompts.entry_hints(known).collect()} == {"app": "- An app\n- keywords: k", "b": "- x"}
    assert len(made) == 3 and all("keywords: k" in r["user"] for r in made)
    days = spark.createDataFrame([("app", "20260621"), ("app", "20260622"), ("app", "20260623")], "project_id STRING, date_key STRING")
    said = spark.createDataFrame([("app", "pre\n## 2026-06-21\nbody one\n\n### 2026-06-22  \n\n## 2026-06-22\nlast\n", None), ("app", "  ", "20260623")],
                                 "project_id STRING, reply STRING, date_key STRING")
    done = {r["date_key"]: r["entry"] for r in prompts.apply_entries(days, said).collect()}
    assert done == {"20260621": "body one", "20260622": "last", "20260623": None}
    lines = prompts.entry_lines(prompts.apply_entries(days, said)).where("date_key = '20260621'").orderBy("pos").collect()
    assert "\n".join(r["text"] for r in lines) == "---\n## 2026-06-21\n\nbody one\n\n---\n"
    o = spark.createDataFrame([("# X\nnew\n---DAILY SUMMARY---\nshort ", "old"), ("only", "old"), (None, "old")], "r STRING, c STRING")
    got = [tuple(r[0]) for r in o.select(prompts.split_overview(F.col("r"), F.col("c"))).collect()]
    assert got == [("# X\nnew\n", "short"), ("only\n", ""), ("old", "")]


def test_replies_of_a_long_day_follow_in_block_order(spark):
    days = spark.createDataFrame([("app", "20260621"), ("app", "20260622")], "project_id STRING, date_key STRING")
    said = spark.createDataFrame([("app", f"zyx"[k % 3] + str(k), "20260621", k) for k in (10, 2, 0, 1)] + [("app", "## 2026-06-21\ntail", None, None)],
                                 "project_id STRING, reply STRING, date_key STRING, chunk_no LONG")
    done = {r["date_key"]: r["entry"] for r in prompts.apply_entries(days, said).collect()}
    assert done == {"20260621": "z0\n\ny1\n\nx2\n\ny10\n\ntail", "20260622": None}


def test_payload_changes_flip_the_fingerprint(spark):
    ev = events(spark, ROWS)
    key = ev.withColumn("g", F.lit(1))
    one = rollup.fingerprint(key, ["g"], rollup.event_text()).first()["fingerprint"]
    other = key.withColumn("payload", F.col("payload").withField("tool", F.lit("x")))
    assert rollup.fingerprint(other, ["g"], rollup.event_text()).first()["fingerprint"] != one
    empty = key.withColumn("payload", F.col("payload").withField("tool", F.lit("")))
    assert rollup.fingerprint(empty, ["g"], rollup.event_text()).first()["fingerprint"] != one
