from pyspark.sql import functions as F

from daybrook.operators import rollup
from daybrook.plans import prompts, rounds
from daybrook.sources import registry
from tests.test_rollup import events, note


def activity(spark, many):
    return events(spark, [note(f"2026-06-{21 + k % 3}T09:{k % 60:02d}:00Z", "app", f"did {k}") for k in range(many)] + [note("2026-06-21T10:00:00Z", "web", "small step")])


def echo(asked, number):
    return asked.where("node_no <> 1").select("prompt_sha256", F.concat(F.lit(f"R{number}N"), F.col("node_no").cast("string")).alias("reply"))


def test_long_activity_is_condensed_in_rounds(spark):
    rows = activity(spark, 60)
    current = spark.createDataFrame([("app", "# App\nold text")], "project_id STRING, overview STRING")
    asked, done = rounds.overview_rounds(rows, current, echo, size=5, fan=3)
    got = asked.where("project_id = 'app'").orderBy("round", "node_no").collect()
    assert [(r["round"], r["label"], r["n_pieces"]) for r in got] == [(0, "chunk", 3)] * 4 + [(1, "chunk", 3), (1, "chunk", 1), (2, "overview", 2)]
    assert "did 0" in got[0]["user"] and "old text" in got[0]["user"] and got[0]["prompt_sha256"] == spark.range(1).select(F.sha2(F.lit(got[0]["system"] + "\n" + got[0]["user"]), 256)).first()[0]
    # a part without a reply goes on as its own text
    second = got[4]["user"]
    assert "R0N0" in second and "R0N2" in second and "did" in second and "R0N1" not in second
    assert "R1N0" in got[-1]["user"] and "R0N3" in got[-1]["user"]
    kept = {r["project_id"]: r["overview"] for r in done.collect()}
    assert kept == {"app": "R2N0\n", "web": "R0N0\n"}
    assert asked.where("project_id = 'web'").count() == 1


def test_without_any_reply_the_overview_stays(spark):
    current = spark.createDataFrame([("app", "# App")], "project_id STRING, overview STRING")
    none = spark.createDataFrame([], "prompt_sha256 STRING, reply STRING")
    asked, done = rounds.overview_rounds(activity(spark, 12), current, lambda asked, number: none, size=2, fan=3)
    assert {r["project_id"]: (r["overview"], r["daily"]) for r in done.collect()} == {"app": ("# App", ""), "web": ("", "")}
    last = asked.where("project_id = 'app' AND label = 'overview'").first()["user"]
    assert all(f"did {k}" in last for k in range(12))


def test_periods_and_days(spark):
    lines = rollup.in_period(rollup.archive_lines(activity(spark, 20)), "week")
    asked, bodies = rounds.period_rounds(lines, "week", echo, fan=30)
    assert sorted((r["period_key"], r["project_id"], r["label"]) for r in asked.collect()) == [("2026-W25", "app", "period"), ("2026-W25", "web", "period"), ("2026-W26", "app", "period")]
    assert {r["body"] for r in bodies.collect()} == {"R0N0\n"}
    told = spark.createDataFrame([("2026-06-21", f"p{k}", None if k == 2 else f"text {k}") for k in range(5)], "run_date STRING, project_id STRING, paragraph STRING")
    asked, day = rounds.summary_rounds(told, echo, fan=8)
    assert asked.count() == 1 and day.first()["body"] == "R0N0\n"
    none = spark.createDataFrame([], "prompt_sha256 STRING, reply STRING")
    _, day = rounds.summary_rounds(told, lambda asked, number: none, fan=2)
    assert day.first()["body"].startswith("## p0\ntext 0\n\n## p1") and "(no daily summary produced)" in day.first()["body"]


def test_units_and_journal(spark):
    rows = activity(spark, 9)
    known = registry.from_dicts(spark, [{"id": "app", "description": "About maps", "signals": {"keywords": ["atlas"]}}])
    got = {(r["project_id"], r["label"]): r["user"] for r in rounds.unit_prompts(rows, known, mode="adaptive", budget=10_000).collect()}
    user = got["app", "entry_batch"]
    assert user.index("## 2026-06-21") < user.index("## 2026-06-22") < user.index("## 2026-06-23") and "- keywords: atlas" in user and ("web", "entry") in got
    entries = spark.createDataFrame([("app", "20260621", "wrote this"), ("app", "20260622", " "), ("app", "20260623", None)], "project_id STRING, date_key STRING, entry STRING")
    lines = rounds.journal_lines(entries, rollup.document_lines(rows)).collect()
    assert {(r["date_key"], r["origin"]) for r in lines} == {("20260621", "entry"), ("20260622", "archive"), ("20260623", "archive")}
    assert any(r["text"] == "### Narration" for r in lines) and sum(r["text"] == "wrote this" for r in lines) == 1


def test_nothing_happened(spark):
    none = spark.createDataFrame([], "project_id STRING, overview STRING")
    asked, done = rounds.overview_rounds(events(spark, []), none, echo)
    assert asked.count() == 0 and done.count() == 0 and prompts.DAILY_SEPARATOR
