import os

import pytest
from pyspark.sql import functions as F

from daybrook.operators import refresh, rollup
from daybrook.plans import prompts
from daybrook.session import work_dir
from daybrook.sources import registry
from tests.test_rollup import ROWS, events, note


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root.removeprefix("file:")) for f in names}


def written(df):
    return sorted(map(tuple, df.select("project_id", "level", "key", "action").collect()))


BASE = [*ROWS, note("2026-06-22T09:00:00Z", "app", "tuesday"), note("2026-07-01T09:00:00Z", "app", "july"), note("2026-06-22T09:00:00Z", "0042", "numbers only"),
        note("junk", "0042", "no clock"), note("", "0042", "empty clock")]


def test_only_the_touched_path_is_written(spark):
    root = work_dir(spark, "journal")
    first = events(spark, BASE)
    assert {r[1] for r in written(refresh.refresh(first, root))} == {"day", "week", "month", "project"}
    before = files(root)
    assert written(refresh.refresh(first, root)) == [] and files(root) == before
    edited = events(spark, [*BASE[:-5], note("2026-06-22T09:00:00Z", "app", "changed"), *BASE[-4:]])
    changed = refresh.refresh(edited, root)
    assert written(changed) == [("app", "day", "20260622", "written"), ("app", "month", "2026-06", "written"), ("app", "project", "", "written"), ("app", "week", "2026-W26", "written")]
    fresh = files(root) - before
    assert before <= files(root) and {part for f in fresh for part in f.split("/") if part.startswith("date_key=")} == {"date_key=20260622"}
    known = registry.from_dicts(spark, [{"id": "app", "name": "App", "signals": {"keywords": ["k"]}}])
    asked = prompts.due_entry_prompts(edited, changed, known).collect()
    assert len(asked) == 1 and "changed" in asked[0]["user"]
    want = sorted((r["project_id"], r["date_key"], r["text"]) for r in rollup.archive_lines(edited).collect())
    assert sorted((r["project_id"], r["date_key"], r["text"]) for r in refresh.read_lines(spark, root).collect()) == want
    weeks = refresh.read_periods(spark, root, "week")
    assert sorted((r["project_id"], r["date_key"], r["text"]) for r in weeks.collect()) == want
    assert {r["text"] for r in refresh.read_reports(spark, root).where("project_id = 'app'").collect()} == {"- month 2026-06: 2 days, 11 events", "- month 2026-07: 1 days, 1 events"}


def test_days_that_are_gone(spark):
    root = work_dir(spark, "journal")
    refresh.refresh(events(spark, BASE), root)
    changed = written(refresh.refresh(events(spark, [r for r in BASE if r[1] != "2026-07-01T09:00:00Z"]), root))
    assert ("app", "day", "20260701", "removed") in changed and ("app", "month", "2026-07", "removed") in changed and ("app", "project", "", "written") in changed
    assert refresh.read_lines(spark, root).where("date_key = '20260701'").count() == 0
    assert refresh.read_periods(spark, root, "month").where("period_key = '2026-07'").count() == 0
    assert written(refresh.refresh(events(spark, []), root))[0][3] == "removed" and refresh.read_lines(spark, root).count() == 0


def test_a_run_that_dies_changes_nothing(spark, monkeypatch):
    root = work_dir(spark, "journal")
    refresh.refresh(events(spark, BASE), root)
    seen = sorted(map(str, refresh.read_lines(spark, root).collect()))
    edited = events(spark, [*BASE, note("2026-06-22T10:00:00Z", "app", "more")])
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(refresh.store, "save_state", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        refresh.refresh(edited, root)
    assert sorted(map(str, refresh.read_lines(spark, root).collect())) == seen
    assert len(written(refresh.refresh(edited, root))) == 4
    assert refresh.read_lines(spark, root).where("text LIKE '%more%'").count() == 1


def test_period_bodies(spark):
    root = work_dir(spark, "journal")
    refresh.refresh(events(spark, BASE), root)
    body = refresh.period_body(refresh.read_periods(spark, root, "month").where("period_key = '2026-06'"))
    rows = body.orderBy("period_key", "project_id", "part", "date_key", *rollup.PLACE).collect()
    heads = [r["text"] for r in rows if r["part"] == 0]
    assert heads == ["## 0042", "## app"] and rows[0]["text"] == "## 0042" and rows[-1]["text"] == ""
    assert spark.range(1).select(refresh.period_title("week", F.lit("2026-W26"))).first()[0] == "# Weekly summary — 2026-W26"


def test_nothing_to_write(spark):
    root = work_dir(spark, "journal")
    assert written(refresh.refresh(events(spark, []), root)) == [] and files(root) == set()
