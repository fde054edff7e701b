import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from daybrook.operators import focus, ordered, sessions

BASE = datetime(2026, 6, 21, 9, tzinfo=timezone.utc)


def at(sec):
    return BASE + timedelta(seconds=sec)


def greedy(times, spacing):
    last, out = None, []
    for t, i in sorted(times):
        if last is None or t - last >= spacing:
            out.append(i)
            last = t
    return out


@pytest.mark.parametrize("bucket", [2.0, 7.0, 3600.0])
def test_coalescing_equals_the_sequential_rule(spark, bucket):
    rnd = random.Random(3)
    rows, t = [], 0.0
    for i in range(600):
        t += rnd.choice([0.0, 0.1, 0.4, 0.9, 1.7, 2.0, 5.0] if i % 200 > 20 else [0.3, 0.7])
        rows.append((i, "hot" if rnd.random() < .7 else f"p{rnd.randint(0, 3)}", round(t, 1)))
    df = spark.createDataFrame([(i, p, at(s)) for i, p, s in rows], "arrival_seq INT, path STRING, ts TIMESTAMP")
    got = sorted(r["arrival_seq"] for r in sessions.coalesce_changes(df, ["path"], arrival="arrival_seq", spacing_sec=2.0, bucket_sec=bucket).collect())
    want = sorted(i for p in {r[1] for r in rows} for i in greedy([(round(s * 1e6), i) for i, q, s in rows if q == p], 2_000_000))
    assert got == want


def test_ordered_operators_equal_brute_force(spark):
    rnd = random.Random(5)
    rows = [("a" if rnd.random() < .6 else None if rnd.random() < .1 else "b", rnd.randint(0, 5000), i, rnd.choice([None, "x", "y"])) for i in range(400)]
    df = spark.createDataFrame([(k, at(s), i, v) for k, s, i, v in rows], "k STRING, ts TIMESTAMP, i INT, v STRING")
    order = [F.col("ts"), F.col("i")]
    out = ordered.numbered(df, ["k"], ordered.time_bucket(F.col("ts"), 100), order, "n")
    out = ordered.previous(out, ["k"], ordered.time_bucket(F.col("ts"), 60), order, F.col("v"), "p")
    out = ordered.trailing_count(out, ["k"], F.col("ts"), F.col("i"), 30, "c", bucket_sec=45)
    got = {r["i"]: (r["n"], r["p"], r["c"]) for r in out.collect()}
    for key in ("a", "b", None):
        mine = sorted((s, i, v) for k, s, i, v in rows if k == key)
        for n, (s, i, v) in enumerate(mine):
            count = sum(1 for s2, i2, _ in mine if s - 30 <= s2 <= s and (s2 < s or i2 <= i))
            assert got[i] == (n + 1, mine[n - 1][2] if n else None, count)


def test_burst_and_actor_flow(spark):
    files = [("a.py", 0, True), ("b.py", 30, True)] + [(f"g{i}.py", 60 + i // 2, False) for i in range(7)] + [("~$x.docx", 70, False), ("a.py", 31, True), ("a.py", 32, True)]
    df = spark.createDataFrame([("h", at(s), i, "src/" + p, "modified", "", h) for i, (p, s, h) in enumerate(files)],
                               "host STRING, ts TIMESTAMP, arrival_seq INT, path STRING, action STRING, author STRING, human_active BOOLEAN")
    got = {r["arrival_seq"]: (r["burst"], r["actor"]["actor"], r["actor"]["method"]) for r in sessions.file_changes(df).collect()}
    assert 9 not in got and 11 not in got and got[0] == (1, "human", "input")
    assert got[2][2] == "no_human" and got[8] == (7, "agent", "burst")


def test_long_runs(spark):
    def tick(minute, human, *procs):
        return ("h", at(minute * 60), human, [(p, n, c, u) for p, n, c, u in procs])
    rows = [tick(m, False, (1, "sim.exe", f"run {m}", 60.0 + m % 3), (2, "short.exe", "", 90.0 if m < 10 else 1.0)) for m in range(0, 60, 5)]
    rows += [tick(60, True, (1, "sim.exe", "x", 99.0)), tick(65, False, (1, "sim.exe", "y", 70.0))]
    df = spark.createDataFrame(rows, "host STRING, ts TIMESTAMP, human_present BOOLEAN, procs ARRAY<STRUCT<pid: INT, name: STRING, cmdline: STRING, cpu_percent: DOUBLE>>")
    for bucket in (600.0, 86_400.0):
        got = sessions.long_runs(df, bucket_sec=bucket).collect()
        assert [(r["pid"], r["duration_sec"], r["cpu_peak"], r["process"], r["cmdline"]) for r in got] == [(1, 3300.0, 62.0, "sim.exe", "run 55")]


def test_clips_and_idle_and_pauses(spark):
    df = spark.createDataFrame([("h", at(i), i, t) for i, t in enumerate(["a", " a ", "", "a", "b", "b", "a", None])], "host STRING, ts TIMESTAMP, n INT, text STRING")
    got = sessions.changed_clips(df, ["host"], [F.col("ts")], ordered.time_bucket(F.col("ts"), 2)).orderBy("n").collect()
    assert [(r["n"], r["text"]) for r in got] == [(0, "a"), (4, "b"), (6, "a")]
    ev = spark.createDataFrame([("h", at(i * 1000)) for i in range(10)], "host STRING, effective_ts TIMESTAMP")
    pauses = spark.createDataFrame([("h", at(1500), at(4000)), ("h", at(8000), at(8000)), ("g", at(0), at(9000))], "host STRING, start TIMESTAMP, end TIMESTAMP")
    assert sessions.suppress_paused(ev, pauses).count() == 6


def samples(spark, ticks):
    """ticks: (second, title, idle, keys, mouse, saves, {signals})"""
    rows = [("h", at(s), at(s).isoformat(), n, t, "app.exe", float(i), k, m, v, *[x.get(c, "") for c in focus.SIGNALS]) for n, (s, t, i, k, m, v, x) in enumerate(ticks)]
    ddl = ("host STRING, ts TIMESTAMP, ts_wall STRING, tick_seq INT, title STRING, process STRING, idle_seconds DOUBLE, keys INT, mouse INT, saves INT, "
           + ", ".join(c + " STRING" for c in focus.SIGNALS))
    return spark.createDataFrame(rows, ddl)


def run(spark, ticks, **rules):
    out = focus.to_events(focus.sessionize(samples(spark, ticks), focus.FocusRules(**rules)))
    return [r.asDict(recursive=True) for r in out.orderBy("ts_wall", "type").collect()]


def test_quick_switch_is_a_satellite_and_a_settled_window_is_a_session(spark):
    ticks = [(s, "a.py - Code", 0, 30, 0, 0, {}) for s in range(0, 100, 10)] + [(100, "Mail", 0, 0, 0, 0, {}), (110, "a.py - Code", 0, 30, 0, 0, {})]
    ticks += [(s, "b.py - Code", 0, 30, 0, 0, {}) for s in range(120, 260, 10)]
    got = run(spark, ticks)
    assert [(r["type"], r["payload"]["anchor"], r["payload"]["mode"], r["payload"]["duration_sec"]) for r in got] == [
        ("FOCUS_SESSION", "a.py - Code", "PRODUCING", "180.0"), ("FOCUS_SESSION", "b.py - Code", "PRODUCING", "70.0")]
    assert [s["title"] for s in got[0]["payload"]["satellites"]] == ["Mail", "b.py - Code"]
    assert got[0]["payload"]["intent"]["label"] == "a.py" and got[0]["attribution"]["method"] == "title"


def test_reading_idle_and_return(spark):
    ticks = [(s, "Paper - Reader", 0, 0, 0, 0, {}) for s in range(0, 301, 100)] + [(1000, "Paper - Reader", 700, 0, 0, 0, {}), (1100, "Paper - Reader", 800, 0, 0, 0, {}),
             (1200, "Paper - Reader", 0, 1, 0, 0, {}), (1260, "Paper - Reader", 0, 0, 0, 0, {})]
    got = run(spark, ticks)
    assert [(r["type"], r["ts_wall"], r["payload"]["mode"]) for r in got] == [
        ("FOCUS_SESSION", at(0).isoformat(), "READING"), ("IDLE_START", at(300).isoformat(), None),
        ("FOCUS_SESSION", at(1200).isoformat(), "READING"), ("IDLE_END", at(1200).isoformat(), None)]
    assert got[0]["payload"]["duration_sec"] == "300.0" and got[1]["payload"]["idle_after_sec"] == "700" and got[3]["payload"]["away_sec"] == "900"


def test_deep_work_cut_and_signals(spark):
    ticks = [(s, "tool", 0, 0, 5, 1 if s == 500 else 0, {"cwd": "D:\\work\\bracket"}) for s in range(0, 1001, 100)]
    got = run(spark, ticks)
    assert [(r["type"], r["payload"]["duration_sec"], r["payload"]["saves"]) for r in got] == [("DEEP_WORK", "900.0", "1"), ("FOCUS_SESSION", "100.0", "0")]
    assert got[0]["payload"]["intent"]["label"] == "bracket" and got[0]["payload"]["intent"]["method"] == "proc_cmdline_cwd"


def test_stints_cut_anywhere_give_the_same_sessions(spark):
    rnd = random.Random(11)
    ticks, s = [], 0
    for _ in range(400):
        s += rnd.choice([5, 20, 40, 100])
        ticks.append((s, rnd.choice(["a.py - C", "b.md - C", "Mail"]), rnd.choice([0, 0, 0, 0, 650]), rnd.randint(0, 9), rnd.randint(0, 9), rnd.randint(0, 1), {}))
    rows = samples(spark, ticks)
    whole = focus.stints(rows, bucket_sec=1e9)
    cut = focus.stints(rows, bucket_sec=120)
    key = ["tick_seq", "stint", "lead"]
    assert sorted(map(tuple, whole.select(*key).collect())) == sorted(map(tuple, cut.select(*key).collect()))
