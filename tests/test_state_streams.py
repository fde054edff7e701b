import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from daybrook.operators import focus, sessions
from daybrook.plans import queries_streams
from daybrook.session import work_dir
from daybrook.streaming import focus_stream, jobs, runs_stream

BASE = datetime(2026, 6, 21, 9, tzinfo=timezone.utc)
SAMPLE = ("host STRING, ts TIMESTAMP, ts_wall STRING, tick_seq LONG, title STRING, process STRING, idle_seconds DOUBLE, keys LONG, mouse LONG, saves LONG, "
          "uia_value STRING, cmdline STRING, cwd STRING, saved_artifact STRING, narration STRING, part INT")


def feed(spark, df, parts, name):
    """One file an arrival, then a beat of another host that moves the clock on."""
    src = work_dir(spark, name)
    for part in range(parts):
        df.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(src)
    beat = [F.lit("beat").alias("host") if f.name == "host" else F.lit(BASE + timedelta(days=90)).alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name)
            for f in df.drop("part").schema]
    spark.range(1).select(*beat).write.mode("append").parquet(src)
    return spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(src)


def samples(seed, parts, hosts=2, n=250):
    pick, rows = random.Random(seed), []
    for h in range(hosts):
        t, window = 0, "a"
        for i in range(n):
            t += pick.choice([1, 2, 2, 5, 30])
            if pick.random() < 0.3:
                window = pick.choice(["a", "b", "c", None])
            quiet = pick.choice([0.0, 0.0, 0.0, 3.5, 20.0, 31.25]) if pick.random() < 0.3 else 0.0
            wall = (BASE + timedelta(seconds=t)).isoformat()
            signals = [pick.choice([None, "", f"s{i}"]) if pick.random() < 0.2 else None for _ in range(5)]
            rows.append((f"h{h}" if h else None, BASE + timedelta(seconds=t), wall, i, window, pick.choice([None, "p", "q"]), quiet, pick.choice([0, 3, -1, None]), pick.choice([0, 40]),
                         pick.choice([0, 0, 0, 1]), *signals, i * parts // n))
    return rows


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 3), (3, 7)])
def test_focus_feed_gives_the_batch_rows(spark, seed, parts):
    df = spark.createDataFrame(samples(seed, parts), SAMPLE)
    rules = focus.FocusRules(anchor_timeout=6.0, idle_threshold=15.0, periodic=120.0, deep_min=20.0)
    got = jobs.collect_table(focus_stream.focus_stream(feed(spark, df, parts, "samples"), rules, delay="1 second", silence_sec=86_400 * 30), "focus")
    want = focus.sessionize(df, rules)
    names = sorted(set(want.columns) & set(got.columns))
    assert set(want.columns) == set(got.columns)

    def rows(table):
        return sorted((tuple(map(str, r)) for r in table.select(*names).collect()))
    assert rows(got) == rows(want) and len(rows(got)) > 10


def test_rows_out_of_order_inside_the_delay(spark):
    rules = focus.FocusRules(anchor_timeout=6.0, idle_threshold=15.0, periodic=120.0)
    rows = samples(5, 1)
    random.Random(1).shuffle(rows)
    rows = [(*row[:-1], k * 3 // len(rows)) for k, row in enumerate(rows)]
    df = spark.createDataFrame(rows, SAMPLE)
    got = jobs.collect_table(focus_stream.focus_stream(feed(spark, df, 3, "shuffled"), rules, delay="2 days", silence_sec=86_400 * 30), "focus")
    assert sorted(r["ts_wall"] + r["type"] for r in got.collect()) == sorted(r["ts_wall"] + r["type"] for r in focus.sessionize(df, rules).collect())


@pytest.mark.parametrize("parts", [1, 4])
def test_silence_closes_a_host_at_its_last_sample(spark, parts):
    rows = []
    for i, second in enumerate([0, 5, 10, 15, 4000, 4005, 4010]):
        wall = (BASE + timedelta(seconds=second)).isoformat()
        rows.append(("h", BASE + timedelta(seconds=second), wall, i, "a", "p", 0.0, 1, 0, 0, None, None, None, None, None, i * parts // 7))
    df = spark.createDataFrame(rows, SAMPLE)
    got = jobs.collect_table(focus_stream.focus_stream(feed(spark, df, parts, "silent"), delay="1 second", silence_sec=600.0), "focus")
    assert sorted((r["keys"], r["duration_sec"]) for r in got.collect()) == [(3, 10.0), (4, 15.0)]


TICK = "host STRING, ts TIMESTAMP, human_present BOOLEAN, procs ARRAY<STRUCT<pid: LONG, name: STRING, cmdline: STRING, cpu_percent: DOUBLE>>, part INT"


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 4), (3, 9)])
def test_scan_feed_gives_the_batch_runs_and_ignores_replays(spark, seed, parts):
    pick, rows, n = random.Random(seed), [], 60
    for host in ("h", None):
        for i in range(n):
            procs = [(pid, f"n{pid}", f"run {i}", pick.choice([10.0, 60.0, 80.0, 90.0, None])) for pid in range(4) if pick.random() < 0.85]
            procs += [(1, "twin", "again", 70.0)] if pick.random() < 0.2 else []
            rows.append((host, BASE + timedelta(seconds=30 * i), pick.random() < 0.1 if pick.random() < 0.9 else None, procs if pick.random() < 0.95 else [], i * parts // n))
    df = spark.createDataFrame(rows, TICK)
    again = df.where(F.col("part") == parts // 2).withColumn("part", F.lit(parts))
    got = jobs.collect_table(runs_stream.long_run_stream(feed(spark, df.unionByName(again), parts + 1, "scans"), min_sec=60.0, delay="1 second", silence_sec=86_400 * 30), "runs")
    want = sessions.long_runs(df.withColumn("host", F.coalesce("host", F.lit(""))), min_sec=60.0)
    names = sorted(want.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, (tuple(r) for r in want.select(*names).collect())))
    assert got.count() > 3


class Held:
    """A state variable in memory that counts what is written."""

    def __init__(self):
        self.held, self.writes = {}, 0

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held[()]

    def update(self, value):
        self.updateValue((), value)

    def updateValue(self, key, value):
        self.held[key], self.writes = value, self.writes + 1

    def getValue(self, key):
        return self.held[key]

    def keys(self):
        return list(self.held)

    def clear(self):
        self.held.clear()


class Handle(dict):
    def getValueState(self, name, *_):
        return self.setdefault(name, Held())

    getMapState = getValueState

    def listTimers(self):
        return []

    def registerTimer(self, at):
        pass


def test_a_large_arrival_waits_in_few_blocks_and_writes_its_windows_once():
    n, handle = 25_000, Handle()
    frame = pd.DataFrame({"us": [k * 1_000_000 for k in range(n)], "seq": range(n), "wall": [str(k) for k in range(n)], "title": [f"t{k % 3}" for k in range(n)],
                          "process": "p", "quiet": 0.0, "keys": 1, "mouse": 0, "saves": 0, **{name: None for name in focus.SIGNALS}})
    fold = focus_stream.FocusFold(focus.FocusRules(anchor_timeout=1e6, periodic=1e9), 10**12)
    fold.init(handle)

    class Clock:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms
    assert list(fold.handleInputRows(("h",), iter([frame]), Clock(-1))) == []
    assert len(handle["waiting"].held) == 3
    list(fold.handleExpiredTimer(("h",), Clock(n * 1000), None))
    assert not handle["waiting"].held and handle["aside"].writes == 2 and handle["carry"].held[()][9] == n


def test_arrivals_of_bounded_size_by_the_clock(spark):
    rows = spark.range(1000).select(F.lit("h").alias("host"), F.timestamp_seconds("id").alias("ts"), "id")
    feed = queries_streams.arrivals(rows, "feed", replay=True, size=200)
    files = [row["rows"] for row in spark.read.parquet(feed_path(feed)).groupBy(F.input_file_name()).agg(F.collect_list("id").alias("rows")).collect()]
    spans = sorted((min(ids), max(ids), len(ids)) for ids in files if ids)
    assert max(n for _, _, n in spans) <= 201 and len(set(spans)) == 5 and len(spans) == 7
    assert all(a[1] < b[0] for a, b in zip(sorted(set(spans)), sorted(set(spans))[1:]))


def feed_path(feed):
    return feed._jdf.queryExecution().logical().toString().split("FileSource[")[1].split("]")[0]
