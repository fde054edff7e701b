import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from daybrook.operators import intervals, sessions

BASE = datetime(2026, 1, 1, tzinfo=timezone.utc)


def test_blocks_cover_exactly(spark):
    pick = random.Random(3)
    spans = [(a, a + pick.choice([0, 1, 30, 31, 32, 1000, 40_000])) for a in (pick.randint(-50_000, 50_000) for _ in range(60))] + [(5, 4), (7, None)]
    df = spark.createDataFrame(spans, "low LONG, high LONG").select("low", "high", intervals.blocks(F.col("low"), F.col("high")).alias("b"))
    for r in df.collect():
        got = sorted(i for b in r["b"] or [] for i in range(b["block"] << 5 * b["level"], (b["block"] + 1) << 5 * b["level"]))
        want = [] if r["high"] is None else [x + intervals.SHIFT for x in range(r["low"], r["high"] + 1)]
        assert got == want
    long = spark.createDataFrame([(0, 315_360_000_000_000)], "low LONG, high LONG").select(F.size(intervals.blocks(F.col("low"), F.col("high"))).alias("n")).first()["n"]
    assert long < 620


def test_spans_of_all_lengths(spark):
    pick = random.Random(4)
    events = [(k, pick.choice(["a", "b", None]), BASE + timedelta(microseconds=pick.randint(0, 10**pick.randint(1, 14))) if pick.random() < 0.95 else None) for k in range(400)]
    spans = []
    for k in range(60):
        start = BASE + timedelta(microseconds=pick.randint(0, 10**pick.randint(1, 13)))
        spans.append((pick.choice(["a", "b", None]), start, start + timedelta(microseconds=pick.randint(-5, 10**pick.randint(0, 14))), f"n{k % 7}"))
    spans += spans[:5] + [("a", events[0][2], None, "open")]
    ev = spark.createDataFrame(events, "event_id LONG, host STRING, effective_ts TIMESTAMP")
    table = spark.createDataFrame(spans, "host STRING, start TIMESTAMP, end TIMESTAMP, note STRING")
    held = {k for k, h, t in events for s in spans if h is not None and h == s[0] and t is not None and s[2] is not None and s[1] <= t <= s[2]}
    assert {r["event_id"] for r in sessions.suppress_paused(ev, table).collect()} == {k for k, *_ in events} - held
    counts = {r["host"]: (r["n_kept"], r["n_suppressed"]) for r in sessions.suppressed_counts(ev, table).collect()}
    assert counts == {h: (sum(x == h and k not in held for k, x, _ in events), sum(x == h and k in held for k, x, _ in events)) for h in {e[1] for e in events}}
    notes = table.select("host", F.col("start").alias("since"), F.col("end").alias("noted_at"), "note")
    want = {}
    for k, h, t in events:
        fit = [(s[2], s[3]) for s in spans if h is not None and h == s[0] and t is not None and s[2] is not None and s[1] <= t < s[2]]
        if fit:
            want[k] = max(fit)[1]
    assert {r["event_id"]: r["label"] for r in sessions.relabel_since(notes, ev).collect()} == want


def test_without_spans(spark):
    ev = spark.createDataFrame([(1, "a", BASE)], "event_id LONG, host STRING, effective_ts TIMESTAMP")
    none = spark.createDataFrame([], "host STRING, start TIMESTAMP, end TIMESTAMP, note STRING")
    assert sessions.suppress_paused(ev, none).count() == 1
    assert sessions.relabel_since(none.select("host", F.col("start").alias("since"), F.col("end").alias("noted_at"), "note"), ev).count() == 0


def test_notes_are_few_rows_and_label_to_the_microsecond(spark, monkeypatch):
    pick, written, keep = random.Random(5), [], intervals.materialize

    def counted(df, name):
        out = keep(df, name)
        written.append(out.count())
        return out
    monkeypatch.setattr(intervals, "materialize", counted)
    lengths = [timedelta(hours=3)] * 20 + [timedelta(days=3650), timedelta(days=4), timedelta(minutes=18), timedelta(seconds=1), timedelta(microseconds=1), timedelta(0)]
    starts = [BASE + timedelta(microseconds=pick.randint(0, 10**11)) for _ in lengths]
    starts[3] = BASE - timedelta(microseconds=(int(BASE.timestamp()) * 1_000_000 + intervals.SHIFT) % (1 << 30))
    notes = [("a" if k % 3 else "b", s, s + length, f"n{k}") for k, (s, length) in enumerate(zip(starts, lengths, strict=True))]
    notes.append(("a", notes[4][1], notes[4][2], "n99"))
    one = timedelta(microseconds=1)
    instants = [t + d for _, s, e, _ in notes for t in (s, e, s + (e - s) / 2) for d in (-one, timedelta(0), one)]
    events = [(2 * k + n, host, t) for k, t in enumerate(instants) for n, host in enumerate("ab")] + [(10**6, None, BASE), (10**6 + 1, "a", None)]
    # an id that comes again has the last of its notes
    events += [(0, "a", notes[7][1]), (0, "a", notes[8][1])]
    want = {}
    for k, h, t in events:
        fit = [(e, note) for host, s, e, note in notes if host == h and t is not None and s <= t < e]
        if fit:
            want[k] = max(*fit, want.get(k, fit[0]))
    want = {k: note for k, (_, note) in want.items()}
    table = spark.createDataFrame(notes, "host STRING, since TIMESTAMP, noted_at TIMESTAMP, note STRING")
    labels = sessions.relabel_since(table, spark.createDataFrame(events, "event_id LONG, host STRING, effective_ts TIMESTAMP"))
    rows = [(r["event_id"], r["label"]) for r in labels.collect()]
    assert len(rows) == len(want) and dict(rows) == want
    assert sum(written) < 32 * len(notes)
