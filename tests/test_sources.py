import json

from pyspark.sql import functions as F

from daybrook.model import to_log_json
from daybrook.operators import calls, gate, retrieval
from daybrook.session import work_dir
from daybrook.sinks import store
from daybrook.sources import hooks, hosted, journal, log, notes, registry, reports

NOW = "2026-06-21T12:00:00+03:00"


def test_log_round_trip_and_quarantine(spark, tmp_path):
    good = {"event_id": "a", "schema_version": 2, "source": {"kind": "os", "adapter": "x"}, "ts_wall": "2026-06-21T10:00:00Z", "type": "NARRATION", "clock_offset_sec": "abc",
            "payload": {"note": "hi", "duration_sec": 12.5, "custom": {"k": 1}, "_hidden": "x"}, "trust": "validated"}
    (tmp_path / "20260621.jsonl").write_text(json.dumps(good) + "\n\n{broken\n", encoding="utf-8")
    (tmp_path / "20260622.jsonl").write_text(json.dumps({"type": "IDLE_START"}) + "\n", encoding="utf-8")
    ok, bad = log.split_corrupt(log.read_log(spark, str(tmp_path), date_key="20260621"))
    row = ok.first()
    assert ok.count() == 1 and [r["_corrupt"] for r in bad.collect()] == ["{broken"]
    assert row["payload"]["note"] == "hi" and row["payload"]["duration_sec"] == "12.5" and row["extras"] == {"custom": '{"k":1}'}
    assert log.read_log(spark, str(tmp_path)).count() == 3
    text = json.loads(to_log_json(ok.withColumn("extras", F.create_map(F.lit("_t"), F.lit("x"), F.lit("u"), F.lit("y")))).first()[0])
    assert text["extras"] == {"u": "y"} and text["payload"]["note"] == "hi"
    filled = log.with_defaults(log.split_corrupt(log.read_log(spark, str(tmp_path), date_key="20260622"))[0]).first()
    assert filled["trust"] == "validated" and filled["ts_wall"] == "" and len(filled["event_id"]) == 64


def classify(spark, texts, **kw):
    files = spark.createDataFrame([(t, f"f{i}.json") for i, t in enumerate(texts)], "value STRING, file_name STRING")
    return [r.asDict(recursive=True) for r in reports.classify(reports.report_texts(files), now=NOW, **kw).orderBy("file_name", "trust").collect()]


def report(**kw):
    base = {"type": "AGENT_REPORT", "source": {"kind": "agent", "adapter": "a", "identity": "agent:one", "session_id": "s1"}, "ts_wall": "2026-06-21T11:30:00+03:00",
            "payload": {"summary": "ran tests"}}
    return {**base, **kw}


def test_trust_intake(spark):
    evil = report(source={"kind": "agent", "adapter": "a", "identity": "agent:evil"}, ts_wall="2027-01-01T00:00:00+03:00", trust="validated", privacy={"gate_version": "1"})
    got = classify(spark, [json.dumps(report()), json.dumps([evil, report(ts_wall="2026-06-21T11:59:00")]), '{"source": {"kind": "banana"}, "payload": "no object"}',
                           "{oops", json.dumps(report(schema_version=1)), json.dumps(report(source={"kind": "os", "adapter": "a", "identity": "agent:one"})), "5"], trusted=["agent:one"])
    assert [(r["file_name"], r["trust"]) for r in got] == [("f0.json", "validated"), ("f1.json", "low_trust"), ("f1.json", "validated"), ("f2.json", "rejected"),
                                                           ("f3.json", "rejected"), ("f4.json", "rejected"), ("f5.json", "low_trust"), ("f6.json", "rejected")]
    assert got[1]["payload"]["trust_reasons"] == ["unknown_identity", "future_timestamp"] and got[1]["privacy"] is None and got[1]["recv_ts"] == NOW
    assert got[0]["source"]["session_id"] == "s1" and got[0]["payload"]["summary"] == "ran tests"
    assert got[3]["payload"]["reasons"][:2] == ["type must be one of ['AGENT_REPORT', 'CLIPBOARD', 'DEEP_WORK', 'FILE_CHANGE', 'FOCUS_SESSION', 'GIT_COMMIT', 'IDLE_END', "
                                                "'IDLE_START', 'LONG_RUN', 'NARRATION']", "source.kind must be one of ['agent', 'fs', 'git', 'intent', 'os', 'remote']"]
    assert got[4]["payload"]["reasons"] == ["unreadable_report_file"] and got[4]["source"]["identity"] == "f3.json" and got[4]["ts_wall"] == NOW
    assert got[5]["payload"]["reasons"] == ["schema_version must be 2"] and got[6]["payload"]["trust_reasons"] == ["source_kind_not_agent"]
    assert got[7]["payload"]["reasons"] == ["event must be an object"]


def test_a_report_is_trimmed_and_its_clock_read_once(spark):
    files = spark.createDataFrame([(" [1, {}]\n", "f")], "value STRING, file_name STRING")
    texts = reports.report_texts(files)
    assert [r["report"] for r in texts.collect()] == ["1", "{}"]
    assert texts._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    plan = reports.classify(texts, now=NOW)._jdf.queryExecution().optimizedPlan().toString()
    # the message about the clock and the verdict read it once each
    assert plan.count("future_timestamp") == 1 and plan.count("unparseable_ts_wall") == 1 and plan.count("^(\\d{4})(\\d{2})(\\d{2})") == 2


def test_hosted_payloads_and_incremental_pull(spark):
    c = {"sha": "0123456789abcdef", "commit": {"message": "Fix it\nmore", "author": {"name": "Ana", "date": "2026-06-20T10:00:00Z"}}, "author": {"login": "ana"},
         "files": [{"filename": "a.py"}, {"other": 1}]}
    p = {"number": 7, "title": "T", "state": "closed", "merged_at": None, "updated_at": "u1", "user": {"login": "copilot-agent", "type": "User"}}
    r = {"name": "build", "conclusion": None, "status": "queued", "created_at": "2026-06-20T10:00:00Z"}

    def frame(schema, *objs):
        df = spark.createDataFrame([(json.dumps(o),) for o in objs], "j STRING")
        return df.select(F.lit("github.com/o/r").alias("remote"), F.from_json("j", f"STRUCT<{schema}>").alias("x")).select("remote", "x.*")
    e = hosted.commit_events(frame(hosted.COMMIT, c), now=NOW).first()
    assert (e["source"]["kind"], e["source"]["identity"], e["payload"]["summary"], e["payload"]["files"], e["payload"]["message"]) == (
        "remote", "github:ana", "commit 0123456: Fix it", ["a.py"], "Fix it")
    e = hosted.pull_events(frame(hosted.PULL, p), now=NOW).first()
    assert (e["source"]["identity"], e["payload"]["summary"], e["ts_wall"], e["payload"]["actor"]) == ("agent:copilot-agent", "closed PR #7: T", "u1", "agent")
    assert hosted.run_events(frame(hosted.RUN, r), now=NOW).first()["payload"]["summary"] == "CI build: queued"
    seen = spark.createDataFrame([("github.com/o/r", "7", "u1"), ("github.com/o/r", "8", "u1")], "remote STRING, number STRING, updated_at STRING")
    pulls = frame(hosted.PULL, p, {**p, "number": 8, "updated_at": "u2"}, {**p, "number": 9}, {**p, "number": None})
    fresh = hosted.new_pulls(pulls, seen)
    assert sorted(r["number"] for r in fresh.collect()) == ["8", "9"]
    after = hosted.seen_after(seen, fresh, ["remote", "number"], "updated_at")
    assert hosted.new_pulls(pulls, after).count() == 0 and after.count() == 3
    commits = frame(hosted.COMMIT, c, c, {**c, "sha": "ff"})
    assert hosted.new_commits(commits, spark.createDataFrame([("github.com/o/r", "ff")], "remote STRING, sha STRING")).count() == 1


def test_hooks_and_notes(spark):
    lines = [{"hook_event_name": "PostToolUse", "cwd": "/w/app", "session_id": "s", "tool_name": "Edit", "tool_input": {"file_path": "/w/app/x.py"}},
             {"hook_event_name": "PostToolUse", "tool_name": "Bash"}, {"hook_event_name": "Stop", "cwd": "/w/app"}, {}]
    df = spark.createDataFrame([(json.dumps(x), i) for i, x in enumerate(lines)], "value STRING, i INT")
    got = hooks.hook_reports(df, flavour="claude_code", ts_wall=F.lit(NOW)).orderBy("i").collect()
    assert [r["summary"] for r in got] == ["Claude Code Edit: x.py", "Claude Code used Bash", "Claude Code finished a session in app", "Claude Code event: unknown"]
    ev = reports.build_reports(hooks.hook_reports(df, flavour="claude_code", ts_wall=F.lit(NOW))).where("payload.files is not null").first()
    assert ev["payload"]["files"] == ["/w/app/x.py"] and ev["payload"]["project_hint"] == "app" and ev["source"]["adapter"] == "claude-code"
    cur = spark.createDataFrame([(json.dumps({"hook_event_name": "stop", "workspace_roots": ["/w/app"], "status": "completed"}),)], "value STRING")
    assert hooks.hook_reports(cur, flavour="cursor", ts_wall=F.lit(NOW)).first()["summary"] == "Cursor finished a session in app (completed)"
    n = notes.note_events(spark.createDataFrame([("debugging the gate since 2pm", NOW), ("idk", NOW)], "text STRING, ts_wall STRING")).collect()
    assert n[0]["payload"]["retroactive_since"] == "2026-06-20T14:00:00+03:00" and [r["payload"]["meaningful"] for r in n] == ["true", "false"]
    c = notes.commit_events(spark.createDataFrame([("/w", "zed", "m", NOW, ["a"])], "repo STRING, author STRING, message STRING, ts_wall STRING, files ARRAY<STRING>")).first()
    assert c["payload"]["actor"] == "human" and c["attribution"]["confidence"] == 0.5


def test_registry(spark, tmp_path):
    reg = [{"id": "app", "name": "App", "signals": {"paths": ["/r/app"], "git_remotes": ["github.com/o/app.git"], "keywords": ["k"]}}]
    (tmp_path / "projects.json").write_text(json.dumps({"projects": reg}, indent=2))
    df = registry.read_registry(spark, str(tmp_path / "projects.json"))
    assert registry.to_dicts(df)[0]["signals"]["paths"] == ["/r/app"]
    assert registry.read_registry(spark, str(tmp_path / "none.json"), template=reg).count() == 1
    assert {(r["kind"], r["value"]) for r in registry.signal_rows(df).collect()} == {("paths", "/r/app"), ("git_remotes", "github.com/o/app.git"), ("keywords", "k")}
    assert tuple(registry.tracked_remotes(df).first()) == ("github.com/o/app", "app", "o/app")
    assert sorted(r["root"] for r in registry.allowlist_roots(df, ["/extra", "/r/app/"]).collect()) == ["/extra", "/r/app"]
    repos = spark.createDataFrame([("/r/app", "", ["x"], []), ("/s/app", "My App", ["github.com/o/b"], ["go.mod"]), ("/t/smartActivityLog", "", [], [])],
                                  "path STRING, title STRING, remotes ARRAY<STRING>, markers ARRAY<STRING>")
    got = {r["signals"]["paths"][0]: r for r in registry.discover(repos, df, "2026-06-21").collect()}
    assert set(got) == {"/s/app", "/t/smartActivityLog"} and got["/s/app"]["id"] == "app-2" and got["/s/app"]["name"] == "My App"
    assert got["/s/app"]["signals"]["apps"] == ["go.exe", "Code.exe"] and got["/s/app"]["signals"]["domains"] == ["github.com/o/b"]
    s = got["/t/smartActivityLog"]["signals"]
    assert s["keywords"] == ["smart activity log", "smartactivitylog"] and s["window_patterns"] == [r".*smart\W*activity\W*log.*", ".*smartactivitylog.*"]
    cfg = '[core]\n[remote "up"]\n\turl = git@h.org:x/y.git\n[remote "origin"]\n\turl = https://github.com/o/app.git\n\tfetch = +x\n[branch "m"]\n\turl = nope\n'
    assert spark.createDataFrame([(cfg,)], "c STRING").select(registry.parse_remotes(F.col("c"))).first()[0] == ["github.com/o/app", "h.org/x/y"]
    said = spark.createDataFrame([("app", 'ok ```json\n{"description": " New ", "keywords": ["k", " z "], "paths": ["/etc"]}\n```')], "project_id STRING, reply STRING")
    e = registry.enrich(df, said).first()
    assert e["description"] == "New" and e["signals"]["keywords"] == ["k", "z"] and e["signals"]["paths"] == ["/r/app"]


def test_journal_and_retrieval(spark, tmp_path):
    (tmp_path / "project_checkout").mkdir()
    (tmp_path / "project_checkout" / "overview.md").write_text("intro\n# Coupons\nThe coupon stacking bug was fixed in validate.ts\n## Open\n")
    (tmp_path / "daily.md").write_text("## 2026-06-22\n\n**app** — did x\n\n**web** - did y\n\n---\n## 2026-06-21\n\n**app** — older\n**app** — newest\n---\n**stray** — no\n")
    corpus = journal.read_corpus(spark, str(tmp_path))
    p = retrieval.passages(corpus)
    assert {r["source"] for r in p.collect()} >= {"checkout/overview", "checkout/overview › Coupons", "checkout/overview › Open"}
    assert retrieval.of_project(p, "checkout").count() == 3
    keyed = p.withColumn("pid", F.concat("path", F.lit("#"), "passage_no"))
    q = spark.createDataFrame([(1, "what about the coupon bug?"), (2, "zzz")], "qid INT, question STRING")
    top = retrieval.within_budget(retrieval.top_passages(retrieval.score(keyed, q), keyed))
    assert [(r["source"], r["score"]) for r in top.collect()] == [("checkout/overview › Coupons", 22.0)]
    a = {r["qid"]: r["answer"] for r in retrieval.answers(top, q).collect()}
    assert a[2] == retrieval.NO_MATCH and "### checkout/overview › Coupons" in a[1]
    d = journal.daily_rows(corpus.where("path = 'daily.md'").select("text")).orderBy("section_no", "line_no").collect()
    assert [(r["section_no"], r["date"], r["project"], r["paragraph"]) for r in d] == [
        (1, "2026-06-22", "app", "did x"), (1, "2026-06-22", "web", "did y"), (2, "2026-06-21", "app", "newest")]
    framed = "---\n## 2026-06-21\n\nx\n\n---\n---\n## 2026-06-22\n\ny\n---\n"
    s = spark.createDataFrame([(framed,)], "t STRING").select(F.explode(journal.dated_sections(F.col("t"))).alias("s")).collect()
    assert [r["s"]["label"] for r in s] == ["2026-06-21", "2026-06-22"] and "".join(r["s"]["chunk"] for r in s) == framed


def test_stores(spark):
    from tests.test_gate import events
    root = work_dir(spark, "store")
    rows = [("NARRATION", {"note": "a"}), ("FILE_CHANGE", {"path": "/w/x", "diff": "diff --git a/x b/x\n+1"}), ("FILE_CHANGE", {"path": "/no/x"})]
    from daybrook.operators.diffs import CapturePolicy
    for _ in range(2):
        store.append_events(gate.gate(events(spark, rows), ["/w"], passed_at=NOW, policy=CapturePolicy(True)), root)
    assert store.read_events(spark, root).count() == 4 and spark.read.parquet(f"{root}/diffs").count() == 1
    assert store.read_events(spark, root, "20260621").count() == 4 and spark.read.parquet(f"{root}/drops").count() == 2
    assert "content" not in spark.read.parquet(f"{root}/drops").columns
    state = spark.createDataFrame([("p", "fp1")], "project_id STRING, fingerprint STRING")
    assert store.load_state(spark, f"{root}/state") is None
    store.save_state(state, f"{root}/state", 1)
    store.save_state(state.withColumn("fingerprint", F.lit("fp2")), f"{root}/state", 2)
    assert store.load_state(spark, f"{root}/state").first()["fingerprint"] == "fp2"
    rows = spark.createDataFrame([("t1", "2026-06-21T10:00:00Z"), ("zz", "2026-06-21T10:00:00Z"), ("", "x")], "token STRING, ts_wall STRING")
    tokens = spark.createDataFrame([("t1", "../Team")], "t STRING, account STRING").select(F.sha2("t", 256).alias("token_sha256"), "account")
    known, unknown = store.route_accounts(rows, tokens)
    store.append_accounts(known, f"{root}/acc")
    got = store.read_since(spark.read.parquet(f"{root}/acc"), "Team", "2026-06-21")
    assert got.count() == 1 and unknown.count() == 2
    daily = f"{root}/daily"
    one = spark.createDataFrame([("2026-06-21", "p", "x")], "run_date STRING, project_id STRING, paragraph STRING")
    store.append_daily(one, daily, 1)
    store.append_daily(one.withColumn("paragraph", F.lit("y")), daily, 2)
    assert spark.read.parquet(daily).count() == 2 and store.latest_daily(spark.read.parquet(daily)).first()["paragraph"] == "y"


def test_call_log(spark):
    rows = [(i, "r", "acc", f"2026-06-21 10:00:{s:02d}", "m1", i % 2 == 0, "HTTP 429" if i == 2 else "") for i, s in enumerate([0, 10, 20, 30, 59])] + [
        (9, "r", "acc", "2026-06-21 10:01:00", "m1", True, "")]
    df = spark.createDataFrame(rows, "call_id INT, run STRING, account STRING, t STRING, model STRING, ok BOOLEAN, error STRING").withColumn("ts", F.col("t").cast("timestamp"))
    got = {r["call_id"]: (r["in_window"], r["wait_sec"]) for r in calls.over_rate(df, 3).collect()}
    assert got[0] == (1, 0.0) and got[3] == (4, 30.0) and got[9] == (5, 20.0)
    assert sorted(r["call_id"] for r in calls.after_breaker(df).collect()) == [3, 4, 9]
    assert calls.overall_exit(df).first()["exit_code"] == 0


def test_folder_readers(spark, tmp_path):
    (tmp_path / "r" / "app" / ".git").mkdir(parents=True)
    (tmp_path / "r" / "app" / ".git" / "config").write_text('[core]\n\tx = 1\n[remote "origin"]\n\turl = git@h.org:o/app.git\n')
    got = registry.read_git_configs(spark, str(tmp_path / "r")).collect()
    assert [(r["path"].rsplit("/", 1)[-1], r["remotes"]) for r in got] == [("app", ["h.org/o/app"])]
    (tmp_path / "drop").mkdir()
    (tmp_path / "drop" / "a.json").write_text(json.dumps([report(), report()], indent=2))
    assert reports.read_drop_folder(spark, str(tmp_path / "drop")).count() == 2
