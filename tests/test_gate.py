from pyspark.sql import functions as F

from daybrook.model import make_events, payload_of, source_of
from daybrook.operators import audit, diffs, gate

NOW = "2026-06-21T12:00:00+00:00"
FIELDS = ("path", "repo", "content", "diff", "body", "diffstat", "note", "summary", "message", "anchor")


def events(spark, rows):
    """Rows of (type, {payload field: text})."""
    data = [(str(i), t, *[p.get(f) for f in FIELDS]) for i, (t, p) in enumerate(rows)]
    df = spark.createDataFrame(data, "id STRING, t STRING, " + ", ".join(f"{f} STRING" for f in FIELDS))
    return make_events(df, type=F.col("t"), source=source_of("os", "test"), ts_wall=F.lit(NOW), event_id=F.col("id"),
                       payload=payload_of(**{f: F.col(f) for f in FIELDS}))


def run(spark, rows, roots=("/w",), policy=diffs.CapturePolicy()):
    out = gate.gate(events(spark, rows), list(roots), passed_at=NOW, policy=policy)
    return {int(r["event_id"]): r.asDict(recursive=True) for r in out.collect()}


def test_allowlist_and_clipboard(spark):
    got = run(spark, [("FILE_CHANGE", {"path": "/w/a.py"}), ("FILE_CHANGE", {"path": "/wx/a.py"}), ("FILE_CHANGE", {}), ("GIT_COMMIT", {"repo": "/w"}),
                      ("GIT_COMMIT", {"repo": "/w/../etc"}), ("CLIPBOARD", {"content": "password=abc"}), ("CLIPBOARD", {"content": "see https://h.example/p ok"}),
                      ("NARRATION", {"note": "in /home/al/x token=abc"})])
    assert [got[i]["drop_reason"] for i in range(8)] == [None, "not_in_allowlist", "missing_path", None, "not_in_allowlist", "clipboard_credential", None, None]
    assert got[6]["payload"]["content"] is None and got[6]["payload"]["host"] == "h.example" and got[6]["payload"]["kind"] == "url"
    assert got[6]["privacy"]["redactions"] == ["clipboard_typed"]
    assert got[7]["payload"]["note"] == "in ~/x token=[REDACTED:kv_secret]" and got[7]["privacy"]["redactions"] == ["kv_secret", "path"]
    assert got[1]["payload"] is None and got[1]["privacy"] is None and got[5]["payload"] is None


def test_roots_as_a_table_give_the_same(spark):
    rows = [("FILE_CHANGE", {"path": p}) for p in ("/w/a.py", "/w", "/wx/a", "/v/b/c", "/v", "C:\\dev\\x")]
    roots = ["/w/", "/v/b", "C:/dev"]
    inline = [r["drop_reason"] for _, r in sorted(run(spark, rows, roots).items())]
    table = spark.createDataFrame([(r,) for r in roots], "root STRING")
    joined = gate.gate(events(spark, rows), table, passed_at=NOW).orderBy("event_id").collect()
    assert [r["drop_reason"] for r in joined] == inline == [None, None, "not_in_allowlist", None, "not_in_allowlist", None]


DIFF = ("diff --git a/x.py b/x.py\n+a = 1\n+password=hunter2\n+-----BEGIN PRIVATE KEY-----\n+abc\n+-----END PRIVATE KEY-----\n+z\n"
        "diff --git a/.env b/.env\n+K=1\ndiff --git a/y.sql b/y.sql\n+q\n")


def test_diffs_are_stripped_by_default_and_kept_scrubbed_on_request(spark):
    rows = [("FILE_CHANGE", {"path": "/w/a.py", "diff": DIFF}), ("GIT_COMMIT", {"repo": "/w", "body": "why token=abc", "diffstat": "1 file"}),
            ("AGENT_REPORT", {"summary": "s", "diff": DIFF, "body": "b"})]
    off = run(spark, rows)
    assert all(r["payload"]["diff"] is None and r["payload"]["body"] is None and r["diff_clean"] is None for r in off.values())
    assert off[0]["privacy"]["redactions"] == ["content_stripped"] and off[1]["payload"]["diffstat"] == "1 file"
    on = run(spark, rows, policy=diffs.CapturePolicy(True, ignore_globs=("*.sql",)))
    clean = on[0]["diff_clean"]
    assert clean == ("diff --git a/x.py b/x.py\n+a = 1\n+password=[REDACTED:kv_secret]\n[REDACTED:private_key_block]\n+z")
    assert on[0]["privacy"]["redactions"] == ["diff_captured", "diff_scrubbed", "diff_suppressed_ignored"]
    assert on[0]["payload"]["diff_lines"] == "5" and on[0]["payload"]["diff_truncated"] == "false" and len(on[0]["payload"]["diff_ref"]) == 64
    assert on[1]["payload"]["body"] == "why token=[REDACTED:kv_secret]" and "commit_body_captured" in on[1]["privacy"]["redactions"]
    assert on[2]["payload"]["body"] is None and on[2]["payload"]["diff_ref"] is None and on[2]["privacy"]["redactions"] == ["content_stripped"]


def test_diff_limits(spark, column):
    big = "diff --git a/x b/x\n" + "\n".join(f"+line {i}" for i in range(30))
    got = column(lambda: diffs.scrub_diff("v", diffs.CapturePolicy(True, max_lines=5)), [big, "Binary files a and b differ", "", "   ", "x" * 50])
    assert got[0]["clean"].split("\n")[-1] == "[diff truncated]" and len(got[0]["clean"].split("\n")) == 6
    assert list(got[0]["codes"]) == ["diff_captured", "diff_truncated"] and list(got[1]["codes"]) == ["diff_binary_suppressed"]
    assert got[2]["clean"] is None and got[3]["clean"] is None
    multi = column(lambda: diffs.scrub_diff("v", diffs.CapturePolicy(True, max_bytes=7)), ["aéaéaéaé"])
    assert multi[0]["clean"] == "aéaéa\n[diff truncated]"


def test_egress_and_audit(spark):
    gated = gate.gate(events(spark, [("NARRATION", {"note": "token=abc"}), ("FILE_CHANGE", {"path": "/no/x"})]), ["/w"], passed_at=NOW)
    rows = gated.drop("drop_reason", "diff_clean")
    assert [r["event_id"] for r in gate.blocked(rows).collect()] == ["1"]
    assert [r["payload"]["note"] for r in gate.sendable(rows).collect()] == ["token=[REDACTED:kv_secret]"]
    assert audit.is_clean(gate.kept(gated))
    leaky = events(spark, [("NARRATION", {"note": "token=abc in /home/al/x"})])
    report = {(r["measure"], r["name"]): r["n"] for r in audit.leak_report(leaky).collect()}
    assert report == {("audited", ""): 1, ("leaks", ""): 1, ("leak_type", "path"): 1, ("leak_type", "kv_secret"): 1}


def test_sidecars_are_verified(spark):
    rows = spark.createDataFrame([("body one",), ("body one",), ("body two",), (None,)], "diff_clean STRING")
    made = diffs.sidecars(rows)
    assert made.count() == 2 and diffs.verified(made).count() == 2
    forged = made.withColumn("body", F.concat("body", F.lit("!")))
    assert diffs.verified(forged).count() == 0


def test_clean_texts_are_taken_out_once(spark):
    from daybrook.model import PAYLOAD_TYPE
    # the list of clean texts is one value that all fields read, not an expression a field
    said = str(gate.scrub_nested(F.col("payload"), PAYLOAD_TYPE))
    assert "[REDACTED:" in said and said.count("transform(") < 60
