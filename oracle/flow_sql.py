"""Answers for intake, accounts, reports, prompts, registry jobs and streams."""

from daybrook.plans.prompts import INSTRUCTIONS

from .base import ACTIVITY, ARCHIVE, ATTRIBUTED, GATED, RAW_TIMELINE, q
from .session_sql import EV

_TYPES = "['AGENT_REPORT', 'CLIPBOARD', 'DEEP_WORK', 'FILE_CHANGE', 'FOCUS_SESSION', 'GIT_COMMIT', 'IDLE_END', 'IDLE_START', 'LONG_RUN', 'NARRATION']"
_TYPES_MSG = "type must be one of " + _TYPES
_KINDS_MSG = "source.kind must be one of ['agent', 'fs', 'git', 'intent', 'os', 'remote']"
_TRUST_MSG = "trust must be one of ['low_trust', 'rejected', 'validated']"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


REPORTS = EV + r"""
r AS (SELECT event_id, 'f' || event_id || '.json' AS file_name, k, user_id % 5 AS a, ts,
  CASE WHEN k % 13 = 0 THEN 'junk' WHEN k % 13 = 1 THEN 'flat' ELSE 'ok' END AS shape,
  CASE WHEN k % 11 = 0 THEN 'late' WHEN k % 11 = 1 THEN 'bad' ELSE 'ok' END AS time,
  CASE WHEN k % 7 = 0 THEN 'remote' WHEN k % 7 = 1 THEN 'banana' ELSE 'agent' END AS kind FROM ev),
v AS (SELECT *,
  CASE WHEN shape = 'junk' THEN ['unreadable_report_file'] ELSE list_filter([
    CASE WHEN kind = 'banana' THEN """ + lit(_KINDS_MSG) + r""" END, CASE WHEN time = 'bad' THEN 'ts_wall is not a valid ISO-8601 timestamp' END,
    CASE WHEN shape = 'flat' THEN 'payload must be an object' END], lambda x: x IS NOT NULL) END AS errors,
  list_filter([CASE WHEN kind <> 'agent' THEN 'source_kind_not_agent' END, CASE WHEN a > 2 THEN 'unknown_identity' END,
    CASE WHEN time = 'late' THEN 'future_timestamp' END], lambda x: x IS NOT NULL) AS reasons FROM r),
verdicts AS (SELECT *, CASE WHEN len(errors) > 0 THEN 'rejected' WHEN len(reasons) > 0 THEN 'low_trust' ELSE 'validated' END AS trust FROM v),
"""
HOSTED = r"""
p AS (SELECT o_orderkey AS k, 'github.com/acme/r' || (o_orderkey % 9) || CASE WHEN o_orderkey % 3 = 0 THEN '.git' ELSE '' END AS remote, o_orderkey % 9 AS r,
  CASE WHEN o_orderkey % 4 = 0 THEN 'dependabot[bot]' ELSE c_name END AS login, c_name, o_orderpriority AS title, o_orderstatus AS st,
  strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS day FROM orders JOIN customer ON o_custkey = c_custkey),
t AS (SELECT * FROM p WHERE r < 6),
"""

DIGESTS = ATTRIBUTED + """
dg AS (SELECT project_id, date_key, type, hhmm, ts_wall, at_us, recv_ts, event_id, CASE
    WHEN session THEN '[' || hhmm || '] ' || type || ' ' || dur || 's' || coalesce(' (' || mode || ')', '')
      || chr(10) || '  focus: ' || coalesce(anchor, process) || ' [' || process || ']'
      || coalesce(chr(10) || '  file: ' || active_file, '') || coalesce(chr(10) || '  intent: "' || intent_label || '"', '')
      || CASE WHEN len(sat_titles) > 0 THEN chr(10) || '  also: ' || array_to_string(sat_titles, ', ') ELSE '' END || coalesce(chr(10) || '  cmd: ' || cmdline, '')
    WHEN type = 'FILE_CHANGE' THEN '[' || hhmm || '] file modified: ' || path
    WHEN type = 'GIT_COMMIT' THEN '[' || hhmm || '] commit' || coalesce(' by ' || actor, '') || ': ' || message || CASE WHEN len(files) > 0 THEN ' (2 files)' ELSE '' END || ' [' || repo || ']'
    WHEN type = 'NARRATION' THEN '[' || hhmm || '] narration: "' || note || '"'
    WHEN type = 'CLIPBOARD' THEN rtrim('[' || hhmm || '] clipboard ' || clip_kind || ' ' || coalesce(host, ''))
    WHEN type = 'AGENT_REPORT' THEN '[' || hhmm || '] agent report (' || identity || '): ' || summary END AS d
  FROM attributed),
"""

SQL = {
    "validate_messages": q(ACTIVITY, f"""
SELECT arrival_seq, CASE WHEN arrival_seq % 31 = 0 THEN 'event must be an object' ELSE array_to_string(list_filter([
  CASE WHEN arrival_seq % 13 = 0 THEN 'schema_version must be 2' END, CASE WHEN arrival_seq % 17 = 0 THEN {lit(_TYPES_MSG)} END,
  CASE WHEN arrival_seq % 19 = 0 THEN {lit(_KINDS_MSG)} END, CASE WHEN adapter = '' THEN 'source.adapter is required' END,
  CASE WHEN arrival_seq % 23 = 0 THEN 'ts_wall is required (ISO-8601 string)' WHEN ts_wall = 'not a time' THEN 'ts_wall is not a valid ISO-8601 timestamp' END,
  CASE WHEN arrival_seq % 29 = 0 THEN {lit(_TRUST_MSG)} END], lambda x: x IS NOT NULL), '; ') END AS messages FROM activity"""),
    "trust_routes": q(REPORTS, """
SELECT file_name, trust, CASE WHEN shape = 'junk' THEN file_name ELSE 'agent:' || a END AS identity,
  array_to_string(CASE trust WHEN 'rejected' THEN errors ELSE reasons END, '; ') AS why,
  CASE WHEN trust <> 'rejected' THEN 'did ' || event_id END AS summary FROM verdicts"""),
    "stream_trust": q(REPORTS, "SELECT trust, count(*) AS n_reports FROM verdicts GROUP BY trust"),
    "repo_payload_events": q(HOSTED, """
SELECT k, 'remote' AS kind, 'github:' || c_name AS identity, day AS ts_wall, 'commit ' || substr(sha256(CAST(k AS VARCHAR)), 1, 7) || ': ' || title AS summary, 'commit' AS detail, 'a.py' AS files FROM t
UNION ALL SELECT k, CASE WHEN k % 4 = 0 THEN 'agent' ELSE 'remote' END, CASE WHEN k % 4 = 0 THEN 'agent:' ELSE 'github:' END || login, day,
  CASE WHEN k % 10 = 0 THEN 'merged' WHEN k % 5 = 0 THEN 'closed' WHEN k % 7 = 0 THEN 'drafted' ELSE 'opened' END || ' PR #' || k || ': ' || title, 'pull_request', '' FROM t
UNION ALL SELECT k, 'remote', 'ci:' || st, day, 'CI ' || st || ': ' || CASE WHEN k % 2 = 0 THEN 'success' ELSE 'queued' END, 'workflow_run', '' FROM t"""),
    "incremental_pulls": """
SELECT CAST(o_orderkey AS VARCHAR) AS number, strftime(o_orderdate, '%Y-%m-%d') AS updated_at, o_orderkey % 3 = 0 OR (o_orderkey % 5 = 0) AS emitted FROM orders""",
    "hook_reports": q(EV, """
SELECT event_id, CASE k % 3 WHEN 0 THEN CASE WHEN k % 2 = 0 THEN 'Claude Code Edit: f' || event_id || '.py' ELSE 'Claude Code used Edit' END
    WHEN 1 THEN 'Claude Code finished a session in p' || (k % 4) ELSE 'Claude Code event: Notify' END AS summary,
  '/w/p' || (k % 4) AS repo, 'p' || (k % 4) AS project, CASE WHEN k % 6 = 0 THEN '/w/x/f' || event_id || '.py' ELSE '' END AS files FROM ev"""),
    "egress_split": q(GATED, """
SELECT event_id, 'sendable' AS route, coalesce(note, '') AS note FROM stored
UNION ALL SELECT event_id, 'blocked', '' FROM gated WHERE drop_reason IS NOT NULL"""),
    "account_store": q(GATED, """
s AS (SELECT *, arrival_seq % 7 AS t FROM stored)
SELECT 'team_' || t AS account, replace(substr(ts_wall, 1, 10), '-', '') AS date_key, count(*) AS n_rows FROM s WHERE t < 5 AND ts_wall >= '2024-01-10' GROUP BY ALL
UNION ALL SELECT '(unauthorised)', '', count(*) FROM s WHERE t >= 5"""),
    "standup_rows": q(ATTRIBUTED, """
d AS (SELECT date_label, project_id, count(*) AS n FROM attributed WHERE project_id IS NOT NULL AND regexp_matches(date_key, '^[0-9]{8}$') GROUP BY ALL),
s AS (SELECT date_label, row_number() OVER (ORDER BY date_label DESC) AS section_no FROM (SELECT DISTINCT date_label FROM d))
SELECT CAST(section_no AS INTEGER) AS section_no, CAST(1 AS BIGINT) AS pos, '- **' || project_id || '** — ' || n || ' events' AS text FROM d JOIN s USING (date_label) WHERE section_no <= 7
UNION ALL SELECT CAST(section_no AS INTEGER), CAST(0 AS BIGINT), '### ' || date_label FROM s WHERE section_no <= 7"""),
    "timeline_rows": q(DIGESTS, """
t AS (SELECT hhmm AS clock, type, CASE WHEN d IS NULL THEN type ELSE regexp_replace(string_split(d, chr(10))[1], '^\\[[0-9]{1,2}:[0-9]{2}\\] ', '') END AS text FROM dg)
SELECT clock, type, text, count(*) AS n FROM t GROUP BY ALL"""),
    "project_bars": q(ATTRIBUTED, """
s AS (SELECT CASE project_id WHEN 'atlas' THEN 'Atlas' WHEN 'borealis' THEN 'Borealis' ELSE 'Cobalt' END AS name, CAST(sum(dur) AS BIGINT) AS seconds
  FROM attributed WHERE project_id IS NOT NULL AND session GROUP BY project_id HAVING sum(dur) > 0)
SELECT name, seconds, CASE WHEN seconds >= 3600 THEN (seconds // 3600) || 'h' || lpad(CAST((seconds // 60) % 60 AS VARCHAR), 2, '0') || 'm' ELSE (seconds // 60) || 'm' END AS label,
  CAST(greatest(2, round_even(360.0 * seconds / (SELECT max(seconds) FROM s), 0)) AS INTEGER) AS bar FROM s"""),
    "review_batches": q(ATTRIBUTED, """
n AS (SELECT count(*) AS n FROM attributed WHERE method = 'needs_review' AND (trim(blob) <> '' OR trim(low_note) <> '')),
b AS (SELECT unnest(generate_series(0, (n - 1) // 150)) AS batch_no, n FROM n)
SELECT CAST(batch_no AS BIGINT) AS batch_no, CAST(least(150, n - batch_no * 150) AS BIGINT) AS n_events,
  CAST(least(8000, greatest(1500, 80 * least(150, n - batch_no * 150))) AS INTEGER) AS max_tokens FROM b"""),
    "day_tokens": q(DIGESTS, """
SELECT project_id, date_key, CAST(greatest(1, (sum(length(d)) + 2 * (count(d) - 1)) // 4) AS BIGINT) AS tokens FROM dg WHERE project_id IS NOT NULL GROUP BY ALL"""),
    "activity_chunks": q(DIGESTS, """
n AS (SELECT *, row_number() OVER (PARTITION BY project_id, date_key ORDER BY ts_wall, at_us IS NULL, at_us, recv_ts, event_id) AS n FROM dg WHERE project_id IS NOT NULL)
SELECT project_id, date_key, CAST((n - 1) // 20 AS BIGINT) AS chunk_no, count(*) AS n_events, md5(string_agg(d, chr(10) || chr(10) ORDER BY n)) AS block_md5 FROM n GROUP BY ALL"""),
    "apply_review": q(ATTRIBUTED, """
rv AS (SELECT arrival_seq, (row_number() OVER (ORDER BY ts_wall, recv_ts, event_id) - 1) % 150 AS idx FROM attributed
  WHERE method = 'needs_review' AND (trim(blob) <> '' OR trim(low_note) <> '')),
j AS (SELECT a.event_id, a.method, a.project_id, a.confidence, r.idx FROM attributed a LEFT JOIN rv r USING (arrival_seq)),
o AS (SELECT CASE WHEN idx IS NULL THEN method WHEN idx % 3 <> 0 AND idx % 2 = 0 THEN 'llm' ELSE method END AS method,
  coalesce(CASE WHEN idx IS NOT NULL AND idx % 3 <> 0 AND idx % 2 = 0 THEN 'cobalt' ELSE project_id END, '') AS project_id,
  CAST(CASE WHEN idx IS NULL THEN round(confidence, 4) WHEN idx % 2 = 0 THEN 0.9 ELSE 0.4 END AS DOUBLE) AS confidence FROM j)
SELECT method, project_id, confidence, count(*) AS n_events FROM o GROUP BY ALL"""),
    "apply_entries": q(DIGESTS, """
n AS (SELECT project_id, date_key, row_number() OVER (PARTITION BY project_id, date_key) AS n FROM dg WHERE project_id IS NOT NULL),
parts AS (SELECT DISTINCT project_id, date_key, (n - 1) // 20 AS chunk_no FROM n)
SELECT project_id, date_key, md5(CASE WHEN substr(date_key, 8, 1) IN ('0', '3', '6', '9') THEN '(archive)'
  ELSE string_agg('part ' || chunk_no || ' of ' || project_id, chr(10) || chr(10) ORDER BY chunk_no) END) AS entry_md5 FROM parts GROUP BY project_id, date_key"""),
    "overview_rounds": q(DIGESTS, """
n AS (SELECT *, row_number() OVER (PARTITION BY project_id, date_key ORDER BY ts_wall, at_us IS NULL, at_us, recv_ts, event_id) AS n FROM dg WHERE project_id IS NOT NULL),
b AS (SELECT project_id, date_key, (n - 1) // 20 AS chunk_no, string_agg(d, chr(10) || chr(10) ORDER BY n) AS block FROM n GROUP BY ALL HAVING coalesce(block, '') <> ''),
p AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY date_key, chunk_no) - 1 AS i, count(*) OVER (PARTITION BY project_id) AS pieces FROM b),
r0 AS (SELECT project_id, i // 6 AS node_no, any_value(pieces) AS pieces, count(*) AS n_pieces, string_agg(block, chr(10) || chr(10) ORDER BY i) AS material FROM p GROUP BY project_id, i // 6),
sizes AS (SELECT DISTINCT project_id, 0 AS round, CAST(ceil(pieces / 6) AS BIGINT) AS nodes, pieces FROM r0
  UNION ALL SELECT project_id, round + 1, CAST(ceil(nodes / 6) AS BIGINT), nodes FROM sizes WHERE nodes > 1)
SELECT project_id, 0 AS round, node_no, CASE WHEN pieces <= 6 THEN 'overview' ELSE 'chunk' END AS label, n_pieces,
  sha256(CASE WHEN pieces <= 6 THEN """ + lit(INSTRUCTIONS["overview"]) + """ ELSE """ + lit(INSTRUCTIONS["chunk"]) + """ END || chr(10) || 'PROJECT: ' || project_id || chr(10) || 'CURRENT OVERVIEW:' || chr(10)
    || chr(10) || chr(10) || 'NEW ACTIVITY:' || CASE WHEN pieces <= 6 THEN '' ELSE chr(10) || 'PART: ' || (node_no + 1) END || chr(10) || chr(10) || material) AS said FROM r0
UNION ALL SELECT project_id, round, node_no, CASE WHEN nodes = 1 THEN 'overview' ELSE 'chunk' END, least(6, pieces - 6 * node_no), '' FROM (SELECT *, unnest(range(nodes)) AS node_no FROM sizes WHERE round > 0)
UNION ALL SELECT project_id, -1, 0, 'day', 0, 'round ' || round || ' node 0' FROM sizes WHERE nodes = 1""").replace("WITH ", "WITH RECURSIVE ", 1),
    "unit_prompts": q(DIGESTS, """
n AS (SELECT *, row_number() OVER (PARTITION BY project_id, date_key ORDER BY ts_wall, at_us IS NULL, at_us, recv_ts, event_id) AS n FROM dg WHERE project_id IS NOT NULL),
dy AS (SELECT project_id, date_key, CAST(greatest(1, (sum(length(d)) + 2 * (count(d) - 1)) // 4) AS BIGINT) AS t, string_agg(d, chr(10) || chr(10) ORDER BY n) AS block FROM n GROUP BY ALL),
l AS (SELECT project_id, list(struct_pack(k := date_key, t := t, d := CASE WHEN regexp_matches(date_key, '^[0-9]{8}$') THEN date_diff('day', DATE '1970-01-01', CAST(strptime(date_key, '%Y%m%d') AS DATE)) END) ORDER BY date_key) AS days FROM dy GROUP BY project_id),
f AS (SELECT project_id, days, list_reduce(list_transform(days, lambda x: struct_pack(u := [1], first := x.d, used := x.t, t := x.t, d := x.d)),
  lambda acc, x: CASE WHEN acc.used + x.t > 3000 OR coalesce(x.d - acc.first + 1, 1) > 5 THEN struct_pack(u := list_append(acc.u, acc.u[-1] + 1), first := x.d, used := x.t, t := x.t, d := x.d)
    ELSE struct_pack(u := list_append(acc.u, acc.u[-1]), first := acc.first, used := acc.used + x.t, t := x.t, d := x.d) END) AS r FROM l),
u AS (SELECT project_id, unnest(list_transform(days, lambda x: x.k)) AS date_key, CAST(unnest(r.u) AS BIGINT) AS unit_no FROM f),
w AS (SELECT u.*, dy.block, count(*) OVER (PARTITION BY u.project_id, unit_no) AS n_days,
  CASE WHEN regexp_matches(u.date_key, '^[0-9]{8}$') THEN substr(u.date_key, 1, 4) || '-' || substr(u.date_key, 5, 2) || '-' || substr(u.date_key, 7, 2) ELSE u.date_key END AS label FROM u JOIN dy USING (project_id, date_key))
SELECT project_id, unit_no, n_days, CASE WHEN n_days > 1 THEN 'entry_batch' ELSE 'entry' END AS label,
  sha256('PROJECT: ' || project_id || chr(10) || 'CAPTURE:' || chr(10) || '- grades' || chr(10) || chr(10) || 'ACTIVITY:' || chr(10)
    || string_agg('## ' || w.label || chr(10) || block, chr(10) || chr(10) ORDER BY date_key)) AS user_sha256 FROM w WHERE coalesce(block, '') <> '' GROUP BY project_id, unit_no, n_days"""),
    "journal_lines": q(ARCHIVE, """
days AS (SELECT DISTINCT project_id, date_key, date_label FROM lines),
used AS (SELECT DISTINCT project_id, date_key, date_label, section_no FROM lines),
doc AS (SELECT project_id, date_key, date_label, text FROM lines
  UNION ALL SELECT project_id, date_key, date_label, unnest(['---', '## ' || date_label, '', '---', '']) FROM days
  UNION ALL SELECT project_id, date_key, date_label, ['### Sessions', '### Commits', '### Agent activity', '### Files changed', '### Narration'][section_no] FROM used WHERE section_no <= 5
  UNION ALL SELECT project_id, date_key, date_label, '' FROM used)
SELECT project_id, date_key, 'archive' AS origin, text, count(*) AS n FROM doc WHERE substr(date_key, 8, 1) IN ('0', '3', '6', '9') GROUP BY ALL
UNION ALL SELECT project_id, date_key, 'entry', text, count(*) FROM (SELECT project_id, date_key, unnest(['---', '## ' || date_label, '', 'wrote ' || project_id, '', '---', '']) AS text FROM days
  WHERE substr(date_key, 8, 1) NOT IN ('0', '3', '6', '9')) GROUP BY ALL"""),
    "discovered_clashes": r"""
WITH t AS (SELECT p_partkey % 5 AS d, string_split(p_name, ' ')[1] AS w, p_partkey FROM part),
s AS (SELECT CASE WHEN d > 1 THEN w || '-' || d ELSE w END AS slug, '/repos/' || p_partkey || '/' || CASE WHEN d > 1 THEN w || '-' || d ELSE w END AS path FROM t),
ids AS (SELECT id, regexp_replace(id, '-[0-9]+$', '') AS stem, TRY_CAST(regexp_extract(id, '-([0-9]+)$', 1) AS INTEGER) AS k
  FROM (SELECT DISTINCT slug AS id FROM s UNION SELECT unnest(['small', 'red-3']))),
used AS (SELECT stem AS slug, list(DISTINCT k) AS ks FROM ids WHERE k IS NOT NULL GROUP BY stem),
n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY path) + CASE WHEN slug IN ('small', 'red-3') THEN 1 ELSE 0 END AS nth FROM s),
f AS (SELECT n.slug, path, nth, list_filter(range(2, CAST(nth + 1 + coalesce(len(ks), 0) AS BIGINT)), lambda x: NOT coalesce(list_contains(ks, x), false)) AS free
  FROM n LEFT JOIN used USING (slug))
SELECT CASE WHEN nth = 1 THEN slug ELSE slug || '-' || free[nth - 1] END AS id, path FROM f""",
    "discovered_projects": r"""
WITH t AS (SELECT *, replace(p_name, ' ', '-') AS slug, '/repos/' || p_partkey || '/' || p_name AS path FROM part WHERE NOT (p_partkey = 0 AND p_name = 'small ring')),
n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY path) AS nth FROM t),
f AS (SELECT *, CASE WHEN slug = 'small-ring' THEN nth + 1 WHEN slug = 'red-widget' AND nth >= 3 THEN nth + 1 ELSE nth END AS no FROM n)
SELECT CASE WHEN no = 1 THEN slug ELSE slug || '-' || no END AS id, p_name AS name, path, p_name AS keywords,
  CASE WHEN p_size % 2 = 0 THEN 'python.exe|Code.exe|go.exe' ELSE '' END AS apps,
  '.*' || replace(p_name, ' ', '\W*') || '.*|.*' || replace(p_name, ' ', '\ ') || '.*' AS patterns FROM f""",
    "stream_dedup": "SELECT event_id, user_id FROM events",
    "stream_rollup": "SELECT event_type AS key, CAST(date_trunc('day', ts) AS TIMESTAMP) AS from_ts, count(*) AS n_events FROM events GROUP BY ALL",
    "stream_sliding": """
SELECT key, from_ts, count(*) AS n_events FROM (SELECT event_type AS key,
  unnest([time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 3 HOUR]) AS from_ts
  FROM events) GROUP BY ALL""",
    "stream_timeline": q(RAW_TIMELINE, "SELECT event_id, arrival_seq, trust, date_key FROM timeline"),
    "daily_archive": q(ARCHIVE, "SELECT project_id, date_key, count(*) AS n_lines FROM lines GROUP BY ALL"),
}
