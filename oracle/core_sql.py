"""Answers for gate, timeline, attribution and rollup queries."""

from .base import ACTIVITY, ARCHIVE, ATTRIBUTED, GATED, RAW_TIMELINE, q

SQL = {
    "time_per_project": q(ATTRIBUTED, """
SELECT CASE project_id WHEN 'atlas' THEN 'Atlas' WHEN 'borealis' THEN 'Borealis' ELSE 'Cobalt' END AS name,
       CAST(sum(dur) AS BIGINT) AS seconds
FROM attributed WHERE project_id IS NOT NULL AND session GROUP BY project_id HAVING sum(dur) > 0"""),
    "reconcile_timeline": q(RAW_TIMELINE, """
SELECT event_id, arrival_seq, trust, date_key, make_timestamp(at_us) AS effective_ts FROM timeline"""),
    "dedup_winner": q(RAW_TIMELINE, """
SELECT event_id, arrival_seq, trust, recv_ts FROM timeline"""),
    "equal_events_stay": q(ACTIVITY, """
two AS (SELECT ts_wall, type, identity FROM activity WHERE event_id = '' AND trust <> 'rejected')
SELECT ts_wall, type, identity AS host, 2 * count(*) AS n FROM two GROUP BY ALL"""),
    "lateness_by_host": q(ACTIVITY, """
late AS (SELECT identity, (epoch_us(CAST(recv_ts AS TIMESTAMPTZ)) - (epoch_us(CAST(CASE WHEN regexp_matches(ts_wall, '(Z|[+-][0-9][0-9]:[0-9][0-9])$') THEN ts_wall ELSE ts_wall || 'Z' END AS TIMESTAMPTZ)) - offset_sec * 1000000)) / 1e6 AS s
  FROM activity WHERE recv_ts <> '' AND ts_wall <> 'not a time')
SELECT identity AS host, count(s) AS n_events, count(*) FILTER (WHERE s > 0) AS n_late, max(s) AS max_sec, round(avg(s), 4) AS mean_sec
FROM late GROUP BY identity"""),
    "lateness_quantiles": q(ACTIVITY, """
late AS (SELECT identity FROM activity WHERE recv_ts <> '' AND ts_wall <> 'not a time')
SELECT identity AS host, count(*) AS n_events, true AS p50_holds, true AS p95_holds FROM late GROUP BY identity"""),
    "attribution_methods": q(ATTRIBUTED, "SELECT method, count(*) AS n_events FROM attributed GROUP BY method"),
    "attribution_events": q(ATTRIBUTED, """
SELECT arrival_seq, type, project_id, round(confidence, 4) AS confidence, CASE WHEN method = 'unattributed' THEN NULL ELSE method END AS method
FROM attributed"""),
    "attribution_ties": q(ATTRIBUTED, """
SELECT round(top, 4) AS score, array_to_string(best, ', ') AS tied, count(*) AS n_events
FROM attributed WHERE top >= 0.51 AND len(best) > 1 GROUP BY ALL"""),
    "gate_outcomes": q(GATED, """
facts AS (
  SELECT 'written' AS measure, '' AS name FROM gated WHERE drop_reason IS NULL
  UNION ALL SELECT 'dropped', drop_reason FROM gated WHERE drop_reason IS NOT NULL
  UNION ALL SELECT 'redaction', 'clipboard_typed' FROM stored WHERE type = 'CLIPBOARD'
  UNION ALL SELECT 'redaction', 'kv_secret' FROM stored WHERE contains(note, 'REDACTED')
  UNION ALL SELECT 'redaction', 'path' FROM stored WHERE active_file IS NOT NULL OR cmdline IS NOT NULL OR path IS NOT NULL OR type = 'GIT_COMMIT')
SELECT measure, name, count(*) AS n FROM facts GROUP BY ALL"""),
    "gated_events": q(GATED, """
SELECT arrival_seq, event_id, type, path, repo, note, host, clip_kind, cmdline,
  array_to_string(list_filter([CASE WHEN type = 'CLIPBOARD' THEN 'clipboard_typed' END,
    CASE WHEN contains(note, 'REDACTED') THEN 'kv_secret' END,
    CASE WHEN active_file IS NOT NULL OR cmdline IS NOT NULL OR path IS NOT NULL OR type = 'GIT_COMMIT' THEN 'path' END],
    lambda x: x IS NOT NULL), ',') AS codes
FROM stored"""),
    "archive_lines": q(ARCHIVE, "SELECT project_id, date_label, section_no, line_no, text FROM numbered"),
    "archive_files": q(ARCHIVE, "SELECT project_id, date_key, file, ts_wall AS first_ts, o_class FROM firsts WHERE rn = 1"),
    "archive_document": q(ARCHIVE, """
days AS (SELECT DISTINCT project_id, date_label FROM lines),
used AS (SELECT DISTINCT project_id, date_label, section_no FROM lines)
SELECT project_id, date_label, section_no, o_class, text, count(*) AS n FROM (
  SELECT project_id, date_label, section_no, o_class, text FROM lines
  UNION ALL SELECT project_id, date_label, 0, 0, unnest(['---', '## ' || date_label, '']) FROM days
  UNION ALL SELECT project_id, date_label, section_no, -1, ['### Sessions', '### Commits', '### Agent activity', '### Files changed', '### Narration'][section_no]
    FROM used WHERE section_no <= 5
  UNION ALL SELECT project_id, date_label, section_no, 9, '' FROM used
  UNION ALL SELECT project_id, date_label, 7, 0, unnest(['---', '']) FROM days) GROUP BY ALL"""),
    "section_merge": q(ARCHIVE, """
labels AS (SELECT DISTINCT project_id, date_label FROM lines WHERE regexp_matches(date_key, '^[0-9]{8}$')),
old AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY date_label) AS label_pos FROM labels WHERE date_label <= '2024-01-20'),
fresh AS (SELECT * FROM labels WHERE date_label >= '2024-01-15'),
unseen AS (SELECT f.project_id, f.date_label, row_number() OVER (PARTITION BY f.project_id ORDER BY f.date_label) AS nth
  FROM fresh f ANTI JOIN old o ON f.project_id = o.project_id AND f.date_label = o.date_label),
place AS (SELECT project_id, date_label, label_pos FROM old UNION ALL
  SELECT u.project_id, u.date_label, coalesce((SELECT max(label_pos) FROM old o WHERE o.project_id = u.project_id), 0) + nth FROM unseen u)
SELECT l.project_id, l.date_label, p.label_pos, l.section_no,
  CASE WHEN l.date_label >= '2024-01-15' THEN 'new' ELSE 'old' END AS batch, l.text
FROM lines l JOIN place p ON l.project_id = p.project_id AND l.date_label = p.date_label
WHERE regexp_matches(l.date_key, '^[0-9]{8}$')"""),
    "period_rollup_week": q(ARCHIVE, """
SELECT project_id, CASE WHEN regexp_matches(date_key, '^[0-9]{8}$') THEN strftime(strptime(date_key, '%Y%m%d'), '%G-W%V') ELSE '0000-W00' END AS period_key,
  section_no, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM lines GROUP BY ALL"""),
    "period_rollup_month": q(ARCHIVE, """
SELECT project_id, CASE WHEN regexp_matches(date_key, '^[0-9]{8}$') THEN substr(date_key, 1, 4) || '-' || substr(date_key, 5, 2) ELSE '0000-00' END AS period_key,
  section_no, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM lines GROUP BY ALL"""),
    "period_fallback": q(ARCHIVE, """
wk AS (SELECT *, CASE WHEN regexp_matches(date_key, '^[0-9]{8}$') THEN strftime(strptime(date_key, '%Y%m%d'), '%G-W%V') ELSE '0000-W00' END AS period_key FROM lines),
written AS (SELECT DISTINCT project_id, period_key FROM wk WHERE section_no = 5)
SELECT w.project_id, w.period_key, CASE WHEN t.project_id IS NULL THEN 'archive' ELSE 'entries' END AS origin, count(*) AS n_lines
FROM wk w LEFT JOIN written t ON w.project_id = t.project_id AND w.period_key = t.period_key
WHERE t.project_id IS NULL OR w.section_no = 5 GROUP BY ALL"""),
    "affected_periods": q(ATTRIBUTED, """
SELECT DISTINCT CASE WHEN regexp_matches(date_key, '^[0-9]{8}$') THEN strftime(strptime(date_key, '%Y%m%d'), '%G-W%V') ELSE '0000-W00' END AS period_key
FROM attributed WHERE project_id IS NOT NULL"""),
    "project_fingerprint": q(ATTRIBUTED, """
h AS (SELECT project_id, sha256(CAST(to_json([event_id, ts_wall, recv_ts, type, trust, identity, CASE WHEN session THEN coalesce(anchor, '') END, process, active_file, mode, intent_label, cmdline,
  path, repo, message, actor, note, host, clip_kind, summary, tool]) AS VARCHAR)) AS h FROM attributed WHERE project_id IS NOT NULL),
s AS (SELECT project_id, count(*) AS n,
  CAST(sum(CAST(CAST('0x' || substr(h, 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS a, CAST(sum(CAST(CAST('0x' || substr(h, 16, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS b,
  CAST(sum(CAST(CAST('0x' || substr(h, 31, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS c, CAST(sum(CAST(CAST('0x' || substr(h, 46, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS d
  FROM h GROUP BY project_id)
SELECT project_id, n AS n_rows, sha256(n || '|' || a || '|' || b || '|' || c || '|' || d) AS fingerprint FROM s"""),
    "incremental_days": q(ATTRIBUTED, """
days AS (SELECT DISTINCT project_id, date_key FROM attributed WHERE project_id IS NOT NULL),
done AS (SELECT DISTINCT project_id, date_key FROM attributed WHERE project_id IS NOT NULL AND type = 'GIT_COMMIT')
SELECT d.project_id, d.date_key FROM days d ANTI JOIN done o ON d.project_id = o.project_id AND d.date_key = o.date_key"""),
    "refresh_runs": q(ATTRIBUTED, """
own AS (SELECT project_id, date_key, event_id FROM attributed WHERE project_id IS NOT NULL),
one AS (SELECT min(event_id) AS id FROM own WHERE event_id <> ''),
gone AS (SELECT max(date_key) AS d FROM own WHERE project_id = 'cobalt'),
days AS (SELECT project_id, date_key, count(*) AS n FROM own GROUP BY ALL),
touched AS (
  SELECT 1 AS run, project_id, date_key, n, 'written' AS action FROM days
  UNION ALL SELECT 3, project_id, date_key, n, 'written' FROM days WHERE (project_id, date_key) IN (SELECT (project_id, date_key) FROM own WHERE event_id = (SELECT id FROM one))
  UNION ALL SELECT 4, project_id, date_key, n, 'removed' FROM days WHERE project_id = 'cobalt' AND date_key = (SELECT d FROM gone)),
keys AS (
  SELECT *, CASE WHEN regexp_matches(date_key, '^[0-9]{8}$') THEN strftime(strptime(date_key, '%Y%m%d'), '%G-W%V') ELSE '0000-W00' END AS wk,
    CASE WHEN regexp_matches(date_key, '^[0-9]{8}$') THEN substr(date_key, 1, 4) || '-' || substr(date_key, 5, 2) ELSE '0000-00' END AS mo FROM touched),
left_over AS (SELECT CASE WHEN regexp_matches(date_key, '^[0-9]{8}$') THEN strftime(strptime(date_key, '%Y%m%d'), '%G-W%V') ELSE '0000-W00' END AS wk,
    CASE WHEN regexp_matches(date_key, '^[0-9]{8}$') THEN substr(date_key, 1, 4) || '-' || substr(date_key, 5, 2) ELSE '0000-00' END AS mo
  FROM days WHERE project_id = 'cobalt' AND date_key <> (SELECT d FROM gone))
SELECT run, project_id, 'day' AS level, date_key AS key, action FROM keys
UNION SELECT run, project_id, 'week', wk, CASE WHEN run = 4 AND wk NOT IN (SELECT wk FROM left_over) THEN 'removed' ELSE 'written' END FROM keys
UNION SELECT run, project_id, 'month', mo, CASE WHEN run = 4 AND mo NOT IN (SELECT mo FROM left_over) THEN 'removed' ELSE 'written' END FROM keys
UNION SELECT run, project_id, 'project', '', CASE WHEN run = 4 AND NOT EXISTS (SELECT 1 FROM left_over) THEN 'removed' ELSE 'written' END FROM keys
UNION SELECT run, project_id, 'prompt', date_key, 'asks ' || unnest(range(0, CAST(ceil(n / 150) AS BIGINT))) FROM keys WHERE action = 'written'"""),
    "week_bodies": q(ARCHIVE, """
wk AS (SELECT CASE WHEN regexp_matches(date_key, '^[0-9]{8}$') THEN strftime(strptime(date_key, '%Y%m%d'), '%G-W%V') ELSE '0000-W00' END AS period_key, * FROM lines),
heads AS (SELECT DISTINCT period_key, project_id FROM wk)
SELECT period_key, project_id, 1 AS part, date_key, text, count(*) AS n FROM wk GROUP BY ALL
UNION ALL SELECT period_key, project_id, 0, '', '## ' || project_id, 1 FROM heads
UNION ALL SELECT period_key, project_id, 2, '', '', 1 FROM heads"""),
    "done_days": q(ATTRIBUTED, """
SELECT project_id, string_agg(DISTINCT date_key, ',' ORDER BY date_key) AS synth_days FROM attributed WHERE project_id IS NOT NULL GROUP BY project_id"""),
    "counts_grouping_sets": q(GATED, """
SELECT facet, value, count(*) AS n FROM (
  SELECT 'type' AS facet, type AS value FROM stored UNION ALL
  SELECT 'actor', coalesce(actor, '') FROM stored UNION ALL SELECT 'trust', trust FROM stored) GROUP BY ALL"""),
    "event_chunks": q(ATTRIBUTED, """
n AS (SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY ts_wall, at_us IS NULL, at_us, recv_ts, event_id) AS event_no
  FROM attributed WHERE project_id IS NOT NULL)
SELECT project_id, CAST((event_no - 1) // 150 AS BIGINT) AS chunk_no, count(*) AS n_events, max(event_no) AS last_no FROM n GROUP BY ALL"""),
    "attribution_by_joins": q(ATTRIBUTED, """
SELECT arrival_seq, CASE WHEN len(best) = 1 THEN best[1] END AS project_id, round(CAST(top AS DOUBLE), 4) AS score FROM attributed WHERE top > 0"""),
    "rules_in_pages": """
WITH n AS (SELECT p_partkey * 100 + unnest(range(100)) AS n FROM part),
rules AS (SELECT CASE n % 3 WHEN 0 THEN '/' WHEN 1 THEN ' ' ELSE '>' END || n AS pattern FROM n UNION SELECT c_name FROM customer UNION SELECT 'id' || c_custkey FROM customer UNION SELECT p_name FROM part)
SELECT pattern, count(*) AS n_pages, min(page_id) AS first_page FROM rules JOIN pages ON contains(html, pattern) GROUP BY pattern""",
    "expressions_in_urls": r"""
WITH forms AS (SELECT p_partkey AS k, unnest(['/en/' || p_partkey || '(?:#top|/|$)', 'ref=x.*' || p_partkey || '|page=2.{0,3}' || p_partkey,
  'BLOG\.[a-z]+(?:ou|an)\.example.*/' || p_partkey || '\b', '[a-z]{3}/' || p_partkey || '\.html', '(?P<lang>fr|de)/0*' || p_partkey || '[?/]']) AS pattern, unnest(range(5)) AS i FROM part)
SELECT page_id, k || '/' || i AS rule FROM forms JOIN pages ON regexp_matches(url, pattern, 'i')""",
}
