"""Shared SQL: the activity view, the gate on it, the timeline and the attribution."""

from __future__ import annotations

ACTIVITY = r"""
raw AS (
  SELECT event_id AS e, user_id AS u, event_type AS et, value AS v, ts,
         CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INTEGER) AS k
  FROM events),
copies AS (
  SELECT *, unnest(CASE WHEN e % 7 = 0 THEN [0, 1] ELSE [0] END) AS c FROM raw),
typed AS (
  SELECT *,
    CASE WHEN et = 'click' AND k % 3 = 0 THEN 'FILE_CHANGE'
         WHEN et = 'click' THEN 'FOCUS_SESSION'
         WHEN et = 'view' AND k % 5 = 0 THEN 'CLIPBOARD'
         WHEN et = 'view' THEN 'DEEP_WORK'
         WHEN et = 'error' AND k % 2 = 0 THEN 'AGENT_REPORT'
         WHEN et = 'error' THEN 'LONG_RUN'
         WHEN et = 'purchase' THEN 'GIT_COMMIT'
         WHEN k % 11 = 0 THEN 'IDLE_START'
         WHEN k % 11 = 1 THEN 'IDLE_END'
         ELSE 'NARRATION' END AS type,
    CASE WHEN u % 2 = 0 THEN '/home/dev' ELSE '/home/u' || u END AS root
  FROM copies),
activity AS (
  SELECT e, u, k, c, et, e * 2 + c AS arrival_seq,
    CASE WHEN e % 101 = 0 THEN '' ELSE 'e' || e END AS event_id, type,
    CASE WHEN e % 97 = 5 THEN 'not a time'
         WHEN e % 4 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
         WHEN e % 4 = 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
         WHEN e % 4 = 2 THEN strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%dT%H:%M:%S') || '+03:00'
         ELSE strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S') || '-05:00' END AS ts_wall,
    CASE WHEN e % 29 = 3 THEN ''
         ELSE strftime(ts + to_minutes(CAST(k % 13 + c * 30 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || 'Z' END AS recv_ts,
    CASE WHEN k % 17 = 0 THEN 0 WHEN k % 6 = 0 THEN CAST((k - 50) * 60 AS BIGINT) ELSE 0 END AS offset_sec,
    CASE WHEN c = 1 THEN 'validated' WHEN k % 10 = 0 THEN 'rejected'
         WHEN k % 10 = 1 THEN 'low_trust' ELSE 'validated' END AS trust,
    CASE type WHEN 'AGENT_REPORT' THEN 'agent' WHEN 'FILE_CHANGE' THEN 'fs' WHEN 'GIT_COMMIT' THEN 'git'
         WHEN 'NARRATION' THEN 'intent' WHEN 'CLIPBOARD' THEN 'intent' ELSE 'os' END AS kind,
    CASE WHEN k % 23 = 0 THEN '' ELSE 'adapter' END AS adapter,
    'host:' || (u % 10) AS identity,
    type IN ('FOCUS_SESSION', 'DEEP_WORK', 'LONG_RUN') AS session,
    root || '/code/p' || (k % 8) || '/src/f' || (e % 50) || '.py' AS raw_path,
    CASE WHEN k % 9 = 0 THEN 'ATL-' || e || ' wind map' WHEN k % 9 = 1 THEN 'Borealis overview'
         WHEN k % 9 = 2 THEN 'Atlas board 7' WHEN k % 9 = 3 THEN 'f' || (e % 50) || '.py - editor' ELSE '' END AS any_anchor,
    CASE WHEN k % 4 = 0 THEN 'Code.exe' WHEN k % 4 = 1 THEN 'QGIS.exe' ELSE 'term' END AS any_process,
    CASE WHEN k % 19 = 0 THEN NULL ELSE round(v, 2) END AS any_duration,
    CASE WHEN k % 7 = 0 THEN 'cobalt forecast notes' WHEN k % 7 = 1 THEN 'ok stuff'
         ELSE 'token = s3cr3t' || e || ' for the map' END AS any_note,
    root
  FROM typed),
"""

# The gate on the activity view: allowlist, clip typing, home prefixes and key=value secrets.
GATED = ACTIVITY + r"""
judged AS (
  SELECT *,
    CASE WHEN type = 'FILE_CHANGE' AND e % 41 <> 0 THEN raw_path
         WHEN type = 'GIT_COMMIT' THEN root || '/code/p' || (k % 8) END AS gated_path,
    CASE WHEN type = 'CLIPBOARD' THEN CASE k % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'credential' ELSE 'text' END END AS clip_kind
  FROM activity),
gated AS (
  SELECT *,
    CASE WHEN type IN ('FILE_CHANGE', 'GIT_COMMIT') AND gated_path IS NULL THEN 'missing_path'
         WHEN type IN ('FILE_CHANGE', 'GIT_COMMIT')
              AND NOT (starts_with(gated_path || '/', '/home/dev/code/') OR starts_with(gated_path || '/', '/home/u7/code/p3/'))
           THEN 'not_in_allowlist'
         WHEN clip_kind = 'credential' THEN 'clipboard_credential' END AS drop_reason,
    regexp_replace(raw_path, '(?i)/home/[^/]+', '~', 'g') AS clean_path
  FROM judged),
stored AS (
  SELECT e, u, k, c, arrival_seq, event_id, type, ts_wall, recv_ts, offset_sec, trust, identity, session,
    CASE WHEN session AND any_anchor <> '' THEN any_anchor END AS anchor,
    CASE WHEN session THEN any_process END AS process,
    CASE WHEN session AND k % 5 = 2 THEN clean_path END AS active_file,
    CASE WHEN session AND k % 5 = 0 THEN ['tab ' || (k % 3), 'mail'] ELSE [] END AS sat_titles,
    CASE WHEN session AND k % 5 = 0 THEN ['chrome.exe'] ELSE [] END AS sat_procs,
    CASE WHEN session THEN any_duration END AS duration,
    CASE WHEN type = 'DEEP_WORK' THEN 'DEEP_WORK' END AS mode,
    CASE WHEN session AND k % 6 = 1 THEN 'mapping' END AS intent_label,
    CASE WHEN type = 'LONG_RUN' AND k % 3 = 1 THEN 'python ' || clean_path END AS cmdline,
    CASE WHEN type = 'FILE_CHANGE' THEN clean_path END AS path,
    CASE WHEN type = 'GIT_COMMIT' THEN '~/code/p' || (k % 8)
         WHEN type = 'AGENT_REPORT' AND k % 3 = 0 THEN 'github.com/acme/Atlas' END AS repo,
    CASE WHEN type = 'GIT_COMMIT' THEN 'change ' || e END AS message,
    CASE WHEN type = 'GIT_COMMIT' AND k % 4 = 0 THEN 'agent' END AS actor,
    CASE WHEN (type = 'GIT_COMMIT' AND k % 2 = 0) OR (type = 'AGENT_REPORT' AND k % 4 = 0)
         THEN ['src/f' || (e % 50) || '.py', 'docs/readme.md'] ELSE [] END AS files,
    CASE WHEN type = 'NARRATION' THEN regexp_replace(any_note, 'token = [^ ]+', 'token = [REDACTED:kv_secret]') END AS note,
    CASE WHEN clip_kind = 'url' THEN 'atlas.example.com' END AS host, clip_kind,
    CASE WHEN type = 'AGENT_REPORT' THEN 'report ' || e END AS summary,
    CASE WHEN type = 'AGENT_REPORT' THEN 'helper' END AS tool
  FROM gated WHERE drop_reason IS NULL),
"""

_TIMELINE = r"""
instants AS (
  SELECT *,
    CASE WHEN regexp_matches(ts_wall, '^[0-9]{{4}}-') THEN epoch_us(CAST(CASE WHEN regexp_matches(ts_wall, '(Z|[+-][0-9][0-9]:[0-9][0-9])$') THEN ts_wall ELSE ts_wall || 'Z' END AS TIMESTAMPTZ)) - offset_sec * 1000000 END AS at_us,
    CASE WHEN regexp_matches(ts_wall, '^[0-9]{{4}}-') THEN replace(substr(ts_wall, 1, 10), '-', '')
         ELSE replace(substr(ts_wall, 1, 10), '-', '') END AS date_key
  FROM {source}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY CASE WHEN event_id = '' THEN 'row' || arrival_seq ELSE event_id END
    ORDER BY CASE trust WHEN 'validated' THEN 2 WHEN 'low_trust' THEN 1 ELSE 0 END DESC,
             recv_ts = '', recv_ts, arrival_seq) AS rn
  FROM instants WHERE trust <> 'rejected'),
timeline AS (SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1),
"""
TIMELINE = GATED + _TIMELINE.format(source="stored")
RAW_TIMELINE = ACTIVITY + _TIMELINE.format(source="activity")

ATTRIBUTED = TIMELINE + r"""
sig AS (
  SELECT *,
    list_filter(list_concat([anchor, intent_label], sat_titles, [message, note, host, summary, tool]), lambda x: x IS NOT NULL AND x <> '') AS titles,
    list_filter(list_concat([lower(process)], sat_procs), lambda x: x IS NOT NULL AND x <> '') AS procs,
    list_filter(list_concat([active_file, path, repo], CASE WHEN type IN ('GIT_COMMIT', 'AGENT_REPORT') THEN files ELSE [] END, [cmdline]),
                lambda x: x IS NOT NULL AND x <> '') AS paths
  FROM timeline),
blobs AS (
  SELECT *, array_to_string(titles, ' ') AS tj, lower(array_to_string(list_concat(titles, procs, paths), ' ')) AS blob,
    list_transform(paths, lambda x: lower(replace(x, '\', '/')) || '/') AS slashed, lower(coalesce(note, '')) AS low_note
  FROM sig),
scores AS (
  SELECT *,
    greatest(
      CASE WHEN len(list_filter(slashed, lambda x: starts_with(x, '~/code/p0/') OR starts_with(x, '~/code/p1/'))) > 0 THEN 0.95 ELSE 0 END,
      CASE WHEN regexp_matches(tj, '(?i)\bATL-[0-9]+\b') THEN 0.85 ELSE 0 END,
      CASE WHEN contains(blob, 'github.com/acme/atlas') THEN 0.82 ELSE 0 END,
      CASE WHEN contains(blob, 'atlas.example.com') THEN 0.80 ELSE 0 END,
      CASE WHEN regexp_matches(tj, '(?i).*atlas board.*') THEN 0.75 ELSE 0 END,
      CASE WHEN contains(low_note, 'atlas') OR contains(low_note, 'map') THEN 0.72 ELSE 0 END,
      CASE WHEN list_contains(procs, 'qgis.exe') THEN 0.70 ELSE 0 END,
      CASE (contains(blob, 'atlas')::INT + contains(blob, 'map')::INT) WHEN 0 THEN 0 WHEN 1 THEN 0.58 ELSE 0.66 END) AS s_atlas,
    greatest(
      CASE WHEN len(list_filter(slashed, lambda x: starts_with(x, '~/code/p2/'))) > 0 THEN 0.95 ELSE 0 END,
      CASE WHEN regexp_matches(tj, '(?i)\bBOR-[0-9]+\b') THEN 0.85 ELSE 0 END,
      CASE WHEN contains(blob, 'github.com/acme/borealis') THEN 0.82 ELSE 0 END,
      CASE WHEN contains(blob, 'borealis.example.com') THEN 0.80 ELSE 0 END,
      CASE WHEN regexp_matches(tj, '(?i)borealis') THEN 0.75 ELSE 0 END,
      CASE WHEN contains(low_note, 'forecast') OR contains(low_note, 'wind') THEN 0.72 ELSE 0 END,
      CASE WHEN list_contains(procs, 'code.exe') THEN 0.70 ELSE 0 END,
      CASE (contains(blob, 'forecast')::INT + contains(blob, 'wind')::INT) WHEN 0 THEN 0 WHEN 1 THEN 0.58 ELSE 0.66 END) AS s_borealis,
    greatest(
      CASE WHEN len(list_filter(slashed, lambda x: starts_with(x, '~/code/p3/') OR starts_with(x, '~/code/p4/'))) > 0 THEN 0.95 ELSE 0 END,
      CASE WHEN contains(low_note, 'cobalt') OR contains(low_note, 'map') THEN 0.72 ELSE 0 END,
      CASE WHEN list_contains(procs, 'code.exe') THEN 0.70 ELSE 0 END,
      CASE (contains(blob, 'cobalt')::INT + contains(blob, 'map')::INT) WHEN 0 THEN 0 WHEN 1 THEN 0.58 ELSE 0.66 END) AS s_cobalt
  FROM blobs),
tops AS (
  SELECT *, greatest(s_atlas, s_borealis, s_cobalt) AS top,
    list_filter(['atlas', 'borealis', 'cobalt'], lambda x, i: [s_atlas, s_borealis, s_cobalt][i] = greatest(s_atlas, s_borealis, s_cobalt)) AS best
  FROM scores),
attributed AS (
  SELECT *,
    CASE WHEN type NOT IN ('IDLE_START', 'IDLE_END') AND top >= 0.51 AND len(best) = 1 THEN best[1] END AS project_id,
    CASE WHEN type IN ('IDLE_START', 'IDLE_END') THEN 'unattributed'
         WHEN top >= 0.51 AND len(best) = 1 THEN
           CASE top WHEN 0.95 THEN 'signal_path' WHEN 0.85 THEN 'signal_jira' WHEN 0.82 THEN 'signal_git' WHEN 0.80 THEN 'signal_domain'
                    WHEN 0.75 THEN 'signal_pattern' WHEN 0.72 THEN 'signal_note' WHEN 0.70 THEN 'signal_app' ELSE 'signal_keyword' END
         ELSE 'needs_review' END AS method,
    CASE WHEN type NOT IN ('IDLE_START', 'IDLE_END') AND top >= 0.51 AND len(best) = 1 THEN top ELSE 0 END AS confidence,
    CASE WHEN length(ts_wall) >= 16 THEN substr(ts_wall, 12, 5) ELSE ts_wall END AS hhmm,
    CASE WHEN regexp_matches(date_key, '^[0-9]{8}$')
         THEN substr(date_key, 1, 4) || '-' || substr(date_key, 5, 2) || '-' || substr(date_key, 7, 2) ELSE date_key END AS date_label,
    coalesce(CAST(trunc(duration) AS BIGINT), 0) AS dur
  FROM tops),
"""

ARCHIVE = ATTRIBUTED + r"""
owned AS (SELECT * FROM attributed WHERE project_id IS NOT NULL),
event_lines AS (
  SELECT project_id, date_key, date_label, ts_wall, at_us, recv_ts, event_id,
    CASE WHEN session THEN 1 WHEN type = 'GIT_COMMIT' THEN 2 WHEN type = 'AGENT_REPORT' THEN 3 WHEN type = 'NARRATION' THEN 5 END AS section_no,
    0 AS o_class, 0 AS o_pos,
    CASE WHEN session THEN '- ' || hhmm || ' — ' || coalesce(anchor, process) || ' (' || dur || 's' || coalesce(', ' || mode, '') || ')'
           || coalesce(' — ' || intent_label, '') || CASE WHEN len(sat_titles) > 0 THEN ' — also: ' || array_to_string(sat_titles, ', ') ELSE '' END
         WHEN type = 'GIT_COMMIT' THEN '- ' || hhmm || ' — ' || message || coalesce(' [' || actor || ']', '')
         WHEN type = 'AGENT_REPORT' THEN '- ' || hhmm || ' — ' || identity || ': ' || summary
         WHEN type = 'NARRATION' THEN '- [' || hhmm || '] "' || note || '"' END AS text
  FROM owned),
mentions AS (
  SELECT project_id, date_key, date_label, ts_wall, at_us, recv_ts, event_id,
    CASE type WHEN 'FILE_CHANGE' THEN 0 WHEN 'GIT_COMMIT' THEN 1 ELSE 2 END AS o_class,
    unnest(CASE WHEN type = 'FILE_CHANGE' THEN [path] WHEN type IN ('GIT_COMMIT', 'AGENT_REPORT') THEN files ELSE [] END) AS f,
    generate_subscripts(CASE WHEN type = 'FILE_CHANGE' THEN [path] WHEN type IN ('GIT_COMMIT', 'AGENT_REPORT') THEN files ELSE [] END, 1) AS o_pos
  FROM owned),
named AS (SELECT *, regexp_extract(f, '[^/]+$') AS file FROM mentions),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY project_id, date_key, file
    ORDER BY o_class, ts_wall, at_us IS NULL, at_us, recv_ts, event_id, o_pos) AS rn
  FROM named WHERE file <> ''),
lines AS (
  SELECT project_id, date_key, date_label, section_no, o_class, ts_wall, at_us, recv_ts, event_id, o_pos, text
  FROM event_lines WHERE text IS NOT NULL
  UNION ALL
  SELECT project_id, date_key, date_label, 4, o_class, ts_wall, at_us, recv_ts, event_id, o_pos, '- ' || file FROM firsts WHERE rn = 1
  UNION ALL
  SELECT project_id, date_key, any_value(date_label), 6, 0, '', NULL, '', '', 0, '### Clipboard captures: ' || count(*)
  FROM owned WHERE type = 'CLIPBOARD' GROUP BY project_id, date_key),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY project_id, date_key
    ORDER BY section_no, o_class, ts_wall, at_us IS NULL, at_us, recv_ts, event_id, o_pos) AS line_no
  FROM lines),
"""


def q(prefix: str, select: str) -> str:
    """A full statement out of a CTE prefix and the final select."""
    body = select.strip()
    head = prefix.strip() if not body.upper().startswith("SELECT") else prefix.strip().rstrip(",")
    return "WITH " + head + "\n" + body
