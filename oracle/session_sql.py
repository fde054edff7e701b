"""Answers for session, window, packing and call-log queries."""

from .base import RAW_TIMELINE, q

EV = r"""
ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INTEGER) AS k, 'host' || (user_id % 10) AS host FROM events),
"""
CALLS = EV + r"""
log AS (SELECT event_id AS call_id, strftime(ts, '%Y-%m-%d') AS run, host AS account, ts, event_type AS label, 'm' || (k % 3) AS model, user_id AS p,
  CASE WHEN k % 8 = 0 THEN 0 ELSE k END AS c, CASE WHEN k % 4 = 0 THEN 0 ELSE user_id + k END AS t, round(value, 2) AS latency, k % 10 = 0 AS fb,
  CASE k % 12 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'no_key' WHEN 2 THEN 'auth' WHEN 3 THEN 'config' WHEN 4 THEN 'unreachable' WHEN 5 THEN 'failed' END AS verdict FROM ev),
"""


CHURN = EV + r"""
p AS (SELECT *, 'p' || (user_id % 40) AS path FROM ev),
lists AS (SELECT path, list(event_id ORDER BY ts, event_id) AS ids, list(epoch_us(ts) ORDER BY ts, event_id) AS us FROM p GROUP BY path),
kept AS (SELECT path, list_reduce(list_transform(us, lambda x, i: [i]),
  lambda acc, x: CASE WHEN us[x[1]] - us[acc[-1]] >= 18000000000 THEN list_append(acc, x[1]) ELSE acc END) AS keep, ids, us FROM lists),
"""
ACTORS = EV + r"""
raw AS (SELECT event_id, host, ts, 'src/f' || (user_id % 20) || '.py' AS path, CASE k % 5 WHEN 0 THEN 'Copilot' WHEN 1 THEN 'Ana B' ELSE '' END AS author, k % 2 = 0 AS human
  FROM ev WHERE k % 9 <> 0),
lists AS (SELECT host, path, list(event_id ORDER BY ts, event_id) AS ids, list(epoch_us(ts) ORDER BY ts, event_id) AS us FROM raw GROUP BY host, path),
kept AS (SELECT unnest(list_transform(list_reduce(list_transform(us, lambda x, i: [i]),
  lambda acc, x: CASE WHEN us[x[1]] - us[acc[-1]] >= 10800000000 THEN list_append(acc, x[1]) ELSE acc END), lambda j: ids[j])) AS event_id FROM lists),
em AS (SELECT r.* FROM raw r JOIN kept USING (event_id)),
b AS (SELECT a.event_id, any_value(a.host) AS host, any_value(a.path) AS path, any_value(a.author) AS author, any_value(a.human) AS human, count(*) AS burst
  FROM em a JOIN em o ON a.host = o.host AND o.ts <= a.ts AND epoch_us(a.ts) - epoch_us(o.ts) <= 7200000000 AND (o.ts < a.ts OR o.event_id <= a.event_id) GROUP BY a.event_id),
"""

PACK = r"""
d AS (SELECT o_orderpriority AS project_id, strftime(o_orderdate, '%Y%m%d') AS date_key, CAST(CAST(o_orderdate AS DATE) AS DATE) AS day, count(*) * 137 + 40 AS tokens
  FROM orders GROUP BY o_orderpriority, strftime(o_orderdate, '%Y%m%d'), CAST(o_orderdate AS DATE)),
l AS (SELECT project_id, list(struct_pack(k := date_key, d := date_diff('day', DATE '1970-01-01', day), t := tokens, w := strftime(day, '%G-W%V')) ORDER BY date_key) AS days FROM d GROUP BY project_id),
f AS (SELECT project_id, days, list_reduce(list_transform(days, lambda x: struct_pack(u := [1], first := x.d, used := x.t, w := x.w, t := x.t, d := x.d)),
  lambda acc, x: CASE WHEN {cut} THEN struct_pack(u := list_append(acc.u, acc.u[-1] + 1), first := x.d, used := x.t, w := x.w, t := x.t, d := x.d)
    ELSE struct_pack(u := list_append(acc.u, acc.u[-1]), first := acc.first, used := acc.used + x.t, w := acc.w, t := x.t, d := x.d) END) AS r FROM l)
SELECT project_id, unnest(list_transform(days, lambda x: x.k)) AS date_key, unnest(list_transform(days, lambda x: x.t)) AS tokens,
  CAST(unnest(r.u) AS BIGINT) AS unit_no FROM f"""

# The focus rules sample by sample: each step carries what a host's open session holds, and says what it closed.
_FOCUS = r"""
WITH RECURSIVE t AS (
  SELECT 'host' || (user_id % 10) AS host, epoch_us(ts) AS us, event_type || '.py - editor' AS title, CASE WHEN value > 60 THEN value * 20 ELSE 0 END AS quiet,
    coalesce(CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT), 0) AS k,
    row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS n FROM events),
walk AS (
  SELECT host, 0::BIGINT AS n, NULL::BIGINT AS us, NULL::VARCHAR AS anchor, NULL::BIGINT AS begun, NULL::VARCHAR AS other, NULL::BIGINT AS since,
    NULL::BIGINT AS away, 0::BIGINT AS keys, 0::BIGINT AS mouse, 0::BIGINT AS saves, []::VARCHAR[] AS aside,
    NULL::STRUCT(anchor VARCHAR, begun BIGINT, until BIGINT, keys BIGINT, mouse BIGINT, saves BIGINT, aside VARCHAR[]) AS done,
    NULL::STRUCT(kind VARCHAR, moment BIGINT, seconds DOUBLE) AS rest FROM (SELECT DISTINCT host FROM t)
  UNION ALL
  SELECT host, n, us, CASE WHEN goes THEN NULL WHEN takes THEN title WHEN idle THEN anchor ELSE coalesce(anchor, title) END,
    CASE WHEN goes THEN NULL WHEN idle THEN begun WHEN takes OR cuts OR anchor IS NULL THEN us ELSE begun END,
    CASE WHEN goes OR takes THEN NULL WHEN idle THEN other WHEN anchor IS NULL THEN other WHEN title = anchor THEN NULL ELSE title END,
    CASE WHEN idle THEN since WHEN anchor IS NOT NULL AND title <> anchor AND title IS DISTINCT FROM other THEN us ELSE since END,
    CASE WHEN goes THEN quit WHEN idle THEN away END,
    CASE WHEN ends THEN 0 ELSE keys END, CASE WHEN ends THEN 0 ELSE mouse END, CASE WHEN ends THEN 0 ELSE saves END, CASE WHEN ends THEN [] ELSE seen END,
    CASE WHEN ends AND anchor IS NOT NULL THEN {'anchor': anchor, 'begun': begun, 'until': CASE WHEN goes THEN quit ELSE us END,
      'keys': keys, 'mouse': mouse, 'saves': saves, 'aside': seen} END,
    CASE WHEN goes THEN {'kind': 'IDLE_START', 'moment': us - CAST(round(quiet * 1000000) AS BIGINT), 'seconds': CAST(quiet AS DOUBLE)}
         WHEN NOT idle AND away IS NOT NULL THEN {'kind': 'IDLE_END', 'moment': us, 'seconds': (us - away) / 1e6} END
  FROM (
    SELECT *, goes OR takes OR cuts AS ends FROM (
      SELECT w.host, t.n, t.us, t.title, t.quiet, w.anchor, w.begun, w.other, w.since, w.away, t.quiet >= 1500 AS idle,
        t.quiet >= 1500 AND w.away IS NULL AS goes, t.us - CAST(trunc(t.quiet * 1000000) AS BIGINT) AS quit,
        w.keys + greatest(t.k, 0) AS keys, w.mouse + greatest(t.k % 7, 0) AS mouse, w.saves + greatest(t.k % 2, 0) AS saves,
        coalesce(t.quiet < 1500 AND t.title <> w.anchor AND t.title = w.other AND t.us - w.since >= 1800000000, false) AS takes,
        coalesce(t.quiet < 1500 AND t.us - w.begun >= 14400000000
          AND NOT coalesce(t.title <> w.anchor AND t.title = w.other AND t.us - w.since >= 1800000000, false), false) AS cuts,
        CASE WHEN t.quiet < 1500 AND w.anchor IS NOT NULL AND t.title <> w.anchor AND t.title IS DISTINCT FROM w.other
          THEN list_sort(list_distinct(list_append(w.aside, t.title))) ELSE w.aside END AS seen
      FROM walk w JOIN t ON t.host = w.host AND t.n = w.n + 1))),
closed AS (
  SELECT host, done, CASE WHEN rest.kind = 'IDLE_START' THEN rest.moment END AS quiet_at FROM walk WHERE done IS NOT NULL
  UNION ALL SELECT host, {'anchor': anchor, 'begun': begun, 'until': us, 'keys': keys, 'mouse': mouse, 'saves': saves, 'aside': aside}, NULL
  FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC) AS back FROM walk) WHERE back = 1 AND anchor IS NOT NULL),
spans AS (SELECT host, quiet_at, done.*, greatest((done.until - done.begun) / 1e6, 0) AS d FROM closed),
modes AS (SELECT *, CASE WHEN d > 0 AND keys / d >= KPS THEN 'PRODUCING' WHEN saves > 0 OR (mouse >= MOUSE AND d >= DEEP) THEN 'DEEP_WORK' ELSE 'READING' END AS mode
  FROM spans WHERE d > 0 OR keys + mouse + saves > 0 OR len(aside) > 0)
SELECT 'host:' || host AS host, CASE WHEN mode = 'DEEP_WORK' THEN mode ELSE 'FOCUS_SESSION' END AS type,
  strftime(make_timestamp(begun), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS ts_wall, anchor, mode, round_even(d, 1) AS duration_sec,
  CASE WHEN quiet_at IS NOT NULL THEN replace(strftime(make_timestamp(quiet_at), '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '') ELSE strftime(make_timestamp(until), '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00' AS ended,
  keys, array_to_string(aside, ',') AS satellites, replace(anchor, ' - editor', '') AS intent, -1::BIGINT AS seconds FROM modes
UNION ALL SELECT 'host:' || host, rest.kind, CASE rest.kind WHEN 'IDLE_END' THEN strftime(make_timestamp(rest.moment), '%Y-%m-%dT%H:%M:%S.%f')
    ELSE replace(strftime(make_timestamp(rest.moment), '%Y-%m-%dT%H:%M:%S.%f'), '.000000', '') END || '+00:00',
  NULL, NULL, NULL, NULL, -1, NULL, NULL, CAST(round_even(rest.seconds, 0) AS BIGINT) FROM walk WHERE rest IS NOT NULL
""".replace("KPS", "0.3").replace("MOUSE", "30").replace("DEEP)", "300)")

SQL = {
    "focus_sessions": _FOCUS,
    "churn_coalesce": q(CHURN, """
out AS (SELECT path, unnest(list_transform(keep, lambda j: ids[j])) AS event_id FROM kept)
SELECT o.path, o.event_id, e.ts FROM out o JOIN ev e USING (event_id)"""),
    "burst_size": q(EV, """
SELECT a.event_id, any_value(a.host) AS host, count(*) AS burst FROM ev a JOIN ev o
  ON a.host = o.host AND o.ts <= a.ts AND epoch_us(a.ts) - epoch_us(o.ts) <= 3600000000 AND (o.ts < a.ts OR o.event_id <= a.event_id) GROUP BY a.event_id"""),
    "file_actors": q(ACTORS, """
SELECT event_id AS arrival_seq, host, path, burst,
  CASE WHEN author = 'Copilot' THEN 'agent' WHEN author = 'Ana B' OR human THEN 'human' ELSE 'agent' END AS actor,
  CASE WHEN author <> '' THEN 'git_author' WHEN human THEN 'input' WHEN burst >= 3 THEN 'burst' ELSE 'no_human' END AS method,
  CAST(CASE WHEN author <> '' THEN 0.95 WHEN human THEN 0.7 WHEN burst >= 3 THEN 0.8 ELSE 0.5 END AS DOUBLE) AS confidence FROM b"""),
    "clipboard_dedup": q(EV, """
c AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM ev WHERE k % 10 <> 0)
SELECT user_id, event_id, event_type AS text FROM c WHERE prev IS DISTINCT FROM event_type"""),
    "long_runs": q(EV, """
u AS (SELECT host, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS tick, user_id, max(value) AS cpu, max(k) AS k FROM ev GROUP BY ALL),
t AS (SELECT host, tick, min(user_id) % 3 = 0 AS human, dense_rank() OVER (PARTITION BY host ORDER BY tick) AS n FROM u GROUP BY host, tick),
b AS (SELECT u.*, t.n FROM u JOIN t ON u.host = t.host AND u.tick = t.tick WHERE NOT human AND cpu >= 20),
i AS (SELECT *, n - row_number() OVER (PARTITION BY host, user_id ORDER BY tick) AS isl FROM b)
SELECT host, user_id AS pid, min(tick) AS started, max(tick) AS ended, round(max(cpu), 1) AS cpu_peak, 'job' || user_id AS process,
  'run ' || max_by(k, tick) AS cmdline, CAST(date_diff('second', min(tick), max(tick)) AS DOUBLE) AS duration_sec
FROM i GROUP BY host, user_id, isl HAVING date_diff('second', min(tick), max(tick)) >= 21600"""),
    "session_gap": q(EV, """
g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 3600000000 THEN 0 ELSE 1 END AS s FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM g)
SELECT user_id, session_no, min(ts) AS started, max(ts) AS ended, count(*) AS n_events FROM n GROUP BY ALL"""),
    "idle_intervals": q(RAW_TIMELINE, """
i AS (SELECT identity AS host, type, at_us, lag(type) OVER w AS pt, lag(at_us) OVER w AS pa FROM timeline
  WHERE type IN ('IDLE_START', 'IDLE_END') AND event_id <> '' AND at_us IS NOT NULL WINDOW w AS (PARTITION BY identity ORDER BY at_us, event_id))
SELECT host, make_timestamp(pa) AS idle_from, make_timestamp(at_us) AS idle_to, (at_us - pa) / 1e6 AS away_sec FROM i WHERE type = 'IDLE_END' AND pt = 'IDLE_START'"""),
    "privacy_pauses": q(EV, """
SELECT host, count(*) AS n_kept, max(event_id) AS last_event FROM ev a WHERE NOT EXISTS (SELECT 1 FROM ev p WHERE p.event_type = 'signup' AND p.host = a.host
  AND a.ts BETWEEN p.ts AND p.ts + INTERVAL 2 HOUR) GROUP BY host"""),
    "relabelled": q(EV, """
SELECT e.event_id, max_by('note ' || n.event_id, n.ts) AS label FROM ev e JOIN ev n ON n.event_type = 'signup' AND n.host = e.host
  AND e.ts >= n.ts - INTERVAL 3 HOUR AND e.ts < n.ts GROUP BY e.event_id"""),
    "spans_of_all_lengths": q(EV, """
m AS (SELECT *, [1, 90, 7200, 400000, 315360000][k % 5 + 1] AS len FROM ev WHERE event_type = 'signup'),
kept AS (SELECT event_id, host, ts FROM ev a WHERE NOT EXISTS (SELECT 1 FROM m WHERE k % 5 < 3 AND m.host = a.host AND a.ts BETWEEN m.ts AND m.ts + to_seconds(len))),
lab AS (SELECT e.event_id, max_by('note ' || n.event_id, {'a': n.ts, 'b': 'note ' || n.event_id}) AS label FROM kept e JOIN m n ON n.k % 5 >= 3 AND n.user_id % 3 = 0 AND n.host = e.host
  AND e.ts >= n.ts - to_seconds(n.len) AND e.ts < n.ts GROUP BY e.event_id),
c AS (SELECT ev.host, count(kept.event_id) AS n_kept, count(*) - count(kept.event_id) AS n_suppressed FROM ev LEFT JOIN kept USING (event_id) GROUP BY ev.host)
SELECT host, coalesce(label, '') AS label, count(*) AS n_events, any_value(n_kept) AS n_kept, any_value(n_suppressed) AS n_suppressed FROM kept LEFT JOIN lab USING (event_id) JOIN c USING (host) GROUP BY ALL"""),
    "liveness": q(EV, """
b AS (SELECT user_id AS source, max(ts) AS heartbeat, max_by(k, ts) AS k FROM ev GROUP BY user_id)
SELECT source, CASE WHEN k % 7 = 0 OR TIMESTAMP '2024-01-31 00:00:00' - heartbeat > INTERVAL 6 HOUR THEN 'off' WHEN k % 4 = 0 THEN 'paused' ELSE 'live' END AS status, heartbeat FROM b"""),
    "pack_days_adaptive": "WITH " + PACK.format(cut="acc.used + x.t > 1500 OR x.d - acc.first + 1 > 7"),
    "pack_days_week": "WITH " + PACK.format(cut="x.w <> acc.w OR x.d - acc.first + 1 > 5"),
    "order_rollup": """
WITH j AS (SELECT o_orderpriority AS project_id, l_shipdate AS d, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT project_id, 'week' AS granularity, strftime(d, '%G-W%V') AS period_key, count(*) AS n_lines, CAST(sum(cents) AS BIGINT) AS cents FROM j GROUP BY ALL
UNION ALL SELECT project_id, 'month', strftime(d, '%Y-%m'), count(*), CAST(sum(cents) AS BIGINT) FROM j GROUP BY ALL""",
    "call_metrics": q(CALLS, """
SELECT label, model, count(*) AS calls, count(*) FILTER (WHERE verdict IS NULL) AS ok, count(*) FILTER (WHERE verdict IS NOT NULL) AS degraded,
  count(*) FILTER (WHERE fb) AS fallbacks, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens,
  CAST(sum(CASE WHEN t <> 0 THEN t ELSE p + c END) AS BIGINT) AS total_tokens, round(sum(latency), 2) AS latency_sec, CAST(grouping(label, model) AS INTEGER) AS level
FROM log GROUP BY ROLLUP (label, model)"""),
    "rate_window": q(CALLS, """
w AS (SELECT a.call_id, any_value(a.account) AS account, count(*) AS in_window FROM log a JOIN log o
  ON a.account = o.account AND o.ts <= a.ts AND epoch_us(a.ts) - epoch_us(o.ts) < 7200000000 AND (o.ts < a.ts OR o.call_id <= a.call_id) GROUP BY a.call_id),
n AS (SELECT call_id, (epoch_us(ts) - epoch_us(lag(ts, 3) OVER (PARTITION BY account ORDER BY ts, call_id))) / 1e6 AS age FROM log)
SELECT w.call_id, w.account, w.in_window, round(CASE WHEN age < 7200 THEN 7200 - age ELSE 0 END, 3) AS wait_sec FROM w JOIN n USING (call_id)"""),
    "breaker_misses": q(CALLS, """
f AS (SELECT run, model, min(ts) AS t0 FROM log WHERE verdict = 'rate_limited' GROUP BY run, model)
SELECT l.run, l.model, count(*) AS n_calls, min(call_id) AS first_call FROM log l JOIN f ON l.run = f.run AND l.model = f.model WHERE l.ts > f.t0 GROUP BY l.run, l.model"""),
    "error_classes": q(CALLS, "SELECT verdict, count(*) AS n_calls FROM log WHERE verdict IS NOT NULL GROUP BY verdict"),
    "run_exit_codes": q(CALLS, """
r AS (SELECT run || '/' || account || '/' || model AS run, min(CASE WHEN verdict IS NULL THEN 0 WHEN verdict = 'no_key' THEN 1 WHEN verdict = 'rate_limited' THEN 3 ELSE 2 END) AS r FROM log GROUP BY ALL)
SELECT run, CAST([0, 3, 1, 2][r + 1] AS INTEGER) AS exit_code FROM r"""),
}
