"""Answers for logs, stores, journal documents and schedules."""

from .base import GATED, q
from .session_sql import EV
from .session_sql import SQL as SESSIONS

_DOCS = "WITH o AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)"

SQL = {
    "row_log": q(EV, """
x AS (SELECT * FROM ev)
SELECT 'e' || event_id AS event_id, 'n' || k AS note, event_type AS mood FROM x WHERE k % 13 <> 0 AND k % 17 <> 0
UNION ALL SELECT CAST(event_id AS VARCHAR), 'corrupt', '' FROM x WHERE k % 13 = 0"""),
    "stored_log": q(GATED, """
d AS (SELECT CASE WHEN replace(substr(ts_wall, 1, 10), '-', '') = '' THEN '00000000' ELSE replace(substr(ts_wall, 1, 10), '-', '') END AS name FROM stored)
SELECT name, count(*) AS n FROM d GROUP BY name UNION ALL SELECT '(dropped)', count(*) FROM gated WHERE drop_reason IS NOT NULL"""),
    "stream_gate": q(GATED, """
d AS (SELECT type FROM stored)
SELECT type, count(*) AS n FROM d GROUP BY type UNION ALL SELECT '(rows)', count(*) FROM gated UNION ALL SELECT '(dropped)', count(*) FROM gated WHERE drop_reason IS NOT NULL"""),
    "stream_churn": SESSIONS["churn_coalesce"],
    "daily_runs": """
WITH d AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS run_date, o_orderpriority AS project_id, count(*) AS n FROM orders GROUP BY ALL)
SELECT run_date, project_id, 'run ' || CASE WHEN run_date >= '1995-01-01' THEN 2 ELSE 1 END || ': ' || n AS paragraph FROM d
UNION ALL SELECT 'state', project_id, max(run_date) FROM d WHERE run_date >= '1995-01-01' GROUP BY project_id""",
    "dated_sections": _DOCS + "SELECT o_custkey, day AS label, CAST(o_orderkey AS VARCHAR) AS about FROM o",
    "batched_replies": _DOCS + """
SELECT o_custkey, substr(day, 1, 7) || '-01' AS label, 'about ' || max(o_orderkey) AS body FROM o GROUP BY o_custkey, substr(day, 1, 7)""",
    "daily_log": _DOCS + """, s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS section_no FROM o)
SELECT o_custkey, section_no, day AS date, o_orderpriority AS project, 'order ' || o_orderkey AS paragraph FROM s
UNION ALL SELECT o_custkey, section_no, day, o_orderstatus, 'mid' FROM s""",
    "due_runs": """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN isodow(o_orderdate) = 1 WHEN 1 THEN isodow(o_orderdate) = 2 WHEN 2 THEN isodow(o_orderdate) = 5 WHEN 3 THEN isodow(o_orderdate) = 7 ELSE true END AS project_due,
  o_orderkey % 5 IN (0, 2) AND o_orderkey % 3 <> 0 AS run_due FROM orders""",
    "exec_lines": """
WITH t AS (SELECT o_orderpriority AS project_id, count(*) AS n FROM orders GROUP BY ALL)
SELECT project_id, 0::BIGINT AS pos, '## ' || project_id AS text FROM t
UNION ALL SELECT project_id, 1, CASE WHEN project_id <> '5-LOW' THEN n || ' orders' ELSE '(no daily summary produced)' END FROM t
UNION ALL SELECT project_id, 2, '' FROM t""",
    "sent_rows": q(GATED, """
d AS (SELECT type, arrival_seq FROM stored)
SELECT 'taken' AS route, type, count(*) AS n FROM d WHERE arrival_seq % 5 <> 0 GROUP BY type UNION ALL SELECT 'held', '', count(*) FROM d WHERE arrival_seq % 5 = 0"""),
}
