"""All answers."""

from . import core_sql, flow_sql, session_sql, store_sql, text_sql

SQL = {**core_sql.SQL, **text_sql.SQL, **session_sql.SQL, **flow_sql.SQL, **store_sql.SQL}
#: A feed gives the rows of the batch form.
SQL |= {"stream_focus": SQL["focus_sessions"], "stream_long_runs": SQL["long_runs"], "stream_days": SQL["stream_timeline"]}
