"""The stream's windows over the whole events table, as a batch."""

from __future__ import annotations

from ..sources import tables as S
from ..streaming import ingest
from .registry import query


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS window_start, event_type, count(*) AS n, max(value) AS max_value FROM events GROUP BY ALL")
def event_windows(spark, d):
    return ingest.tumbling(S.table(spark, d, "events"))


@query(
    "event_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
)
def event_sessions(spark, d):
    return ingest.sessions(S.table(spark, d, "events"))
