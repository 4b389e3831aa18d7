"""Extras over events: the batch form of the streaming aggregations."""

from pyspark.sql import DataFrame

from tessera.plans.catalogue import query
from tessera.sources.tables import Tables
from tessera.streaming import events


@query("SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def extra_tumbling(t: Tables) -> DataFrame:
    return events.tumbling(t.events)


@query("""
    WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS opens FROM events),
         s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM m)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, sid""")
def extra_sessions(t: Tables) -> DataFrame:
    return events.sessions(t.events)
