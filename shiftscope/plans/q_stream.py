"""Streaming queries over the events table (A14 upsert as a stream,
first sightings)."""

from __future__ import annotations

from ..session import table_path
from ..streaming import upsert as S
from .catalog import register

_STATE_SQL = """
WITH s AS (
  SELECT user_id AS external_id, struct_pack(ts := ts, event_id := event_id) AS seq, event_type = 'error' AS failed,
         event_type = 'purchase' AS promo, event_type = 'signup' AS feat, value, event_type FROM events
), g AS (
  SELECT external_id, arg_max(struct_pack(failed := failed, value := value, event_type := event_type), seq) AS l,
         max(CASE WHEN failed THEN seq END) AS lf, max(CASE WHEN NOT failed AND promo THEN seq END) AS lp,
         max(CASE WHEN NOT failed AND feat THEN seq END) AS lx, count(*) AS n
  FROM s GROUP BY external_id
)
SELECT external_id AS user_id, NOT l.failed AS is_active, CASE WHEN NOT l.failed THEN l.value END AS value,
       CASE WHEN NOT l.failed THEN l.event_type END AS event_type,
       (NOT l.failed AND lp IS NOT NULL AND (lf IS NULL OR lp > lf)) AS is_promoted,
       (NOT l.failed AND lx IS NOT NULL AND (lf IS NULL OR lx > lf)) AS is_featured,
       n - 1 AS repeats
FROM g"""


@register("event_state", _STATE_SQL)
def q_event_state(spark, sf_dir):
    """Posting-state upsert run as a stream over the events files; the
    result is read back from the stream's changelog."""
    run = S.new_run_dir(spark, "event_state")
    log = S.run_state_stream(spark, table_path(sf_dir, "events"), run)
    return S.current_state(spark, log)


@register("event_state_batch", _STATE_SQL)
def q_event_state_batch(spark, sf_dir):
    """The same state computed as one batch aggregation."""
    from ..session import read_table
    ev = read_table(spark, sf_dir, "events")
    return S.finish_state(S.state_aggregate(S.event_sightings(ev)))


@register("first_seen_events", """
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def q_first_seen_events(spark, sf_dir):
    """First sighting of each (user, event type), run as a stream."""
    run = S.new_run_dir(spark, "first_seen")
    return S.first_seen(spark, S.run_first_seen(spark, table_path(sf_dir, "events"), run))


@register("first_seen_window", """
SELECT window_start, event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY window_start, user_id, event_type ORDER BY ts, event_id) AS rn FROM (
    SELECT *, time_bucket(INTERVAL 30 DAY, ts, TIMESTAMP '1970-01-01') AS window_start FROM events WHERE ts IS NOT NULL)) WHERE rn = 1""")
def q_first_seen_window(spark, sf_dir):
    """First sighting of each (user, event type) per 30 days, run as a stream
    with a watermark."""
    run = S.new_run_dir(spark, "first_window")
    return S.first_seen_window(spark, S.run_first_in_window(spark, table_path(sf_dir, "events"), run))
