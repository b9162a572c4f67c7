"""Streams replayed from the table events until their end; SQL gives what a batch over the same rows gives."""

import uuid

from pyspark.sql import functions as F

from krylake.functions import fields as f
from krylake.plans.registry import query
from krylake.plans.tables import shared_dir, table
from krylake.streaming import assimilation as a
from krylake.streaming import late
from krylake.streaming.replay import drained, replay, resumed


DAYS = "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2"


@query("SELECT user_id, least(count(*), 80) AS n, arg_max(event_id, ts) AS newest, round(avg(value) FILTER (r <= 80), 4) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) GROUP BY user_id")
def stream_trails(spark, sf_dir):
    out = drained(a.trails(replay(spark, sf_dir, "events"), "user_id"), "update")
    return a.last_of(out, "user_id", "n", "newest", "mean").withColumn("mean", F.round("mean", 4))


@query("SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY user_id")
def stream_latest_wins(spark, sf_dir):
    return a.latest_wins(replay(spark, sf_dir, "events"), "user_id")


@query("""WITH c AS (SELECT user_id, max(ts) AS at, max(ts) FILTER (event_type = 'signup') AS cleared FROM events GROUP BY user_id)
SELECT c.user_id AS user_id, count(e.ts) AS active FROM c LEFT JOIN events e ON e.user_id = c.user_id AND e.event_type = 'error' AND e.ts > coalesce(c.cleared, TIMESTAMP '1970-01-01') AND e.ts > c.at - INTERVAL 5 DAY GROUP BY c.user_id""")
def stream_incident_state(spark, sf_dir):
    out = drained(a.active_incidents(replay(spark, sf_dir, "events"), "user_id", "error", "signup", 5 * 86400), "update")
    return a.last_of(out, "user_id", "active")


@query("""WITH c AS (SELECT user_id, event_id, event_type, (json_extract_string(props, '$.k'))::DOUBLE AS v FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL), r AS (SELECT user_id, max(CASE WHEN event_type = 'signup' THEN event_id END) AS removed FROM c GROUP BY user_id),
l AS (SELECT c.* FROM c JOIN r USING (user_id) WHERE event_type <> 'signup' AND event_id > coalesce(removed, -1))
SELECT user_id, least(greatest(arg_max(v, event_id) / 4.0, 1.0), 30.0) AS k, least(greatest(count(*) * 20, 60), 500) AS n_panels FROM l GROUP BY user_id""")
def stream_settings(spark, sf_dir):
    """JSON commands as a stream, folded into each shape's settings: `signup` removes it, later commands add it again, the last counts, numbers are clamped."""
    e = replay(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("action"), F.from_json("props", "k double")["k"].alias("value")).filter("value IS NOT NULL")
    out = a.last_of(drained(a.settings(e, "user_id", "signup"), "update"), "user_id", "alive", "value", "n")
    k, panels = f.clamped_settings(F.col("value") / 4.0, F.col("n") * a.PANELS_EACH)
    return out.filter("alive").select("user_id", k.alias("k"), panels.cast("long").alias("n_panels"))


@query(DAYS)
def stream_tumbling(spark, sf_dir):
    """Extension: daily counts under a watermark; the day that is still open at the end isn't given."""
    return shown(drained(a.windowed(replay(spark, sf_dir, "events"), "1 day", "1 hour")))


def shown(windows):
    return windows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH w AS (SELECT time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR * k AS start, event_type, value FROM events, (SELECT unnest(range(4)) AS k)) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w WHERE start + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2")
def stream_sliding(spark, sf_dir):
    """Extension: counts of two days, every twelve hours."""
    return shown(drained(a.windowed(replay(spark, sf_dir, "events"), "2 days", "1 hour", "12 hours")))


@query(DAYS)
def stream_resumed(spark, sf_dir):
    """The same, stopped after two slices before their progress was recorded, and gone on with from the checkpoint: no row is lost, none counts twice."""
    windows = a.windowed(replay(spark, sf_dir, "events"), "1 day", "1 hour")
    out = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    resumed(windows, out, batches=2)
    resumed(windows, out)
    return shown(spark.read.parquet(out))


LATE = "CASE WHEN event_id % 17 = 0 THEN INTERVAL 4 DAY WHEN event_id % 5 = 0 THEN INTERVAL 6 HOUR ELSE INTERVAL 0 DAY END"


@query(f"""WITH e AS (SELECT *, floor(date_diff('hour', TIMESTAMP '2024-01-01', time_bucket(INTERVAL 1 HOUR, ts + {LATE})) / 72.0)::BIGINT AS slice FROM events),
m AS (SELECT slice, max(max(ts)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY AS mark FROM e GROUP BY slice)
SELECT event_type, count(*) FILTER (mark IS NULL OR ts >= mark) AS in_time, count(*) FILTER (ts < mark) AS late, round(coalesce(sum(value) FILTER (ts < mark), 0), 4) AS lost FROM e JOIN m USING (slice) GROUP BY event_type""")
def stream_late_rows(spark, sf_dir):
    """Extension: rows that arrive up to four days after their time, in slices of three days by arrival; those behind the watermark (a day behind the newest of earlier slices) are kept apart and counted."""
    rows = table(spark, sf_dir, "events")
    lag = F.when(F.col("event_id") % 17 == 0, F.expr("INTERVAL 4 DAYS")).when(F.col("event_id") % 5 == 0, F.expr("INTERVAL 6 HOURS")).otherwise(F.expr("INTERVAL 0 DAYS"))
    arrives = F.col("ts") + lag
    slices = late.calendar(rows.select(arrives.alias("at")), "at", "2024-01-01", 72)
    out = late.split(replay(spark, sf_dir, "events", arrives=late.slice_of(arrives, "2024-01-01", 72), bounds=slices), "ts", 86400)
    behind = F.col("late")
    return out.groupBy("event_type").agg(F.count(F.when(~behind, 1)).alias("in_time"), F.count(F.when(behind, 1)).alias("late"), F.round(F.coalesce(F.sum(F.when(behind, F.col("value"))), F.lit(0.0)), 4).alias("lost"))
