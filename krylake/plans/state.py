"""Event sequences: windows, latest values, shapes kept by id."""

from pyspark.sql import functions as F

from krylake.operators import spatial
from krylake.operators import state as s
from krylake.plans.registry import query
from krylake.plans.tables import table


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("SELECT * FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::BIGINT AS rank FROM events) WHERE rank <= 80")
def trail_last_n(spark, sf_dir):
    return s.last_n(events(spark, sf_dir).select("user_id", "event_id", "ts", "value"), "user_id", ["ts", "event_id"], 80).drop("ts")


@query("SELECT event_id, round(avg(value) OVER w * count(*) OVER w, 2) AS total, min(value) OVER w AS low, max(value) OVER w AS high FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 79 PRECEDING AND CURRENT ROW)")
def sparkline(spark, sf_dir):
    out = s.sparkline(events(spark, sf_dir).select("event_id", "user_id", "value"), "user_id", "event_id", "value")
    return out.select("event_id", F.round(F.col("mean") * F.col("held"), 2).alias("total"), "low", "high")


@query("SELECT event_id, coalesce(value > lag(value) OVER (PARTITION BY user_id ORDER BY event_id) * (1.0 - 0.01::DOUBLE), false) AS stalled FROM events")
def stagnation_flag(spark, sf_dir):
    return s.stagnation(events(spark, sf_dir).select("event_id", "user_id", "value"), "user_id", "event_id", "value").select("event_id", "stalled")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_pending(spark, sf_dir):
    return s.latest(events(spark, sf_dir), "user_id", "event_id", "value")


@query("SELECT event_id // 100 AS batch, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def command_coalesce(spark, sf_dir):
    return s.coalesced(events(spark, sf_dir), F.floor(F.col("event_id") / 100).cast("long"), "event_type", "event_id", "value")


@query("""WITH u AS (SELECT user_id, arg_max(CASE WHEN event_id % 2 = 0 THEN event_type END, CASE WHEN event_id % 2 = 0 THEN event_id END) AS t, arg_max(value, event_id) AS v FROM events GROUP BY user_id)
SELECT s_suppkey AS id, coalesce(u.t, 'supplier') AS type, coalesce(u.v, s_acctbal) AS cx, s_acctbal AS cy, 1.0::DOUBLE AS w, coalesce(u.v, 2.0) AS h FROM supplier LEFT JOIN u ON user_id = s_suppkey""")
def shape_upsert(spark, sf_dir):
    """Suppliers as shapes, moved and reshaped by the newest event of the user with their number."""
    shapes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("type"), F.col("s_acctbal").alias("cx"), F.col("s_acctbal").alias("cy"), F.create_map(F.lit("w"), F.lit(1.0), F.lit("h"), F.lit(2.0)).alias("params"))
    even = F.when(F.col("event_id") % 2 == 0, F.col("event_id"))
    new = events(spark, sf_dir).groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_type", even).alias("type"), F.max_by("value", "event_id").alias("cx")).select("id", "type", "cx", F.lit(None).cast("double").alias("cy"), F.create_map(F.lit("h"), F.col("cx")).alias("params"))
    return spatial.upserted(shapes, new).select("id", "type", "cx", "cy", F.col("params")["w"].alias("w"), F.col("params")["h"].alias("h"))


@query("SELECT user_id AS id, 'gone' AS state FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey IN (SELECT user_id FROM events) THEN 'kept' ELSE 'new' END FROM supplier")
def shape_sync_diff(spark, sf_dir):
    """What a client has to drop, keep and add when its ids (users) meet the server's (suppliers)."""
    known, server = events(spark, sf_dir).select(F.col("user_id").alias("id")).distinct(), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    part = lambda d, o, how, name: d.join(o, "id", how).withColumn("state", F.lit(name))
    return part(known, server, "left_anti", "gone").unionByName(part(server, known, "left_semi", "kept")).unionByName(part(server, known, "left_anti", "new"))


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 5 AS slot FROM events")
def track_slot_rotation(spark, sf_dir):
    return s.rotation(events(spark, sf_dir).select("event_id", "user_id"), "user_id", "event_id", 5).select("event_id", "slot")


@query("SELECT user_id, max(event_id) - max(CASE WHEN event_type = 'purchase' THEN event_id END) AS stale FROM events GROUP BY user_id")
def staleness(spark, sf_dir):
    """How far a user's newest event is beyond their last purchase."""
    return events(spark, sf_dir).groupBy("user_id").agg((F.max("event_id") - F.max(F.when(F.col("event_type") == "purchase", F.col("event_id")))).alias("stale"))


@query("SELECT event_type, user_id, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events WHERE user_id BETWEEN 1 AND 40 AND json_extract_string(props, '$.k') IS NOT NULL")
def command_parse(spark, sf_dir):
    """JSON commands with nullable members, ids outside the bounds dropped."""
    return events(spark, sf_dir).filter(F.col("user_id").between(1, 40)).select("event_type", "user_id", F.from_json("props", "k long")["k"].alias("k")).filter("k IS NOT NULL")
