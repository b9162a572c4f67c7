"""Readings, runs and commands over events, customer and lineitem."""

import math

from pyspark.sql import functions as F

from krylake.functions import fields as f
from krylake.operators.state import thinned
from krylake.plans.fields import PRESSURE, TEMPERATURE, XY, sensors
from krylake.plans.registry import query
from krylake.plans.tables import table
from krylake.streaming.replay import drained, replay


@query(f"{XY}, t AS (SELECT unnest(range(6))::DOUBLE AS t), v AS (SELECT 'temperature' AS field, t, {TEMPERATURE.format(t='t')} AS v FROM s, t UNION ALL SELECT 'pressure', t, {PRESSURE.format(t='t')} FROM s, t) SELECT field, t, round(min(v), 6) AS low, round(max(v), 6) AS high, round(stddev_pop(v), 6) AS spread, round(max(v) - min(v), 6) AS span, CASE field WHEN 'temperature' THEN '°C' ELSE 'hPa' END AS unit FROM v GROUP BY field, t")
def reading_statistics(spark, sf_dir):
    """Extremes and spread of the readings of each step, with the field's unit."""
    s = sensors(spark, sf_dir).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("t", F.col("t").cast("double"))
    each = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(f.FIELD_RANGES[n][0]).alias("unit"), f.sensor_field(n, F.col("x"), F.col("y"), F.col("t")).alias("v")) for n in ("temperature", "pressure")])
    r = s.select("t", F.inline(each)).groupBy("field", "t", "unit").agg(F.round(F.min("v"), 6).alias("low"), F.round(F.max("v"), 6).alias("high"), F.round(F.stddev_pop("v"), 6).alias("spread"), F.round(F.max("v") - F.min("v"), 6).alias("span"))
    return r


@query("SELECT user_id, min(value) AS best, count(*) AS runs FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r > 1 GROUP BY user_id")
def best_run(spark, sf_dir):
    """The least of a user's values after the first, which warms up; the first is found by an aggregate, so no user is sorted."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("first"))
    return e.join(first, "user_id").filter("event_id > first").groupBy("user_id").agg(F.min("value").alias("best"), F.count("*").alias("runs"))


@query("SELECT l_linenumber AS size, round(avg(abs(l_extendedprice - l_quantity * p_retailprice) / l_extendedprice), 6) AS mean_residual, round(max(abs(l_extendedprice - l_quantity * p_retailprice) / l_extendedprice), 6) AS max_residual FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_linenumber")
def residual_by_size(spark, sf_dir):
    """Mean and largest relative residual of a model over sizes."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    r = F.abs(F.col("l_extendedprice") - F.col("l_quantity") * F.col("p_retailprice")) / F.col("l_extendedprice")
    return j.groupBy(F.col("l_linenumber").alias("size")).agg(F.round(F.avg(r), 6).alias("mean_residual"), F.round(F.max(r), 6).alias("max_residual"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events) WHERE k % 10 = 0")
def thinned_history(spark, sf_dir):
    """Every tenth event of a user."""
    return thinned(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", 10)


@query("SELECT l_partkey AS part, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*)::DOUBLE * count(*) * 12 <= 12 * 30 * 30")
def feasible_sizes(spark, sf_dir):
    """The systems, one a part with its lines as unknowns, of which both copies of the matrix fit 10,800 bytes."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("n"))
    return g.filter(f.matrix_bytes(F.col("n"))[2] <= 12 * 30 * 30)


@query("SELECT l_linenumber AS n, CASE WHEN s < 2 THEN format('{:.2f}s', s) WHEN s < 120 THEN format('{:.0f}s', s) ELSE format('{:.1f}min', s / 60) END AS label FROM (SELECT l_linenumber, count(*) / 64.0 AS s FROM lineitem GROUP BY l_linenumber)")
def time_labels(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg((F.count("*") / 64.0).alias("s"))
    return g.select(F.col("l_linenumber").alias("n"), f.time_label(F.col("s")).alias("label"))


@query("""WITH c AS (SELECT user_id, event_id, event_type, value FROM events), r AS (SELECT user_id, max(CASE WHEN event_type = 'signup' THEN event_id END) AS removed FROM c GROUP BY user_id)
SELECT s_suppkey AS id, least(greatest(coalesce(arg_max(c.value, c.event_id) FILTER (c.event_type <> 'signup' AND c.event_id > coalesce(r.removed, -1)), 2.0) / 4.0, 1.0), 30.0) AS k, least(greatest(count(c.event_id) FILTER (c.event_type <> 'signup' AND c.event_id > coalesce(r.removed, -1)) * 20, 60), 500) AS n_panels
FROM supplier LEFT JOIN r ON r.user_id = s_suppkey LEFT JOIN c ON c.user_id = s_suppkey WHERE r.removed IS NULL OR EXISTS (SELECT 1 FROM c d WHERE d.user_id = s_suppkey AND d.event_id > r.removed) GROUP BY s_suppkey""")
def shape_commands(spark, sf_dir):
    """Commands folded into settings by shape: `signup` removes it, later commands add it again, the last one counts, numbers are clamped."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    gone = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.max("event_id").alias("removed"))
    live = e.join(gone, "user_id", "left").filter((F.col("event_type") != "signup") & (F.col("event_id") > F.coalesce("removed", F.lit(-1))))
    own = live.groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"), F.count("*").alias("n"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id")).join(gone, "user_id", "left").join(own, "user_id", "left").filter("removed IS NULL OR n IS NOT NULL")
    k, panels = f.clamped_settings(F.coalesce("value", F.lit(2.0)) / 4.0, F.coalesce("n", F.lit(0)) * 20)
    return s.select(F.col("user_id").alias("id"), k.alias("k"), panels.cast("long").alias("n_panels"))


@query("SELECT event_id, round(1.0 + ((event_id * 0.37) - floor(event_id * 0.37 / 29.0) * 29.0), 6) AS k, round(event_id * 0.11 - floor(event_id * 0.11 / (2 * pi())) * 2 * pi(), 6) AS alpha FROM events")
def parameter_sweep(spark, sf_dir):
    """The wave number wraps to its least value, the angle round the circle, event after event."""
    wrapped = lambda v, size: v - F.floor(v / size) * size
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 0.37).alias("a"), (F.col("event_id") * 0.11).alias("b"))
    return e.select("event_id", F.round(1.0 + wrapped(F.col("a"), 29.0), 6).alias("k"), F.round(wrapped(F.col("b"), 2 * math.pi), 6).alias("alpha"))


@query("SELECT user_id, event_type, count(*) AS frames FROM (SELECT DISTINCT user_id, event_type, time_bucket(INTERVAL 1 DAY, ts) FROM events) GROUP BY user_id, event_type")
def stream_frame_dedupe(spark, sf_dir):
    """A frame is sent on when its version (user, type and day) is new; the state forgets versions behind the watermark."""
    s = replay(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts")).withWatermark("ts", "400 days").dropDuplicatesWithinWatermark(["user_id", "event_type", "day"])
    return drained(s.select("user_id", "event_type", "day")).groupBy("user_id", "event_type").agg(F.count("*").alias("frames"))


@query("SELECT a.event_id AS bought, count(*) AS views FROM events a JOIN events b ON a.event_type = 'purchase' AND b.event_type = 'view' AND a.user_id = b.user_id AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 2 DAY GROUP BY a.event_id")
def stream_views_before_purchase(spark, sf_dir):
    """Extension: two streams joined by user within two days, both under watermarks."""
    one = replay(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("bought"), F.col("user_id").alias("u"), F.col("ts").alias("at")).withWatermark("at", "3 days")
    two = replay(spark, sf_dir, "events").filter("event_type = 'view'").select("user_id", "ts").withWatermark("ts", "3 days")
    near = (F.col("u") == F.col("user_id")) & (F.col("ts") <= F.col("at")) & (F.col("ts") > F.col("at") - F.expr("INTERVAL 2 DAYS"))
    return drained(one.join(two, near).select("bought")).groupBy("bought").agg(F.count("*").alias("views"))
