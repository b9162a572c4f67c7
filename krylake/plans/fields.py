"""Sensor fields, hotspots, incidents and sizes over the tables customer, supplier, events and lineitem."""

from pyspark.sql import functions as F

from krylake.functions import fields as f
from krylake.operators.tree_sums import gaussian_sums
from krylake.plans.registry import query
from krylake.plans.tables import table
from krylake.sources.points import customer_sensors

XY = "WITH s AS (SELECT c_custkey AS id, ((c_custkey * 7919) % 10007)::DOUBLE / 100.07 AS x, ((c_custkey * 104729) % 10007)::DOUBLE / 100.07 AS y FROM customer)"
TEMPERATURE = "15.0 + 5.0 * sin((x + y) / 20.0 - 0.5 * {t})"
PRESSURE = "-12.0 * exp(-(power(x - (50.0 + 10.0 * cos({t} * 0.3)), 2) + power(y - (50.0 + 10.0 * sin({t} * 0.3)), 2)) / 800.0) + 3.0 * sin(x / 15.0)"
HUMIDITY = "40.0 * exp(-x / 30.0) + 10.0 * sin(2.0 * pi() * {t} / 24.0 - y / 25.0)"
HOTSPOT = " + ".join(f"{a}::DOUBLE * (0.85 + 0.15 * sin(2.0 * {w} * {{t}})) * exp(-(power(x - ({cx} + 5.0 * sin({w} * {{t}} + ({px}))), 2) + power(y - ({cy} + 5.0 * cos({w} * {{t}} * 0.7 + ({py}))), 2)) / (2.0 * power({s}, 2)))" for cx, cy, s, a, px, py, w in f.HOTSPOTS)
INCIDENTS = """i AS (SELECT event_id AS id, ((user_id * 7919) % 10007)::DOUBLE / 100.07 AS x, ((event_id * 104729) % 10007)::DOUBLE / 100.07 AS y, (event_id % 50)::DOUBLE AS t_start,
 CASE WHEN event_id % 7 = 0 THEN -1.0 ELSE (event_id % 40)::DOUBLE END AS duration FROM events WHERE event_type = 'error'),
strong AS (SELECT *, CASE WHEN duration < 0 THEN 1.0 WHEN duration = 0 OR 45.5 < t_start OR (45.5 - t_start) / duration >= 1.0 THEN 0.0 WHEN (45.5 - t_start) / duration > 0.8 THEN 1.0 - ((45.5 - t_start) / duration - 0.8) / 0.2 ELSE 1.0 END::DOUBLE AS strength FROM i)"""
T = 45.5


def sensors(spark, sf_dir):
    return customer_sensors(table(spark, sf_dir, "customer"))


def incidents(spark, sf_dir):
    """(id, x, y, t_start, duration): the errors among the events, spread over the square and over time."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    place = lambda c, k: ((F.col(c) * k) % 10007).cast("double") / 100.07
    return e.select(F.col("event_id").alias("id"), place("user_id", 7919).alias("x"), place("event_id", 104729).alias("y"), (F.col("event_id") % 50).cast("double").alias("t_start"), F.when(F.col("event_id") % 7 == 0, -1.0).otherwise((F.col("event_id") % 40).cast("double")).alias("duration"))


def _field(name):
    def run(spark, sf_dir):
        return sensors(spark, sf_dir).select("id", F.round(f.sensor_field(name, F.col("x"), F.col("y"), F.lit(3.0)), 6).alias("v"))

    run.__name__ = f"field_{name}"
    return run


for _name, _sql in (("temperature", TEMPERATURE), ("pressure", PRESSURE), ("humidity", HUMIDITY)):
    query(f"{XY} SELECT id, round({_sql.format(t='3.0')}, 6) AS v FROM s")(_field(_name))


@query(f"""{XY}, t AS (SELECT unnest(range(24))::DOUBLE AS t), v AS (
SELECT 'temperature' AS field, t, {TEMPERATURE.format(t='t')} AS v FROM s, t UNION ALL SELECT 'pressure', t, {PRESSURE.format(t='t')} FROM s, t UNION ALL SELECT 'humidity', t, {HUMIDITY.format(t='t')} FROM s, t)
SELECT field, t, round(avg(v), 6) AS mean, round(min(v), 6) AS low, round(max(v), 6) AS high FROM v GROUP BY field, t""")
def fields_by_step(spark, sf_dir):
    s = sensors(spark, sf_dir).select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("t")).withColumn("t", F.col("t").cast("double"))
    each = F.array(*[F.struct(F.lit(n).alias("field"), f.sensor_field(n, F.col("x"), F.col("y"), F.col("t")).alias("v")) for n in f.FIELDS])
    return s.select("t", F.inline(each)).groupBy("field", "t").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.min("v"), 6).alias("low"), F.round(F.max("v"), 6).alias("high"))


@query(f"{XY} SELECT id, round(least(greatest({HOTSPOT.format(t='7.0')}, 0.0), 1.0), 6) AS congestion FROM s")
def hotspot_field(spark, sf_dir):
    return sensors(spark, sf_dir).select("id", F.round(f.clip(f.hotspots(F.col("x"), F.col("y"), F.lit(7.0)), 0.0, 1.0), 6).alias("congestion"))


@query(f"WITH {INCIDENTS} SELECT id, round(strength, 6) AS strength FROM strong")
def incident_strength(spark, sf_dir):
    return incidents(spark, sf_dir).select("id", F.round(f.incident_strength(F.lit(T), F.col("t_start"), F.col("duration")), 6).alias("strength"))


@query(f"WITH {INCIDENTS} SELECT id, t_start, duration FROM i WHERE duration < 0 OR {T} - t_start < duration")
def incident_prune(spark, sf_dir):
    return incidents(spark, sf_dir).filter(f.incident_lasts(F.lit(T), F.col("t_start"), F.col("duration"))).select("id", "t_start", "duration")


@query(f"{XY}, {INCIDENTS} SELECT s.id AS id, round(coalesce(sum(0.85 * strength * exp(-(power(s.x - i.x, 2) + power(s.y - i.y, 2)) / 50.0)), 0.0), 4) AS extra FROM s LEFT JOIN (SELECT * FROM strong WHERE strength > 0) i ON true GROUP BY s.id")
def incident_field(spark, sf_dir):
    """All incidents have one radius, so their sum is one of Gaussians, by cells with moments; without incidents it is 0."""
    live = incidents(spark, sf_dir).withColumn("w", 0.85 * f.incident_strength(F.lit(T), F.col("t_start"), F.col("duration"))).filter("w > 0")
    s = sensors(spark, sf_dir).select("id", F.array("x", "y").alias("p"))
    return gaussian_sums(s, live.select(F.array("x", "y").alias("p"), "w"), 1.0 / 50.0, "w").select("id", F.round("y", 4).alias("extra"))


@query(f"{XY}, g AS (SELECT DISTINCT least(floor(x / 100.0 * 64), 63)::INTEGER AS gx, least(floor(y / 100.0 * 64), 63)::INTEGER AS gy FROM s), n AS (SELECT gx, gy, 0.0 + gx * ((100.0 - 0.0) / 63) AS x, 0.0 + gy * ((100.0 - 0.0) / 63) AS y FROM g) SELECT gx, gy, round(least(greatest({HOTSPOT.format(t='2.0')}, 0.0), 1.0), 6) AS congestion FROM n")
def grid_eval(spark, sf_dir):
    """The field at the nodes of a 64 x 64 grid next to which there are sensors."""
    cell = lambda c: F.least(F.floor(F.col(c) / 100.0 * 64), F.lit(63)).cast("int")
    g = sensors(spark, sf_dir).select(cell("x").alias("gx"), cell("y").alias("gy")).distinct()
    x, y = f.linspace(F.col("gx"), 64, 0.0, 100.0), f.linspace(F.col("gy"), 64, 0.0, 100.0)
    return g.select("gx", "gy", F.round(f.clip(f.hotspots(x, y, F.lit(2.0)), 0.0, 1.0), 6).alias("congestion"))


@query(f"{XY}, t AS (SELECT ((s_suppkey * 7919) % 10007)::DOUBLE / 100.07 AS x, ((s_suppkey * 104729) % 10007)::DOUBLE / 100.07 AS y, s_acctbal / 10000.0 AS w FROM supplier) SELECT id, round(sum(w * exp(-0.2 * (power(s.x - t.x, 2) + power(s.y - t.y, 2)))), 6) AS mean FROM s, t GROUP BY id")
def gp_reconstruct(spark, sf_dir):
    """The posterior mean at the customers' places from weights at the suppliers'."""
    place = lambda k: ((F.col("s_suppkey") * k) % 10007).cast("double") / 100.07
    train = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(place(7919), place(104729)).alias("p"), (F.col("s_acctbal") / 10000.0).alias("w"))
    q = sensors(spark, sf_dir).select("id", F.array("x", "y").alias("p"))
    return gaussian_sums(q, train, 0.2, "w").select("id", F.round("y", 6).alias("mean"))


SIZES = "WITH g AS (SELECT l_shipmode, n FROM (SELECT l_returnflag || l_linestatus || (l_linenumber::VARCHAR) AS l_shipmode, count(*) AS n FROM lineitem GROUP BY 1))"


def sizes(spark, sf_dir):
    """(l_shipmode, n): kinds of lines and how many there are, taken as unknowns of a system."""
    key = F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy(key.alias("l_shipmode")).agg(F.count("*").alias("n"))


@query(f"{SIZES} SELECT l_shipmode AS kind, n, n::DOUBLE * n * 8 AS f64, n::DOUBLE * n * 4 AS f32, n::DOUBLE * n * 12 AS both_bytes FROM g")
def memory_footprint(spark, sf_dir):
    b8, b4, b12 = f.matrix_bytes(F.col("n"))
    return sizes(spark, sf_dir).select(F.col("l_shipmode").alias("kind"), "n", b8.alias("f64"), b4.alias("f32"), b12.alias("both_bytes"))


@query(f"{SIZES} SELECT l_shipmode AS kind, CASE WHEN n::DOUBLE * n * 4 <= 0.6 * 4e6 THEN 0 WHEN n::DOUBLE * n * 4 <= 0.8 * 1e8 THEN 1 ELSE 2 END::BIGINT AS backend FROM g")
def backend_select(spark, sf_dir):
    return sizes(spark, sf_dir).select(F.col("l_shipmode").alias("kind"), f.backend(F.col("n"), 4e6, 1e8).alias("backend"))


@query(f"{SIZES} SELECT l_shipmode AS kind, round(1.6 * power(n::DOUBLE / 6000.0, 3), 6) AS seconds FROM g")
def cubic_extrapolation(spark, sf_dir):
    return sizes(spark, sf_dir).select(F.col("l_shipmode").alias("kind"), F.round(f.cubic_seconds(F.col("n")), 6).alias("seconds"))


@query(f"{SIZES} SELECT l_shipmode AS kind, greatest(6, 6 + trunc((n::DOUBLE / 8192.0 - 1.0) * 1.5)::BIGINT) AS outer_iterations FROM g")
def maxiter_rule(spark, sf_dir):
    return sizes(spark, sf_dir).select(F.col("l_shipmode").alias("kind"), f.outer_iterations(F.col("n")).alias("outer_iterations"))
