"""Geometry over customer, supplier, part and orders."""

import math

from pyspark.sql import functions as F

from krylake.functions import fields as f
from krylake.operators import spatial as s
from krylake.operators.quadtree import masked, nearest
from krylake.plans.fields import XY, sensors
from krylake.plans.registry import query
from krylake.plans.tables import table
from krylake.sources.points import densify

SUP = "p AS (SELECT s_suppkey AS id, s_nationkey AS line, ((s_suppkey * 7919) % 10007)::DOUBLE / 100.07 AS x, ((s_suppkey * 104729) % 10007)::DOUBLE / 100.07 AS y, 2.0 + (s_suppkey % 5) AS w, 1.5 + (s_suppkey % 3) AS h FROM supplier)"


def suppliers(spark, sf_dir):
    place = lambda k: ((F.col("s_suppkey") * k) % 10007).cast("double") / 100.07
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("line"), place(7919).alias("x"), place(104729).alias("y"), (2.0 + F.col("s_suppkey") % 5).alias("w"), (1.5 + F.col("s_suppkey") % 3).alias("h"))


@query(f"{XY} SELECT id, round((-123.3 + y / 125.0 - (-123.3)) / (-122.3 - (-123.3)) * 100.0, 6) AS px, round((49.0 + x / 250.0 - 49.0) / (49.4 - 49.0) * 100.0, 6) AS py FROM s")
def ll_to_sim(spark, sf_dir):
    lat, lng = 49.0 + F.col("x") / 250.0, -123.3 + F.col("y") / 125.0
    px, py = f.to_plane(lat, lng, 49.0, 49.4, -123.3, -122.3)
    return sensors(spark, sf_dir).select("id", F.round(px, 6).alias("px"), F.round(py, 6).alias("py"))


@query(f"""WITH {SUP}, e AS (SELECT line, id AS seq, x, y, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM p WINDOW w AS (PARTITION BY line ORDER BY id)),
n AS (SELECT *, coalesce(greatest(1, ceil(sqrt(power(x - x0, 2) + power(y - y0, 2)) / 4.0)::BIGINT), 1) AS n FROM e),
k AS (SELECT *, unnest(range(1, n + 1)) AS k FROM n)
SELECT line, seq, k, round(CASE WHEN x0 IS NULL THEN x ELSE x0 + (x - x0) * (k::DOUBLE / n) END, 6) AS x, round(CASE WHEN y0 IS NULL THEN y ELSE y0 + (y - y0) * (k::DOUBLE / n) END, 6) AS y FROM k""")
def densify_roads(spark, sf_dir):
    """A nation's suppliers in turn as a polyline, points at most 4 apart."""
    d = densify(suppliers(spark, sf_dir).withColumnRenamed("id", "seq"), "line", "seq", "x", "y", 4.0)
    return d.withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


@query(f"{XY}, {SUP}, d AS (SELECT s.id AS id, p.id AS nid, power(s.x - p.x, 2) + power(s.y - p.y, 2) AS d2 FROM s, p), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, nid) AS r FROM d) SELECT id, nid AS nearest_id, round(sqrt(d2), 6) AS distance FROM r WHERE r = 1")
def nearest_road(spark, sf_dir):
    p = lambda d: d.select("id", F.array("x", "y").alias("p"))
    return nearest(p(sensors(spark, sf_dir)), p(suppliers(spark, sf_dir))).withColumn("distance", F.round("distance", 6))


@query(f"{XY}, {SUP} SELECT s.id AS id, count(p.id) > 0 AS interior FROM s LEFT JOIN p ON s.x > p.x - p.w / 2 AND s.x < p.x + p.w / 2 AND s.y > p.y - p.h / 2 AND s.y < p.y + p.h / 2 GROUP BY s.id")
def point_in_polygon(spark, sf_dir):
    polygons = suppliers(spark, sf_dir).select(s.rect_corners(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("corners"))
    return masked(sensors(spark, sf_dir), polygons).select("id", "interior")


EDGES = """e AS (SELECT id, unnest([{ex: x - w / 2, ey: y - h / 2, dx: w, dy: 0.0, t0: 0.0, t1: w}, {ex: x + w / 2, ey: y - h / 2, dx: 0.0, dy: h, t0: w, t1: w + h}, {ex: x + w / 2, ey: y + h / 2, dx: -w, dy: 0.0, t0: w + h, t1: 2 * w + h}, {ex: x - w / 2, ey: y + h / 2, dx: 0.0, dy: -h, t0: 2 * w + h, t1: 2 * w + 2 * h}], recursive := true), w, h FROM p),
r AS (SELECT e.*, seq, 2 * (w + h) / 60 AS len, (seq + 0.5) * 2 * (w + h) / 60 AS mid FROM e, (SELECT unnest(range(60)) AS seq))"""


@query(f"WITH {SUP}, {EDGES} SELECT id, seq, round(ex + dx * (mid - t0) / (t1 - t0), 6) AS x, round(ey + dy * (mid - t0) / (t1 - t0), 6) AS y, dy / (t1 - t0) AS nx, 0.0 - dx / (t1 - t0) AS ny, round(len, 6) AS len FROM r WHERE mid >= t0 AND mid < t1")
def rect_panels(spark, sf_dir):
    shapes = suppliers(spark, sf_dir).select("id", F.col("x").alias("cx"), F.col("y").alias("cy"), "w", "h")
    return s.rect_panels(shapes, 60).select("id", "seq", *[F.round(c, 6).alias(c) for c in ("x", "y")], *[(F.col(c) + 0.0).alias(c) for c in ("nx", "ny")], F.round("len", 6).alias("len"))


KINDS = "['ellipse', 'circle', 'submarine', 'rect', 'other']"


@query(f"""WITH k AS (SELECT p_brand, ({KINDS})[(p_partkey % 5) + 1] AS kind, p_size / 10.0 AS a, 1.0 + p_partkey % 3 AS b FROM part),
m AS (SELECT p_brand, max(CASE kind WHEN 'ellipse' THEN pi() * (3 * (a + b) - sqrt((3 * a + b) * (a + 3 * b))) WHEN 'circle' THEN 2 * pi() * a WHEN 'submarine' THEN 2 * a + 2 * pi() * b WHEN 'rect' THEN 2 * (a + b) ELSE 8.0 END) AS longest FROM k GROUP BY p_brand)
SELECT p_brand, greatest(60, ceil(10 * 3.0 * longest / (2 * pi()) - 1e-9))::BIGINT AS panels FROM m""")
def recommended_panels(spark, sf_dir):
    """Panels that the shapes of a brand need at wave number 3."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("ellipse", "circle", "submarine", "rect", "other")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    long = f.perimeter(kind, F.col("p_size") / 10.0, 1.0 + F.col("p_partkey") % 3)
    out = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max(long).alias("longest"))
    return out.select("p_brand", F.greatest(F.lit(60), F.ceil(10 * 3.0 * F.col("longest") / (2 * math.pi) - 1e-9)).cast("long").alias("panels"))


@query(f"""{XY}, w AS (SELECT 2.0 * (x * cos(0.3) + y * sin(0.3)) AS ph, id % 7 = 0 AS interior, (id % 10) / 10.0 AS a FROM s),
p AS (SELECT cos(ph) AS ir, sin(ph) AS ii, cos(ph) * a AS r, sin(ph) * (1.0 - a) AS i FROM w WHERE NOT interior)
SELECT round(least(200.0, avg(r * r + i * i) / greatest(avg(ir * ir + ii * ii), 1e-12)), 6) AS field_power, round(least(200.0, avg(power(r - ir, 2) + power(i - ii, 2)) / greatest(avg(ir * ir + ii * ii), 1e-12)), 6) AS scattered_power FROM p""")
def incident_wave_power(spark, sf_dir):
    re, im = f.wave(F.col("x"), F.col("y"), F.lit(2.0), F.lit(0.3))
    a = (F.col("id") % 10) / 10.0
    field = sensors(spark, sf_dir).select((re * a).alias("re"), (im * (1.0 - a)).alias("im"), re.alias("inc_re"), im.alias("inc_im"), (F.col("id") % 7 == 0).alias("interior"))
    return s.wave_power(field).select(F.round("field_power", 6).alias("field_power"), F.round("scattered_power", 6).alias("scattered_power"))


@query("SELECT label, count(*) AS n FROM (SELECT CASE WHEN p < 0.05 THEN 'CLOAK' WHEN p < 0.15 THEN 'LOW' WHEN p < 0.5 THEN 'MED' WHEN p < 1.0 THEN 'HIGH' ELSE 'LOUD' END AS label FROM (SELECT o_totalprice / 300000.0 AS p FROM orders)) GROUP BY label")
def power_label(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(f.power_label(F.col("o_totalprice") / 300000.0).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
