"""Shapes, panels and systems made of several shapes, from supplier, part, embeddings and events."""

import math

from pyspark.sql import functions as F

from krylake.functions import fields as f
from krylake.functions.kernels import rbf_block
from krylake.operators import spatial as s
from krylake.operators.blocks import kernel_apply
from krylake.operators.linear import blocks_product, coordinates_product, from_blocks, real_blocks
from krylake.operators.quadtree import nearest
from krylake.operators.tree_sums import gaussian_sums
from krylake.plans.fields import INCIDENTS, XY, T, incidents, sensors
from krylake.plans.registry import query
from krylake.plans.spatial import SUP, suppliers
from krylake.plans.tables import table, written

CLICKS = "c AS (SELECT event_id AS id, ((user_id * 7919) % 10007)::DOUBLE / 100.07 AS x, ((event_id * 104729) % 10007)::DOUBLE / 100.07 AS y FROM events WHERE event_type = 'click')"
CHORDS = """k AS (SELECT p.*, seq, 2 * pi() / 40 * seq AS u, 2 * pi() / 40 * (seq + 1) AS v FROM p, (SELECT unnest(range(40)) AS seq)),
c AS (SELECT id, seq, x + (a * cos(u) + a * cos(v)) / 2 AS px, y + (b * sin(u) + b * sin(v)) / 2 AS py, sqrt(power(a * cos(v) - a * cos(u), 2) + power(b * sin(v) - b * sin(u), 2)) AS len FROM k)"""


@query(f"WITH p AS (SELECT s_suppkey AS id, ((s_suppkey * 7919) % 10007)::DOUBLE / 100.07 AS x, ((s_suppkey * 104729) % 10007)::DOUBLE / 100.07 AS y, 1.0 + s_suppkey % 4 AS a, CASE WHEN s_suppkey % 2 = 0 THEN 1.0 + s_suppkey % 4 ELSE 0.5 + s_suppkey % 3 END AS b FROM supplier), {CHORDS} SELECT id, seq, round(px, 6) AS x, round(py, 6) AS y, round(len, 6) AS len FROM c")
def ellipse_panels(spark, sf_dir):
    """Circles (even suppliers) and ellipses as chords between equal steps of the angle, through the dispatcher; `submarine` counts as an ellipse."""
    place = lambda k: ((F.col("s_suppkey") * k) % 10007).cast("double") / 100.07
    kind = F.when(F.col("s_suppkey") % 2 == 0, "circle").when(F.col("s_suppkey") % 3 == 0, "submarine").otherwise("ellipse")
    shapes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), kind.alias("kind"), place(7919).alias("cx"), place(104729).alias("cy"), (1.0 + F.col("s_suppkey") % 4).alias("a"), (0.5 + F.col("s_suppkey") % 3).alias("b"))
    return s.panels(shapes, 40).select("id", "seq", *[F.round(c, 6).alias(c) for c in ("x", "y", "len")])


@query("WITH p AS (SELECT s_suppkey AS id, ['rect', 'circle', 'ellipse', 'other'][(s_suppkey % 4) + 1] AS kind, 1.0 + s_suppkey % 5 AS a, 0.5 + s_suppkey % 3 AS b FROM supplier) SELECT kind, count(*) * 48 AS panels, round(sum(CASE kind WHEN 'rect' THEN 2 * (a + b) ELSE (SELECT sum(sqrt(power(a * (cos(2 * pi() / 48 * (k + 1)) - cos(2 * pi() / 48 * k)), 2) + power((CASE kind WHEN 'circle' THEN a ELSE b END) * (sin(2 * pi() / 48 * (k + 1)) - sin(2 * pi() / 48 * k)), 2))) FROM (SELECT unnest(range(48)) AS k)) END), 6) AS length FROM p GROUP BY kind")
def shape_dispatch(spark, sf_dir):
    """Panels of every kind of shape, and how long they are together."""
    kind = F.element_at(F.array(*map(F.lit, ("rect", "circle", "ellipse", "other"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    shapes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), kind.alias("kind"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), (1.0 + F.col("s_suppkey") % 5).alias("a"), (0.5 + F.col("s_suppkey") % 3).alias("b"))
    return s.panels(shapes, 48).join(shapes.select("id", "kind"), "id").groupBy("kind").agg(F.count("*").alias("panels"), F.round(F.sum("len"), 6).alias("length"))


@query(f"WITH p AS (SELECT s_suppkey AS id, ((s_suppkey * 7919) % 10007)::DOUBLE / 100.07 AS x, ((s_suppkey * 104729) % 10007)::DOUBLE / 100.07 AS y, 1.0 + s_suppkey % 4 AS a, 1.0 + s_suppkey % 4 AS b FROM supplier), {CHORDS.replace('40', '8')} SELECT r.id AS id, r.seq AS seq, round(sum(l.len * exp(-0.05 * (power(r.px - l.px, 2) + power(r.py - l.py, 2)))), 5) AS y FROM c r, c l GROUP BY r.id, r.seq")
def coupled_panels(spark, sf_dir):
    """The panels of all shapes as one system: each meets those of every other shape, off the diagonal blocks too."""
    shapes = suppliers(spark, sf_dir).select("id", F.lit("circle").alias("kind"), F.col("x").alias("cx"), F.col("y").alias("cy"), (1.0 + F.col("id") % 4).alias("a"), F.lit(1.0).alias("b"))
    p = s.panels(shapes, 8).select((F.col("id") * 8 + F.col("seq")).alias("id"), F.array("x", "y").alias("p"), "len")
    return gaussian_sums(p, p, 0.05, "len").select(F.floor(F.col("id") / 8).cast("long").alias("id"), (F.col("id") % 8).alias("seq"), F.round("y", 5).alias("y"))


@query(f"WITH {SUP}, {CLICKS}, d AS (SELECT c.id AS id, p.id AS nid, power(c.x - p.x, 2) + power(c.y - p.y, 2) AS d2 FROM c, p) SELECT id, nid AS nearest_id, round(sqrt(d2), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, nid) AS r FROM d) WHERE r = 1")
def shape_at_click(spark, sf_dir):
    """The shape nearest to each click."""
    place = lambda c, k: ((F.col(c) * k) % 10007).cast("double") / 100.07
    clicks = table(spark, sf_dir, "events").filter("event_type = 'click'").select(F.col("event_id").alias("id"), F.array(place("user_id", 7919), place("event_id", 104729)).alias("p"))
    return nearest(clicks, suppliers(spark, sf_dir).select("id", F.array("x", "y").alias("p"))).withColumn("distance", F.round("distance", 6))


@query(f"{XY}, {INCIDENTS} SELECT s.id AS id, round(coalesce(sum((0.5 + i.id % 4 / 10.0) * strength * exp(-(power(s.x - i.x, 2) + power(s.y - i.y, 2)) / (2.0 * power(3.0 + i.id % 5, 2)))), 0.0), 4) AS extra FROM s LEFT JOIN (SELECT * FROM strong WHERE strength > 0) i ON true GROUP BY s.id")
def incident_field_own_radius(spark, sf_dir):
    """Each incident has a radius and an amplitude of its own: cells of one radius are told from those of another."""
    strength = f.incident_strength(F.lit(T), F.col("t_start"), F.col("duration"))
    live = incidents(spark, sf_dir).withColumn("w", (0.5 + F.col("id") % 4 / 10.0) * strength).filter("w > 0")
    s_ = sensors(spark, sf_dir).select("id", F.array("x", "y").alias("p"))
    centres = live.select(F.array("x", "y").alias("p"), "w", (1.0 / (2.0 * F.pow(3.0 + F.col("id") % 5, 2))).alias("gamma"))
    return gaussian_sums(s_, centres, "gamma", "w").select("id", F.round("y", 4).alias("extra"))


@query("WITH t AS (SELECT ((s_suppkey * 7919) % 10007)::DOUBLE / 100.07 AS x, ((s_suppkey * 104729) % 10007)::DOUBLE / 100.07 AS y, s_acctbal / 10000.0 AS w FROM supplier), g AS (SELECT gy, gx, gx * (100.0 / 63) AS x, gy * (100.0 / 63) AS y FROM (SELECT unnest(range(64)) AS gx), (SELECT unnest(range(64)) AS gy)) SELECT gx::INTEGER AS gx, gy::INTEGER AS gy, round(sum(w * exp(-0.02 * (power(g.x - t.x, 2) + power(g.y - t.y, 2)))), 5) AS mean FROM g, t GROUP BY gx, gy")
def grid_reconstruct(spark, sf_dir):
    """The posterior mean from the suppliers' weights at every node of a 64 x 64 grid, both ends included."""
    from krylake.sources.points import grid

    place = lambda k: ((F.col("s_suppkey") * k) % 10007).cast("double") / 100.07
    train = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(place(7919), place(104729)).alias("p"), (F.col("s_acctbal") / 10000.0).alias("w"))
    nodes = grid(spark, 64, 64).select((F.col("gy") * 64 + F.col("gx")).cast("long").alias("id"), F.array("x", "y").alias("p"))
    y = kernel_apply(nodes, train, rbf_block(0.02), "w")
    return y.select((F.col("id") % 64).cast("int").alias("gx"), F.floor(F.col("id") / 64).cast("int").alias("gy"), F.round("y", 5).alias("mean"))


@query("SELECT l_orderkey AS i, round(sum(l_quantity * p_retailprice), 2) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def matrix_from_entries(spark, sf_dir):
    """A user's matrix by entries (order, part, quantity) times a vector (part, price): partial sums, a shuffle on the rows."""
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v"))
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("j"), F.col("p_retailprice").alias("x"))
    return coordinates_product(entries, x).select("i", F.round("y", 2).alias("y"))


@query("SELECT vec_id AS i, round(list_dot_product(CAST(embedding AS DOUBLE[]), list_transform(range(len(embedding)), lambda k: 1.0 + (k % 5)::DOUBLE)), 6) AS y FROM embeddings")
def matrix_from_blocks(spark, sf_dir):
    """A user's matrix as blocks of rows, stored in the shared folder and scanned again, times a vector."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("row"))
    blocks = written(from_blocks(e, 256))
    x = [1.0 + k % 5 for k in range(e.agg(F.max(F.size("row"))).first()[0] or 0)]  # rows of another length are an error of the product
    return blocks_product(blocks, x).select("i", F.round("y", 6).alias("y"))


@query("""WITH e AS (SELECT l_orderkey AS i, l_partkey AS j, l_quantity AS re, l_discount AS im FROM lineitem), x AS (SELECT p_partkey AS j, p_retailprice / 1000.0 AS xr, p_size / 10.0 AS xi FROM part)
SELECT 2 * i AS i, round(sum(re * xr - im * xi), 6) AS y FROM e JOIN x USING (j) GROUP BY i UNION ALL SELECT 2 * i + 1, round(sum(im * xr + re * xi), 6) FROM e JOIN x USING (j) GROUP BY i""")
def complex_to_real(spark, sf_dir):
    """A complex matrix as real blocks [[re, -im], [im, re]] over interleaved rows, times a complex vector laid out likewise."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("re"), F.col("l_discount").alias("im"))
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("j"), F.posexplode(F.array(F.col("p_retailprice") / 1000.0, F.col("p_size") / 10.0)).alias("k", "x")).select((2 * F.col("j") + F.col("k")).alias("j"), "x")
    return coordinates_product(real_blocks(e), x).select("i", F.round("y", 6).alias("y"))


@query("WITH d AS (SELECT vec_id AS id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * (1 + label) AS v FROM embeddings), m AS (SELECT CASE WHEN avg(abs(v)) > 0 THEN avg(abs(v)) ELSE 0.1 END AS scale FROM d) SELECT id, round(v + 1e-4 * scale, 8) AS shifted FROM d, m")
def tikhonov_shift(spark, sf_dir):
    """A diagonal plus 1e-4 of its mean size (0.1 where that is nothing): one aggregate, whose single row is broadcast to all."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.aggregate(F.transform("embedding", lambda v: v.cast("double") * v.cast("double")), F.lit(0.0), lambda a, v: a + v) * (1 + F.col("label"))).alias("v"))
    mean = e.agg(F.avg(F.abs("v")).alias("m")).select(F.when(F.col("m") > 0, F.col("m")).otherwise(0.1).alias("scale"))
    return e.join(F.broadcast(mean)).select("id", F.round(F.col("v") + 1e-4 * F.col("scale"), 8).alias("shifted"))


@query(f"{XY} SELECT id, round(x * cos(2.0 * x), 6) AS re, round(abs(x * cos(2.0 * x)), 6) AS size, round(power(x * cos(2.0 * x), 2) + power(y * sin(2.0 * x), 2), 4) AS power, round(atan2(y * sin(2.0 * x), x * cos(2.0 * x)), 6) AS phase FROM s")
def display_forms(spark, sf_dir):
    """What a client shows of a complex field."""
    d = f.display(F.col("x") * F.cos(2.0 * F.col("x")), F.col("y") * F.sin(2.0 * F.col("x")))
    return sensors(spark, sf_dir).select("id", F.round(d["re"], 6).alias("re"), F.round(F.abs(d["re"]), 6).alias("size"), F.round(d["power"], 4).alias("power"), F.round(d["phase"], 6).alias("phase"))


@query(f"{XY} SELECT id, round((x / 100.0 * 512.0 - 256.0) / 512.0 * 12.0, 6) AS px, round((256.0 - y / 100.0 * 512.0) / 512.0 * 12.0, 6) AS py FROM s")
def canvas_to_plane(spark, sf_dir):
    """Pixels of a canvas of 512 to a plane of 12, the vertical axis turned."""
    x, y = f.from_canvas(F.col("x") / 100.0 * 512.0, F.col("y") / 100.0 * 512.0, 512.0, 512.0, 12.0)
    return sensors(spark, sf_dir).select("id", F.round(x, 6).alias("px"), F.round(y, 6).alias("py"))


@query("WITH v AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'nan'::DOUBLE WHEN o_orderkey % 11 = 0 THEN 'inf'::DOUBLE ELSE o_totalprice END AS v, o_orderstatus AS s FROM orders) SELECT s, count(*) AS n, sum(CASE WHEN isfinite(v) THEN 0 ELSE 1 END)::BIGINT AS mended, round(sum(CASE WHEN isfinite(v) THEN v ELSE 0.0 END), 2) AS total FROM v GROUP BY s")
def sanitised_field(spark, sf_dir):
    """Values that aren't finite count as 0 and are told."""
    v = F.when(F.col("o_orderkey") % 7 == 0, F.lit(math.nan)).when(F.col("o_orderkey") % 11 == 0, F.lit(math.inf)).otherwise(F.col("o_totalprice"))
    d = table(spark, sf_dir, "orders").select(v.alias("v"), F.col("o_orderstatus").alias("s"))
    return d.groupBy("s").agg(F.count("*").alias("n"), F.sum(F.when(f.finite(F.col("v")), 0).otherwise(1)).alias("mended"), F.round(F.sum(f.sanitised(F.col("v"))), 2).alias("total"))
