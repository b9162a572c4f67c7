"""Gaussian sums over customers, events, suppliers and panels by cells with moments; their SQL sums all pairs."""

from pyspark.sql import functions as F

from krylake.operators import spatial as s
from krylake.operators.tree_sums import gaussian_sums, work
from krylake.plans.fields import XY, sensors
from krylake.plans.registry import query
from krylake.plans.shapes import CHORDS
from krylake.plans.spatial import suppliers
from krylake.plans.tables import table

HITS = "e AS (SELECT event_id AS id, ((user_id * 7919) % 10007)::DOUBLE / 100.07 AS x, ((event_id * 104729) % 10007)::DOUBLE / 100.07 AS y, value / 1000.0 AS w FROM events)"


def place(c: str, k: int):
    return ((F.col(c) * k) % 10007).cast("double") / 100.07


def hits(spark, sf_dir):
    """(id, p, w): events on the plane; those of one user stand on one line."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.array(place("user_id", 7919), place("event_id", 104729)).alias("p"), (F.col("value") / 1000.0).alias("w"))


def points(spark, sf_dir):
    return sensors(spark, sf_dir).select("id", F.array("x", "y").alias("p"))


@query(f"{XY}, {HITS} SELECT s.id AS id, round(sum(w * exp(-0.25 * (power(s.x - e.x, 2) + power(s.y - e.y, 2)))), 5) AS y FROM s, e GROUP BY s.id")
def tree_field(spark, sf_dir):
    """What all events add at each customer."""
    return gaussian_sums(points(spark, sf_dir), hits(spark, sf_dir), 0.25, "w").select("id", F.round("y", 5).alias("y"))


@query("WITH s AS (SELECT c_custkey AS id, ((c_custkey * 7919) % 10007)::DOUBLE / 100.07 AS x, ((c_custkey * 104729) % 10007)::DOUBLE / 100.07 AS y, c_acctbal / 10000.0 AS w FROM customer) SELECT a.id AS id, round(sum(b.w * (exp(-0.5 * (power(a.x - b.x, 2) + power(a.y - b.y, 2))) + CASE WHEN a.id = b.id THEN 0.01 ELSE 0 END)), 5) AS y FROM s a, s b GROUP BY a.id")
def tree_matvec(spark, sf_dir):
    """The kernel matrix of the customers, its diagonal raised, times their balances."""
    w = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10000.0).alias("w"))
    p = points(spark, sf_dir).join(w, "id")
    return gaussian_sums(p, p, 0.5, "w", reg=0.01).select("id", F.round("y", 5).alias("y"))


@query(f"{XY}, t AS (SELECT ((s_suppkey * 7919) % 10007)::DOUBLE / 100.07 AS x, ((s_suppkey * 104729) % 10007)::DOUBLE / 100.07 AS y, s_acctbal / 10000.0 AS w FROM supplier) SELECT id, round(sum(w * exp(-0.02 * (power(s.x - t.x, 2) + power(s.y - t.y, 2)))), 5) AS mean FROM s, t GROUP BY id")
def tree_reconstruct(spark, sf_dir):
    """The posterior mean at the customers' places from weights at the suppliers'."""
    train = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(place("s_suppkey", 7919), place("s_suppkey", 104729)).alias("p"), (F.col("s_acctbal") / 10000.0).alias("w"))
    return gaussian_sums(points(spark, sf_dir), train, 0.02, "w").select("id", F.round("y", 5).alias("mean"))


@query(f"WITH p AS (SELECT s_suppkey AS id, ((s_suppkey * 7919) % 10007)::DOUBLE / 100.07 AS x, ((s_suppkey * 104729) % 10007)::DOUBLE / 100.07 AS y, 1.0 + s_suppkey % 4 AS a, 1.0 + s_suppkey % 4 AS b FROM supplier), {CHORDS.replace('40', '8')} SELECT r.id AS id, r.seq AS seq, round(sum(l.len * exp(-0.2 * (power(r.px - l.px, 2) + power(r.py - l.py, 2)))), 5) AS y FROM c r, c l GROUP BY r.id, r.seq")
def tree_coupled_panels(spark, sf_dir):
    """The panels of all shapes as one system."""
    shapes = suppliers(spark, sf_dir).select("id", F.lit("circle").alias("kind"), F.col("x").alias("cx"), F.col("y").alias("cy"), (1.0 + F.col("id") % 4).alias("a"), F.lit(1.0).alias("b"))
    p = s.panels(shapes, 8).select((F.col("id") * 8 + F.col("seq")).alias("id"), F.array("x", "y").alias("p"), "len")
    return gaussian_sums(p, p, 0.2, "len").select(F.floor(F.col("id") / 8).cast("long").alias("id"), (F.col("id") % 8).alias("seq"), F.round("y", 5).alias("y"))


@query(f"""{XY}, {HITS}, t AS (SELECT DISTINCT floor(x / 10.0)::BIGINT AS cx, floor(y / 10.0)::BIGINT AS cy FROM s), o AS (SELECT DISTINCT floor(x / 10.0)::BIGINT AS cx, floor(y / 10.0)::BIGINT AS cy FROM e), k AS (SELECT unnest(range(-6, 7)) AS k),
a AS (SELECT cx + k AS cx, cy FROM o, k WHERE cx + k IN (SELECT cx FROM t)), b AS (SELECT cx, cy + k FROM (SELECT DISTINCT * FROM a), k WHERE (cx, cy + k) IN (SELECT (cx, cy) FROM t))
SELECT (SELECT count(*) FROM s) AS targets, (SELECT count(*) FROM e) AS sources, (SELECT count(*) FROM s) * (SELECT count(*) FROM e) AS pairs, (SELECT count(*) FROM a) + (SELECT count(*) FROM b) AS moves""")
def tree_work(spark, sf_dir):
    """The pairs of events and customers, and the moves of cells that stand for them."""
    return work(points(spark, sf_dir), hits(spark, sf_dir), 0.01)
