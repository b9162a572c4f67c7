"""Incidents that reach no further than they say: sums at customers, and how many pairs that takes."""

from pyspark.sql import functions as F

from krylake.functions import fields as f
from krylake.operators.reach import bumps, within_reach
from krylake.plans.fields import INCIDENTS, XY, T, incidents, sensors
from krylake.plans.registry import query

SIGMA = "(0.25 * power(2.0, id % 5))"


def live(spark, sf_dir):
    """(cx, cy, sigma, amp): incidents with some strength left, their radii from 0.25 to 4."""
    strength = f.incident_strength(F.lit(T), F.col("t_start"), F.col("duration"))
    i = incidents(spark, sf_dir).withColumn("amp", (0.5 + F.col("id") % 4 / 10.0) * strength).filter("amp > 0")
    return i.select(F.col("x").alias("cx"), F.col("y").alias("cy"), (0.25 * F.pow(F.lit(2.0), F.col("id") % 5)).alias("sigma"), "amp")


@query(f"{XY}, {INCIDENTS} SELECT s.id AS id, round(coalesce(sum((0.5 + i.id % 4 / 10.0) * strength * exp(-(power(s.x - i.x, 2) + power(s.y - i.y, 2)) / (2.0 * power({SIGMA.replace('id', 'i.id')}, 2)))), 0.0), 4) AS extra FROM s LEFT JOIN (SELECT * FROM strong WHERE strength > 0) i ON true GROUP BY s.id")
def incident_field_reach(spark, sf_dir):
    """Incidents of very different radii: each meets only the customers within eight of its radii, beyond which exp(-32) of it is left."""
    return bumps(sensors(spark, sf_dir), live(spark, sf_dir)).select("id", F.round("y", 4).alias("extra"))


@query(f"{XY}, {INCIDENTS}, i2 AS (SELECT x, y, {SIGMA} AS sigma FROM strong WHERE strength > 0), j AS (SELECT sigma, count(*) AS pairs FROM s JOIN i2 ON power(s.x - i2.x, 2) + power(s.y - i2.y, 2) <= power(3.0 * sigma, 2) GROUP BY sigma) SELECT sigma, count(*) AS incidents, any_value(coalesce(pairs, 0)) AS pairs FROM i2 LEFT JOIN j USING (sigma) GROUP BY sigma")
def incident_reach_pairs(spark, sf_dir):
    """Pairs of incidents and customers within three radii, by radius. Customers at one place (there are 10007 places) are counted before the join, which makes a row a place in reach."""
    c = live(spark, sf_dir).withColumn("reach", 3.0 * F.col("sigma"))
    places = sensors(spark, sf_dir).groupBy("x", "y").agg(F.count("*").alias("n"))
    pairs = within_reach(places, c).groupBy("sigma").agg(F.sum("n").alias("pairs"))
    return c.groupBy("sigma").agg(F.count("*").alias("incidents")).join(pairs, "sigma", "left").select("sigma", "incidents", F.coalesce("pairs", F.lit(0)).alias("pairs"))
