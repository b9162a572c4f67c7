"""Joins within a reach that every centre has of its own: grids by size of reach, one question a grid."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level(reach: Column) -> Column:
    """The least power of two that isn't below the reach."""
    k = F.ceil(F.log2(reach)).cast("int")
    return k + F.when(F.pow(F.lit(2.0), k) < reach, 1).otherwise(0)  # where the logarithm was rounded down


def within_reach(points: DataFrame, centres: DataFrame) -> DataFrame:
    """Pairs of points (.., x, y) and centres (.., cx, cy, reach) no further apart than the centre's reach, with their squared distance d2.

    A centre lies in the grid whose cells are the next power of two wide, in its own cell and the eight about it, which
    hold all that it reaches. A point asks for its cell once in each grid that has centres. The two meet on (grid, cell), with the
    distance as a condition of the join, so that pairs beyond a reach are never made. A reach that is null, not a number or not above 0
    reaches nothing; one that is infinite reaches all. Rows with the same numbers stand for themselves.
    """
    good = F.col("reach").isNotNull() & ~F.isnan("reach") & (F.col("reach") > 0)
    finite = F.least(F.col("reach"), F.lit(1e300))
    c = centres.filter(good).withColumn("_level", level(finite))
    grids = sorted(r[0] for r in c.select("_level").distinct().collect())  # a number a power of two
    at = lambda name: F.floor(F.col(name) / F.pow(F.lit(2.0), F.col("_level")))
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    c = c.withColumn("_dx", around).withColumn("_dy", around).withColumn("_gx", at("cx") + F.col("_dx")).withColumn("_gy", at("cy") + F.col("_dy")).drop("_dx", "_dy")
    p = points.withColumn("_level", F.explode(F.array(*map(F.lit, grids)) if grids else F.array().cast("array<int>"))).withColumn("_gx", at("x")).withColumn("_gy", at("y"))
    d2 = F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)
    on = (p["_level"] == c["_level"]) & (p["_gx"] == c["_gx"]) & (p["_gy"] == c["_gy"]) & (d2 <= F.col("reach") * F.col("reach"))
    return p.join(c, on).select(*[p[x] for x in points.columns], *[c[x] for x in centres.columns], d2.alias("d2"))


def tail(widths: float) -> float:
    """What a bump of height 1 has left beyond `widths` of its standard deviations: what cutting it there can take from a sum, for each centre."""
    return math.exp(-widths * widths / 2)


def bumps(points: DataFrame, centres: DataFrame, widths: float = 8.0) -> DataFrame:
    """(id, y): at each point (id, x, y) the sum of amp * exp(-d2 / (2 sigma^2)) over the centres (cx, cy, sigma, amp), each cut off at `widths` * sigma; right within tail(widths) * sum |amp|. Points that nothing reaches have 0. Points at one place are asked for once."""
    near = within_reach(points.select("x", "y").distinct(), centres.select("cx", "cy", (F.col("sigma") * widths).alias("reach"), "sigma", "amp"))
    sums = near.groupBy("x", "y").agg(F.sum(F.col("amp") * F.exp(-F.col("d2") / (2.0 * F.pow("sigma", 2)))).alias("_sum"))
    return points.select("id", "x", "y").join(sums, ["x", "y"], "left").select("id", F.coalesce("_sum", F.lit(0.0)).alias("y"))
