"""Joins beyond equality: the newest row before a moment, and ranges through buckets."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from krylake.operators.halo import SIZE, last_known


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, size: int = SIZE) -> DataFrame:
    """left with the `value` of the newest row of `right` with the same key at or before `at`: both sides are sorted together, in slices, without a join; a value that is null is passed over."""
    both = left.withColumn("_v", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("_side", F.lit(1)).unionByName(right.select(key, at, F.col(value).alias("_v")).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    return last_known(both, key, [at, "_side"], "_v", value, size).filter("_side = 1").drop("_v", "_side")


def in_range(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of points with every range (low <= at < high) that holds them: both meet in buckets of `width`."""
    cut = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("_b", F.floor(F.col(at) / width)).join(cut, "_b").filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_b")
