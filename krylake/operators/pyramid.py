"""Frames as pyramids of tiles: counts and sums by square cells, each level from the one below."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from krylake.plans.tables import shared_dir
from krylake.streaming.replay import resumed

DEEPEST = 6  # 2 ** 6 cells a side


def levels(points: DataFrame, size: float, deepest: int = DEEPEST) -> DataFrame:
    """(frame, level, gx, gy, n, total) for points (frame, x, y, value) of the square from 0 to `size`: level 0 is one cell. Places outside belong to the nearest cell; null values count in n alone.

    The deepest level is one aggregate over the points; each level above sums four cells of the one below, so a point is shuffled once.
    """
    side = 1 << deepest
    cell = lambda c: F.greatest(F.least(F.floor(F.col(c) / size * side), F.lit(side - 1)), F.lit(0)).cast("int")
    own = points.groupBy("frame", cell("x").alias("gx"), cell("y").alias("gy")).agg(F.count("*").alias("n"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))
    up = own.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(deepest))))
    half = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.lit(deepest) - F.col("level"))).cast("int")
    return up.groupBy("frame", "level", half("gx").alias("gx"), half("gy").alias("gy")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def summed(parts: DataFrame) -> DataFrame:
    """Pyramids of parts of the points together: counts and sums add up, cell by cell."""
    return parts.groupBy("frame", "level", "gx", "gy").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def write_frames(stream: DataFrame, out: str, size: float, deepest: int = DEEPEST, batches: int | None = None) -> int:
    """Writes the pyramid of each micro-batch of a stream (frame, x, y, value) under its number in `out`: a batch that is run again, after a restart, replaces its own tiles and no others."""
    return resumed(stream, out, each=lambda df, _: levels(df, size, deepest), batches=batches)


def frames(stream: DataFrame, size: float, deepest: int = DEEPEST) -> DataFrame:
    """The pyramid of all that a stream gives until its input ends."""
    import uuid

    out = f"{shared_dir(stream.sparkSession)}/{uuid.uuid4().hex}"
    write_frames(stream, out, size, deepest)
    return summed(stream.sparkSession.read.parquet(out))
