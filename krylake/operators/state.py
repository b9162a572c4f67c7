"""Windows over event sequences: trails, sparklines, stagnation, latest values, coalesced commands."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from krylake.operators.halo import SIZE, numbered, over_last


def last_n(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The newest n rows of each key, with their rank (1 is the newest). Ranks above n are dropped before the shuffle too."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)


def latest(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The newest row of each key by an aggregate: no window, no sort."""
    picked = rows.groupBy(key).agg(F.max(F.struct(order, *columns)).alias("m"))
    return picked.select(key, F.col(f"m.{order}").alias(order), *[F.col(f"m.{c}").alias(c) for c in columns])


def sparkline(rows: DataFrame, key: str, order: str, value: str, n: int = 80, size: int = SIZE) -> DataFrame:
    """Adds the number, mean, minimum and maximum of the last n values of a key."""

    def last(f):
        return lambda w: f.over(w.rowsBetween(-(n - 1), 0))

    return over_last(rows, key, [order], n, {"held": last(F.count("*")), "mean": last(F.avg(value)), "low": last(F.min(value)), "high": last(F.max(value))}, size)


def stagnation(rows: DataFrame, key: str, order: str, value: str, gain: float = 0.01, size: int = SIZE) -> DataFrame:
    """Adds `stalled`: the value is no more than `gain` below the one before."""
    return over_last(rows, key, [order], 2, {"stalled": lambda w: F.coalesce(F.col(value) > F.lag(value).over(w) * (1.0 - gain), F.lit(False))}, size)


def coalesced(commands: DataFrame, batch: Column, key: str, order: str, value: str) -> DataFrame:
    """(batch, key, value): of a batch's commands with one key the last wins."""
    return commands.groupBy(batch.alias("batch"), key).agg(F.max_by(value, order).alias(value))


def rotation(rows: DataFrame, key: str, order: str, slots: int, size: int = SIZE) -> DataFrame:
    """Adds the slot that each event of a key takes: the first event slot 0, and round again."""
    return numbered(rows, key, [order], "_k", size).withColumn("slot", F.col("_k") % slots).drop("_k")


def thinned(rows: DataFrame, key: str, order: str, step: int, size: int = SIZE) -> DataFrame:
    """Every step-th row of a key, from its first on."""
    return numbered(rows, key, [order], "_k", size).filter(F.col("_k") % step == 0).drop("_k")
