"""Windows over the rows of a key without a task that holds the key: slices with halos.

Rows are sorted into partitions of bounded size by (key, order): a partition is a slice, and a key with many
rows spans several. What a row asks of rows before its slice is little, and is carried in: the last n - 1 rows,
the number of rows, or the last value that isn't null. Only the last key of a slice can go on in a later one,
so what is carried are a few rows a slice.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from krylake.plans.tables import written

SIZE = 1 << 20  # rows of a slice, about


@dataclass
class Sliced:
    """`rows` with `_slice`; `parts`: (key, _slice, n, base): rows of a key in a slice, and in those before it."""

    rows: DataFrame
    key: str
    order: list[str]
    parts: DataFrame

    def within(self) -> WindowSpec:
        return Window.partitionBy(self.key, "_slice").orderBy(*self.order)


def sliced(rows: DataFrame, key: str, order: list[str], size: int = SIZE) -> Sliced:
    """Written once: the ranges come from a sample, and every use has to see the same ones. Null keys are one key."""
    n = max(1, -(-rows.count() // size))
    own = written(rows.repartitionByRange(n, key, *order).withColumn("_slice", F.spark_partition_id()))
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = own.groupBy(key, "_slice").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return Sliced(own, key, order, parts)


def joined(rows: DataFrame, parts: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows with what `parts` has of their key and slice, null keys too."""
    other = parts.withColumnRenamed(key, "_key").withColumnRenamed("_slice", "_of")
    return rows.join(other, rows[key].eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_of")), how).drop("_key", "_of")


def haloed(s: Sliced, reach: int) -> DataFrame:
    """The rows of all slices, with `_halo`, and before those of a key in a slice the last `reach` rows that the key has in earlier slices."""
    after = Window.partitionBy(s.key).orderBy("_slice").rowsBetween(1, reach)  # each of them holds a row at least
    follow = s.parts.withColumn("_next", F.collect_list(F.struct(F.col("_slice").alias("slice"), F.col("base").alias("base"))).over(after)).filter(F.size("_next") > 0)
    last = joined(s.rows, follow, s.key).withColumn("_rank", F.row_number().over(s.within())).filter(F.col("n") - F.col("_rank") < reach)
    at = F.col("base") + F.col("_rank")  # the row's number in its key, from 1
    carried = last.withColumn("_to", F.explode(F.filter("_next", lambda x: (at <= x["base"]) & (at > x["base"] - reach))))
    halo = carried.withColumn("_slice", F.col("_to.slice")).select(*s.rows.columns, F.lit(True).alias("_halo"))
    return s.rows.withColumn("_halo", F.lit(False)).unionByName(halo)


def over_last(rows: DataFrame, key: str, order: list[str], n: int, columns: dict[str, Callable[[WindowSpec], Column]], size: int = SIZE) -> DataFrame:
    """Adds columns(window) where the window is a row and up to n - 1 rows of its key before it. `order` names a row of a key."""
    s = sliced(rows, key, order, size)
    w = s.within()
    out = haloed(s, n - 1)
    for name, made in columns.items():
        out = out.withColumn(name, made(w))
    return out.filter(~F.col("_halo")).drop("_halo", "_slice")


def numbered(rows: DataFrame, key: str, order: list[str], name: str, size: int = SIZE) -> DataFrame:
    """Adds a row's number in its key, from 0."""
    s = sliced(rows, key, order, size)
    inside = s.rows.withColumn("_rank", F.row_number().over(s.within()) - 1)
    return joined(inside, s.parts, s.key).withColumn(name, (F.col("base") + F.col("_rank")).cast("long")).drop("_rank", "n", "base", "_slice")


def last_known(rows: DataFrame, key: str, order: list[str], value: str, name: str, size: int = SIZE) -> DataFrame:
    """Adds the last `value` that isn't null of a key, up to the row."""
    s = sliced(rows, key, order, size)
    ends = s.rows.filter(F.col(value).isNotNull()).groupBy(key, "_slice").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = joined(s.parts.select(key, "_slice"), ends, key, "left").withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).filter("_carried IS NOT NULL")
    own = F.last(value, ignorenulls=True).over(s.within().rowsBetween(Window.unboundedPreceding, 0))
    return joined(s.rows.withColumn("_own", own), carry.drop("_last"), key, "left").withColumn(name, F.coalesce("_own", "_carried")).drop("_own", "_carried", "_slice")
