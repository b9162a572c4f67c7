"""Rows behind the watermark: told apart from those in time instead of being dropped without a word."""

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from krylake.plans.tables import shared_dir
from krylake.streaming.replay import resumed


def slice_of(at: Column, origin: str, hours: int) -> Column:
    """The number of the span of `hours` since `origin` in which a time lies."""
    return F.floor((F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.lit(origin).cast("timestamp"))) / (hours * 3_600_000_000)).cast("long")


def calendar(rows: DataFrame, at: str, origin: str, hours: int) -> list[int]:
    """Numbers of all spans that have rows but the first: where the slices of a replay end."""
    return sorted(r[0] for r in rows.select(slice_of(F.col(at), origin, hours).alias("s")).distinct().collect())[1:]


def split(stream: DataFrame, at: str, seconds: int) -> DataFrame:
    """The rows of a stream with `late`: whether their time is over `seconds` behind the newest of all batches before theirs.

    The mark of each batch is a row of a table by batch number: a batch that is run again, after a restart too, finds the marks
    of those before it, writes its own anew and gives the same rows.
    """
    spark = stream.sparkSession
    out = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    marks = f"{out}-marks"

    def each(df: DataFrame, n: int) -> DataFrame:
        known = "batch long, newest timestamp"
        before = spark.read.schema(known).parquet(marks).filter(F.col("batch") < n) if n else spark.createDataFrame([], known)
        df.agg(F.max(at).alias("newest")).write.mode("overwrite").parquet(f"{marks}/batch={n}")
        mark = before.agg((F.max("newest") - F.make_dt_interval(secs=F.lit(seconds))).alias("_mark"))
        return df.join(F.broadcast(mark)).withColumn("late", F.coalesce(F.col(at) < F.col("_mark"), F.lit(False))).drop("_mark")

    resumed(stream, out, each=each)
    return spark.read.parquet(out)
