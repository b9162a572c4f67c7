"""Tables as streams: rows handed on in the order of their time, whatever files they lie in; stopped and resumed queries."""

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from krylake.plans.tables import shared_dir, table

SLICES = 4
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def staged(rows: DataFrame, order: Column, slices: int = SLICES, bounds: list | None = None) -> str:
    """A folder with `rows` in files that follow each other by `order`, their times of modification too, so that a stream takes them one after another.

    bounds: where a slice ends (exclusive), in ascending order; without them a sample of `rows` gives ranges of about equal size. Every file is one slice's.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    if bounds is None:
        dealt = rows.withColumn("_at", order).repartitionByRange(slices, "_at")
    else:
        number = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= order)) if bounds else F.lit(0)
        dealt = rows.withColumn("_at", number).repartitionByRange(len(bounds) + 1, "_at")
    dealt.drop("_at").write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().toString() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    now = fs.getFileStatus(folder).getModificationTime()
    for k, name in enumerate(names):  # parts are numbered by range
        fs.setTimes(spark._jvm.org.apache.hadoop.fs.Path(name), now - 1000 * (len(names) - k), -1)
    return path


def streamed(spark: SparkSession, path: str, like: DataFrame, files: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def replay(spark: SparkSession, sf_dir: str, name: str, slices: int = SLICES, arrives: Column | None = None, bounds: list | None = None) -> DataFrame:
    """A table as a stream of slices by its time `ts` (or by when its rows arrive), whatever files it lies in: no row comes behind a later slice's."""
    rows = table(spark, sf_dir, name)
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows
    return streamed(spark, staged(rows, F.col("ts") if arrives is None else arrives, slices, bounds), rows)


def drained(stream: DataFrame, mode: str = "append", each: Callable | None = None) -> DataFrame:
    """Everything a stream gives until its input ends, as a table in the shared folder. `each` (frame, batch id) makes a batch's rows of the table; a batch that is run again replaces them."""
    spark = stream.sparkSession
    out = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    if resumed(stream, out, mode, each) < 0 and each is None:
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(out)


def resumed(stream: DataFrame, out: str, mode: str = "append", each: Callable | None = None, batches: int | None = None) -> int:
    """Runs a stream into the table `out` from where an earlier run left it, until its input ends or `batches` have been taken; the number of the last batch.

    Progress and state lie beside the table: a run that was stopped, or whose driver was lost, goes on there, and no row counts twice.
    """
    taken = []

    def write(df: DataFrame, n: int) -> None:
        (each(df, n) if each else df).write.mode("overwrite").parquet(f"{out}/batch={n}")
        taken.append(n)
        if batches and len(taken) >= batches:
            raise Stop

    conf, store = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(store, None)
    conf.set(store, ROCKS)  # what typed state asks for; a query keeps the store that it began with
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).foreachBatch(write).start()
    finally:
        conf.unset(store) if before is None else conf.set(store, before)
    try:
        query.awaitTermination()
    except Exception:
        if not (batches and len(taken) >= batches):
            raise
    return max(taken, default=-1)


class Stop(Exception):
    """Ends a run in the middle: its last batch has been written but not been recorded as done, as when a driver is lost."""
