"""What the operators share: reading tables, cutting lineage, ranks without large windows, byte tables."""

import functools
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Python workers started from now on can import this package, whatever folder the driver started in."""
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset on one machine (tests), one of our own. A cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="krylake-")
        found = _own_dirs[app]
    return found.rstrip("/")


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """`df` as a table in the shared folder: executors may be lost afterwards without recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._krylake_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what written() made, once nothing reads it any more."""
    if path := getattr(df, "_krylake_path", None):
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def hot_keys(rows: DataFrame, key: str, most: int = 1024) -> DataFrame:
    """The keys with more than 1/most of all rows: fewer than `most`, whatever the table's size."""
    total = rows.count()
    return written(rows.groupBy(key).agg(F.count("*").alias("_c")).filter(F.col("_c") * most > total).select(key))


def split_join(rows: DataFrame, groups: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with groups (a row a key at most): those of the keys `hot` by a broadcast, which spreads their rows over all tasks, the others by a shuffle."""
    few = F.broadcast(hot)
    own = F.broadcast(groups.join(few, key, "left_semi"))
    return rows.join(few, key, "left_semi").join(own, key, how).unionByName(rows.join(few, key, "left_anti").join(groups.join(few, key, "left_anti"), key, how))


def ranked(df: DataFrame, keys: list[str], order: str, name: str, salts: int = 64, weight: str | None = None, by: Column | None = None) -> DataFrame:
    """Adds the rank (from 0) of each row within `keys`, or the sum of `weight` over the rows before it.

    No window holds more than about 1/salts of a key's rows: rows are numbered within salted
    parts, and the parts' totals are summed over at most `salts` rows a key. `order` is unique. Rows
    with the same `by` (default: `order`) are of one part, and so get neighbouring ranks.
    """
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    parts = df.withColumn("_salt", F.pmod(F.xxhash64(order, F.lit(17)) if by is None else by, F.lit(salts)).cast("int"))
    totals = parts.groupBy(*keys, "_salt").agg(F.sum(w).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_salt").alias("_s"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_salt").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = parts.withColumn("_own", F.coalesce(F.sum(w).over(inside), F.lit(0)))
    on = (F.col("_salt") == F.col("_s")) & functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))
    return numbered.join(starts, on).withColumn(name, F.col("_start") + F.col("_own")).drop("_salt", "_s", "_start", "_own", *[f"_k{i}" for i in range(len(keys))])


def lowered(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased, nothing else; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def annotated(docs: DataFrame, fields: str, answer) -> DataFrame:
    """`docs` with more columns (DDL `fields`): answer(doc_ids, texts) gives a list for each; texts come a few at a time."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        found = answer()
        for b in batches:
            for at in range(0, b.num_rows, 64):
                own = b.slice(at, 64)
                more = found(own.column("doc_id").to_pylist(), own.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array(c) for c in more]], names=[*own.schema.names, *names])

    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns])
    return base.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields], fields]))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shifts and odd multipliers), vectorised."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x
