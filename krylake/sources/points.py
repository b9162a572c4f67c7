"""Point sets, grids, polylines and row blocks."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from krylake.functions.fields import CITY, clip, lattice, linspace, normal, uniform


def synthetic(spark: SparkSession, n: int, dims: int = 2, seed: int = 42, scale: float = 100.0) -> DataFrame:
    """(id, p): n points in [0, scale)^dims, a function of id and seed alone."""
    return spark.range(n).select("id", F.array(*[scale * uniform(F.col("id"), F.lit(seed), F.lit(d)) for d in range(dims)]).alias("p"))


def scattered(ids: DataFrame, scale: float = 100.0) -> DataFrame:
    """(id, p): a point in the square for each id of a table, a function of the id alone."""
    return ids.select("id", F.array(scale * lattice(F.col("id") * 2 + 1), scale * lattice(F.col("id") * 2 + 2)).alias("p"))


def grid(spark: SparkSession, nx: int, ny: int, lo: float = 0.0, hi: float = CITY) -> DataFrame:
    """(gy, gx, x, y): row by row, both ends included."""
    cell = spark.range(nx * ny).select((F.floor(F.col("id") / nx)).cast("int").alias("gy"), (F.col("id") % nx).cast("int").alias("gx"))
    return cell.select("gy", "gx", linspace(F.col("gx"), nx, lo, hi).alias("x"), linspace(F.col("gy"), ny, lo, hi).alias("y"))


def densify(lines: DataFrame, line: str, seq: str, x: str, y: str, spacing: float) -> DataFrame:
    """(line, seq, k, x, y): the polyline's points, with more between so that none are over `spacing` apart."""
    w = Window.partitionBy(line).orderBy(seq)
    ends = lines.select(line, seq, x, y, F.lag(x).over(w).alias("_x"), F.lag(y).over(w).alias("_y"))
    far = F.sqrt(F.pow(F.col(x) - F.col("_x"), 2) + F.pow(F.col(y) - F.col("_y"), 2))
    parts = F.greatest(F.lit(1), F.ceil(far / spacing)).cast("int")
    steps = ends.withColumn("_n", F.coalesce(parts, F.lit(1))).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    at = lambda a, b: F.when(F.col(b).isNull(), F.col(a)).otherwise(F.col(b) + (F.col(a) - F.col(b)) * (F.col("k") / F.col("_n")))
    return steps.select(line, seq, F.col("k").cast("long").alias("k"), at(x, "_x").alias("x"), at(y, "_y").alias("y"))


def fleet(roads: DataFrame, n: int, seed: int = 0, jitter: float = 1.5) -> DataFrame:
    """(id, x, y): vehicles about road points (pid 0..count-1, x, y), `jitter` apart, inside the square."""
    count = roads.count()
    chosen = roads.sparkSession.range(n).withColumn("pid", F.floor(uniform(F.col("id"), F.lit(seed)) * count))
    near = lambda c, s: clip(F.col(c) + jitter * normal(F.col("id"), F.lit(seed), F.lit(s)), 0.0, CITY).alias(c)
    return chosen.join(roads.select("pid", "x", "y"), "pid").select("id", near("x", "x"), near("y", "y"))


def advanced(vehicles: DataFrame, congestion: Column, step: int, seed: int = 0, std: float = 0.35, pull: float = 0.0003) -> DataFrame:
    """Vehicles (id, x, y) after a random step, slower in congestion, with a drift to the centre, inside the square."""
    noise = lambda s: std * (1.0 - 0.85 * congestion) * normal(F.col("id"), F.lit(step), F.lit(seed), F.lit(s))
    move = lambda c: clip(F.col(c) + noise(c) + (CITY / 2 - F.col(c)) * pull, 0.0, CITY).alias(c)
    return vehicles.select("id", move("x"), move("y"))


def customer_sensors(customers: DataFrame) -> DataFrame:
    """(id, x, y): a well-spread layout of the table customer over the square."""
    place = lambda f: ((F.col("c_custkey") * f) % 10007).cast("double") / 100.07
    return customers.select(F.col("c_custkey").alias("id"), place(7919).alias("x"), place(104729).alias("y"))
