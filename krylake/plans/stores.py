"""Raw tiles, products of tall matrices, pyramids of frames, and the sources' own rows: over embeddings, events, customer and lineitem."""

import uuid

from pyspark.sql import functions as F

from krylake.functions import fields as f
from krylake.operators import pyramid
from krylake.operators.products import gram, transposed_product
from krylake.plans.fields import XY, sensors
from krylake.plans.registry import query
from krylake.plans.tables import shared_dir, table
from krylake.sources.matrices import capabilities, sampled
from krylake.sources.points import scattered
from krylake.sources.tiles import read_tiles, write_tiles
from krylake.streaming.replay import replay

LONG = "e AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(len(embedding))) AS k FROM embeddings)"


@query("SELECT vec_id AS i, round(list_dot_product(CAST(embedding AS DOUBLE[]), list_transform(range(len(embedding)), lambda k: 1.0 + (k % 5)::DOUBLE)), 6) AS y FROM embeddings WHERE vec_id >= 100 AND vec_id < 400")
def raw_tiles(spark, sf_dir):
    """Embeddings written as raw tiles of 64 rows and read again, tiles outside the asked rows left out, times a vector."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    write_tiles(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("row")), path, 64)
    back = read_tiles(spark, path).filter((F.col("i") >= 100) & (F.col("i") < 400))
    product = F.aggregate(F.transform("row", lambda v, k: v.cast("double") * (1.0 + k % 5)), F.lit(0.0), lambda a, v: a + v)
    return back.select("i", F.round(product, 6).alias("y"))


@query(f"WITH {LONG} SELECT a.k AS i, b.k AS j, round(sum(a.v * b.v), 6) AS v FROM e a JOIN e b USING (vec_id) GROUP BY a.k, b.k")
def gram_embeddings(spark, sf_dir):
    """X'X of the embeddings."""
    g = gram(table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("row")))
    return g.select("i", "j", F.round("v", 6).alias("v"))


@query(f"WITH {LONG} SELECT k AS i, round(sum(v * (1 + label)), 6) AS v FROM e GROUP BY k")
def transposed_matvec(spark, sf_dir):
    """V'w of the embeddings and their labels."""
    e = table(spark, sf_dir, "embeddings")
    v = transposed_product(e.select(F.col("vec_id").alias("k"), F.col("embedding").cast("array<double>").alias("row")), e.select(F.col("vec_id").alias("k"), (1 + F.col("label")).alias("w")))
    return v.select("i", F.round("v", 6).alias("v"))


@query("""WITH p AS (SELECT event_type AS frame, least(floor(((user_id * 7919) % 10007)::DOUBLE / 100.07 / 100.0 * 64), 63)::INTEGER AS gx, least(floor(((event_id * 104729) % 10007)::DOUBLE / 100.07 / 100.0 * 64), 63)::INTEGER AS gy, value FROM events), l AS (SELECT unnest(range(7))::INTEGER AS level)
SELECT frame, level, gx >> (6 - level) AS gx, gy >> (6 - level) AS gy, count(*) AS n, round(sum(value), 4) AS total FROM p, l GROUP BY 1, 2, 3, 4""")
def frame_pyramid(spark, sf_dir):
    """Events as a stream of frames, one a type: counts and sums by cell at seven levels, written batch by batch and summed."""
    place = lambda c, k: ((F.col(c) * k) % 10007).cast("double") / 100.07
    s = replay(spark, sf_dir, "events").select(F.col("event_type").alias("frame"), place("user_id", 7919).alias("x"), place("event_id", 104729).alias("y"), "value")
    return pyramid.frames(s, 100.0).withColumn("total", F.round("total", 4))


UNIFORM = "((({c} * 2654435761) % 4294967296) + 0.5) / 4294967296.0"
READ = f"{XY.replace('WITH s', 'WITH s0')}, s AS (SELECT id, x, y, sqrt(-2.0 * ln({UNIFORM.format(c='(id * 2 + 1)')})) * cos(2.0 * pi() * {UNIFORM.format(c='(id * 2 + 2)')}) AS z FROM s0)"


@query(f"{READ} SELECT (id % 10)::BIGINT AS class, count(*) AS n, round(avg(0.08 * z), 6) AS mean, round(stddev_pop(0.08 * z), 6) AS spread, round(avg(15.0 + 5.0 * sin((x + y) / 20.0) + 0.08 * z), 6) AS reading FROM s GROUP BY 1")
def noisy_readings(spark, sf_dir):
    """Readings with noise of spread 0.08, a function of the sensor alone: the noise's mean and spread, and the mean reading, by class of sensors."""
    s = sensors(spark, sf_dir).withColumn("truth", f.temperature(F.col("x"), F.col("y"), F.lit(0.0)))
    s = s.withColumn("reading", f.measured(F.col("truth"), F.col("id"), source=f.lattice_normal))
    noise = F.col("reading") - F.col("truth")
    return s.groupBy((F.col("id") % 10).alias("class")).agg(F.count("*").alias("n"), F.round(F.avg(noise), 6).alias("mean"), F.round(F.stddev_pop(noise), 6).alias("spread"), F.round(F.avg("reading"), 6).alias("reading"))


@query(f"SELECT c_custkey AS id, round(100.0 * {UNIFORM.format(c='(c_custkey * 2 + 1)')}, 6) AS x, round(100.0 * {UNIFORM.format(c='(c_custkey * 2 + 2)')}, 6) AS y FROM customer")
def scattered_points(spark, sf_dir):
    """A point for each customer, a function of its number alone."""
    p = scattered(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))
    return p.select("id", F.round(F.col("p")[0], 6).alias("x"), F.round(F.col("p")[1], 6).alias("y"))


@query("WITH u AS (SELECT user_id, count(*) AS n, max(event_id) AS newest FROM events GROUP BY user_id) SELECT * FROM u ORDER BY ((user_id + 11) * 2654435761) % 4294967296, user_id LIMIT 5")
def sampled_users(spark, sf_dir):
    """Five users without replacement, and what there is of them."""
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("newest"))
    return sampled(u, "user_id", 5, by=f.lattice(F.col("user_id") + 11))


@query("SELECT '{\"fields\":[\"temperature\",\"pressure\",\"humidity\"],\"segment\":\"' || c_mktsegment || '\",\"sensors\":' || count(*) || ',\"backend\":' || CASE WHEN count(*)::DOUBLE * count(*) * 4 <= 0.6 * 4e6 THEN 0 WHEN count(*)::DOUBLE * count(*) * 4 <= 0.8 * 1e8 THEN 1 ELSE 2 END || '}' AS message FROM customer GROUP BY c_mktsegment")
def capability_messages(spark, sf_dir):
    """What each segment's client is told first."""
    n = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return capabilities({"fields": F.array(*map(F.lit, f.FIELDS)), "segment": F.col("c_mktsegment"), "sensors": F.col("n"), "backend": f.backend(F.col("n"), 4e6, 1e8)}, n)
