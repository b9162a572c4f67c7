"""Raw tiles, tall products, pyramids, sketches, table functions and variants on small tables."""

import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from krylake.operators import products, pyramid, sketches
from krylake.operators.lateral import simplified
from krylake.sources import tiles
from krylake.streaming.replay import staged, streamed


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 7)).astype(np.float32)
    return spark.createDataFrame([(int(k * 3), [float(v) for v in r]) for k, r in enumerate(x)], "i long, row array<float>").repartition(5).cache(), x


def test_tiles_round_trip(spark, rows, tmp_path):
    df, x = rows
    path = f"{tmp_path}/t"
    tiles.write_tiles(df, path, 64)
    back = {r["i"]: r["row"] for r in tiles.read_tiles(spark, path).collect()}
    assert back.keys() == {k * 3 for k in range(500)} and all(np.array_equal(np.array(back[3 * k], np.float32), x[k]) for k in range(500))
    names = glob.glob(f"{path}/*.f32")
    assert len(names) >= 8 and all(int(n.rsplit("/", 1)[1].split("-")[1]) <= 64 for n in names)
    assert sum(np.fromfile(n, "<f4").size for n in names) == x.size
    some = tiles.read_tiles(spark, path).filter((F.col("i") > 300) & (F.col("i") <= 330))
    assert sorted(r["i"] for r in some.collect()) == list(range(303, 331, 3))
    tiles.write_tiles(df.filter("i < 30").withColumn("i", F.col("i") + 10_000), path, 64)  # more rows, beside the others
    assert tiles.read_tiles(spark, path).count() == 510


def test_conditions_leave_out_tiles_and_rows(rows, tmp_path):
    df, _ = rows
    path = f"{tmp_path}/t"
    tiles.write_tiles(df, path, 50)
    every = len(tiles.Reader(path).partitions())
    r = tiles.Reader(path)
    left = list(r.pushFilters([GreaterThan(("i",), 60), LessThanOrEqual(("i",), 90), In(("i",), (63,))]))
    assert len(left) == 1 and isinstance(left[0], In)
    assert 1 <= len(r.partitions()) <= 3 < every
    assert sorted(i for t in r.partitions() for b in r.read(t) for i in b.column(0).to_pylist()) == list(range(63, 91, 3))
    r = tiles.Reader(path)
    assert list(r.pushFilters([EqualTo(("i",), 7)])) == [] and sum(b.num_rows for t in r.partitions() for b in r.read(t)) == 0


def test_tiles_of_lost_attempts_go(tmp_path):
    import pyarrow as pa

    path = f"{tmp_path}/t"
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([[1.0], [2.0], [3.0]], pa.list_(pa.float32()))], names=["i", "row"])
    w = tiles.Writer(path, False, 2)
    kept, _lost = w.write(iter([batch])), w.write(iter([batch]))
    w.commit([kept, None])
    assert sum(t.rows for t in tiles.Reader(path).partitions()) == 3 and len(kept.names) == 2


def test_products(spark, rows):
    df, x = rows
    pairs = df.select(F.col("row").cast("array<double>").alias("x"), F.transform(F.slice("row", 1, 3), lambda v: v.cast("double") * 2).alias("y"))
    want = x.astype(float).T @ (2.0 * x[:, :3].astype(float))
    for tile, fan in ((256, 32), (4, 2)):
        got = {(r["i"], r["j"]): r["v"] for r in products.crossed(pairs.unionByName(pairs.limit(1).withColumn("y", F.lit(None).cast("array<double>"))), tile, fan).collect()}
        assert len(got) == 21 and all(got[i, j] == pytest.approx(want[i, j]) for i in range(7) for j in range(3))
    assert products.crossed(pairs.limit(0)).count() == 0


def test_a_batch_replayed_changes_nothing(spark, tmp_path):
    rng = random.Random(2)
    data = [(k % 2, rng.uniform(-1, 9), rng.uniform(0, 8), None if k % 9 == 0 else float(k)) for k in range(600)]
    df = spark.createDataFrame(data, "frame long, x double, y double, value double")
    out = f"{tmp_path}/frames"
    s = streamed(spark, staged(df, F.col("x"), 4), df)
    assert pyramid.write_frames(s, out, 8.0, 3, batches=2) == 1  # stopped: the second batch is written and will be run again
    pyramid.write_frames(s, out, 8.0, 3)
    got = {tuple(r)[:4]: tuple(r)[4:] for r in pyramid.summed(spark.read.parquet(out)).collect()}
    want = {}
    for f, x, y, v in data:
        for level in range(4):
            side = 2**level
            key = (f, level, *(min(max(int(c // (8.0 / 8)), 0), 7) * side // 8 for c in (x, y)))
            n, total = want.get(key, (0, 0.0))
            want[key] = (n + 1, total + (v or 0.0))
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_sketches_merge_within_their_bounds(spark):
    df = spark.range(20000).select((F.col("id") % 5).alias("g"), (F.col("id") * 7919 % 6007).alias("k"), (F.col("id") * 31 % 20000).cast("double").alias("v"))
    days = sketches.daily(df, ["g"], "k", "v")
    r = sketches.merged(days, [], 0.9).first()
    assert r["n"] == 20000 and abs(r["distinct"] - 6007) <= r["error"] * 6007 and abs(r["quantile"] - 18000) <= r["rank_error"] * 20000
    r = sketches.merged(days.filter("g < 2"), [], 0.5).first()
    assert r["n"] == 8000 and days.count() == 5


def test_simplified_trails(spark):
    rng = random.Random(3)
    data = [(rng.choice([1, 2, None]), k, rng.choice([None, *[float(x) for x in range(10)]])) for k in range(300)]
    got = sorted(map(tuple, simplified(spark.createDataFrame(data, "u long, e long, v double").repartition(4), "u", "e", "v", 3.0).collect()), key=str)
    want = []
    for u in (1, 2, None):
        last = None
        for _, e, v in sorted((r for r in data if r[0] == u), key=lambda r: r[1]):
            if v is not None and (last is None or abs(v - last) >= 3.0):
                last = v
                want.append((u, e, v))
    assert got == sorted(want, key=str)
