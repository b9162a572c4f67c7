import math

import pytest
from pyspark.sql import functions as F

from krylake.functions import fields as f
from krylake.operators.blocks import kernel_apply
from krylake.operators.quadtree import nearest
from krylake.operators.spatial import ellipse_panels, rect_panels, wave_power
from krylake.sources.points import advanced, fleet, grid, synthetic


def test_incident_strength(spark):
    rows = [(0.0, 10.0, 5.0), (0.0, 10.0, 9.0), (0.0, 10.0, 10.0), (0.0, -1.0, 1e6), (0.0, 0.0, 0.0), (5.0, 10.0, 1.0)]
    d = spark.createDataFrame(rows, "t_start double, duration double, t double")
    got = [r[0] for r in d.select(f.incident_strength(F.col("t"), F.col("t_start"), F.col("duration"))).collect()]
    assert got == pytest.approx([1.0, 0.5, 0.0, 1.0, 0.0, 0.0])


def test_unknown_field():
    with pytest.raises(ValueError):
        f.sensor_field("salinity", None, None, None)


def test_points_do_not_depend_on_partitions(spark):
    a = synthetic(spark, 200).orderBy("id").collect()
    assert a == synthetic(spark, 200).repartition(7).orderBy("id").collect() and all(0 <= v < 100 for r in a for v in r["p"])


def test_noise_is_standard(spark):
    m, s = spark.range(20000).select(F.avg(f.normal(F.col("id"))), F.stddev(f.normal(F.col("id")))).first()
    assert abs(m) < 0.03 and abs(s - 1) < 0.03


def test_grid_includes_its_ends(spark):
    g = grid(spark, 4, 3)
    assert g.count() == 12 and g.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()[:] == (0.0, 100.0, 0.0, 100.0)


def test_fleet_stays_in_the_square(spark):
    roads = spark.createDataFrame([(0, 1.0, 1.0), (1, 99.0, 99.0)], "pid long, x double, y double")
    v = advanced(fleet(roads, 50), F.lit(0.5), 1)
    assert v.count() == 50 and v.filter("x < 0 OR x > 100 OR y < 0 OR y > 100").isEmpty()


def test_panels(spark):
    r = rect_panels(spark.createDataFrame([(1, 0.0, 0.0, 2.0, 1.2)], "id int, cx double, cy double, w double, h double"), 60)
    assert r.agg(F.sum("len")).first()[0] == pytest.approx(6.4)
    e = ellipse_panels(spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], "id int, cx double, cy double, a double, b double"), 200)
    assert e.agg(F.sum("len")).first()[0] == pytest.approx(2 * math.pi, rel=1e-3)
    assert e.filter("abs(nx * nx + ny * ny - 1) > 1e-9 OR nx * x + ny * y < 0").isEmpty()


def test_wave_power(spark):
    d = lambda rows: wave_power(spark.createDataFrame(rows, "re double, im double, inc_re double, inc_im double, interior boolean")).first()[:]
    assert d([(0.6, 0.8, 0.6, 0.8, False)]) == pytest.approx((1.0, 0.0))
    assert d([(0.0, 0.0, 0.6, 0.8, False)]) == pytest.approx((0.0, 1.0))
    assert d([(1.0, 1.0, 1.0, 0.0, True)]) == (1.0, 1.0)
    assert d([(1e3, 0.0, 1.0, 0.0, False)])[0] == 200.0


@pytest.mark.parametrize("rows", [3, 1024])
def test_blocks_do_not_change_results(spark, rows):
    import numpy as np

    p = synthetic(spark, 20, scale=3.0).withColumn("v", F.col("id").cast("double"))
    got = {r["id"]: r["y"] for r in kernel_apply(p, p, lambda a, b: a @ b.T, "v", rows=rows).collect()}
    x = np.array([r["p"] for r in p.orderBy("id").collect()])
    assert [got[i] for i in range(20)] == pytest.approx((x @ x.T @ np.arange(20.0)).tolist())
    near = nearest(p, p).collect()
    assert len(near) == 20 and all(r["id"] == r["nearest_id"] and r["distance"] == 0 for r in near)


def test_nearest_through_the_grid(spark):
    """Far queries, ties and a dense cluster; no targets give no rows."""
    q = [(i, [float(i * 37 % 101) * 3 - 60, float(i * 53 % 97)]) for i in range(200)]
    t = [(i, [float(i % 7), float(i % 5)]) for i in range(60)] + [(99, [250.0, 90.0])]
    a, b = (spark.createDataFrame(x, "id long, p array<double>") for x in (q, t))
    got = {r["id"]: (r["distance"], r["nearest_id"]) for r in nearest(a, b).collect()}
    want = {i: min((math.dist(p, o), j) for j, o in t) for i, p in q}
    assert got.keys() == want.keys() and all(got[i][1] == want[i][1] and got[i][0] == pytest.approx(want[i][0]) for i in want)
    assert nearest(a, b.limit(0)).count() == 0
