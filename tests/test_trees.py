"""Gaussian sums by cells, joins within a reach, nearest neighbours and polygons by split cells: equal to all pairs, in work that follows the points and not their pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from krylake.operators import quadtree, tree_sums
from krylake.operators.reach import bumps, tail, within_reach
from krylake.operators.spatial import inside


def crowd(rng, n):
    """Half of the points in a corner a ten-thousandth wide, some of them at one place, the others spread."""
    return [(rng.uniform(0, 0.01), rng.uniform(0, 0.01)) if k % 2 else (3e-3, 3e-3) if k % 8 == 0 else (rng.uniform(0, 100), rng.uniform(-50, 50)) for k in range(n)]


def frame(spark, at, first=0):
    return spark.createDataFrame([(first + i, [float(x), float(y)]) for i, (x, y) in enumerate(at)], "id long, p array<double>")


@pytest.mark.parametrize("gamma", [1e-4, 0.05, 3.0])
def test_gaussian_sums(spark, gamma):
    rng = random.Random(1)
    t, s = crowd(rng, 150), crowd(rng, 400)
    w = [rng.uniform(-1, 2) for _ in s]
    src = spark.createDataFrame([(i, [float(x), float(y)], v) for i, ((x, y), v) in enumerate(zip(s, w, strict=True))], "id long, p array<double>, w double")
    a, b = np.array(t), np.array(s)
    want = np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(axis=2)) @ np.array(w) + 0.5 * np.array(w)[: len(t)]
    for nodes, far, rows in ((16, 6, 1 << 16), (10, 4, 20)):
        got = {r["id"]: r["y"] for r in tree_sums.gaussian_sums(frame(spark, t), src, gamma, "w", reg=0.5, nodes=nodes, far=far, rows=rows).collect()}
        assert len(got) == len(t) and max(abs(got[i] - want[i]) for i in got) <= tree_sums.tolerance(nodes, far) * sum(map(abs, w)) + 1e-12
    assert tree_sums.tolerance() < 1e-11


def test_gaussian_sums_without_sources_or_targets(spark):
    p = frame(spark, [(1, 2), (3, 4)]).withColumn("w", F.lit(1.0))
    assert [r["y"] for r in tree_sums.gaussian_sums(p, p.limit(0), 1.0, "w").collect()] == [0.0, 0.0]
    assert tree_sums.gaussian_sums(p.limit(0), p, 1.0, "w").count() == 0


def test_moves_do_not_grow_with_the_points_of_a_cell(spark):
    rng = random.Random(2)
    few, many = (frame(spark, [(rng.uniform(0, 20), rng.uniform(0, 20)) for _ in range(n)]) for n in (4000, 8000))
    a, b = (tree_sums.work(p, p, 0.25).first() for p in (few, many))
    assert b["pairs"] == 4 * a["pairs"] and b["moves"] <= 1.05 * a["moves"] and a["moves"] < a["pairs"] / 1000


def test_within_reach(spark):
    rng = random.Random(3)
    p = [(i, rng.uniform(-10, 10), rng.uniform(-10, 10)) for i in range(120)] + [(500, 0.0, 0.0)]
    c = [(i, rng.uniform(-10, 10), rng.uniform(-10, 10), rng.choice([0.01, 0.5, 1.0, 2.0, 3.7, 16.0])) for i in range(60)] + [(90, 0.0, 0.0, None), (91, 0.0, 0.0, 0.0), (92, 0.0, 0.0, -1.0), (93, 5.0, 5.0, math.inf), (94, 0.0, 0.0, math.nan), (95, 3.0, 4.0, 5.0)]
    got = within_reach(spark.createDataFrame(p, "id long, x double, y double"), spark.createDataFrame(c, "c long, cx double, cy double, reach double")).collect()
    want = {(i, j) for i, x, y in p for j, cx, cy, r in c if r and r > 0 and (x - cx) ** 2 + (y - cy) ** 2 <= r * r}
    assert len(got) == len(want) and {(r["id"], r["c"]) for r in got} == want and (500, 95) in want


def test_bumps(spark):
    rng = random.Random(4)
    p = [(i, rng.uniform(0, 50), rng.uniform(0, 50)) for i in range(80)]
    c = [(rng.uniform(0, 50), rng.uniform(0, 50), rng.choice([0.1, 1.0, 6.0]), rng.uniform(-1, 1)) for _ in range(50)]
    frames = spark.createDataFrame(p, "id long, x double, y double"), spark.createDataFrame(c, "cx double, cy double, sigma double, amp double")
    for widths in (2.0, 8.0):
        got = {r["id"]: r["y"] for r in bumps(*frames, widths).collect()}
        for i, x, y in p:
            assert abs(got[i] - sum(a * math.exp(-((x - u) ** 2 + (y - v) ** 2) / (2 * s * s)) for u, v, s, a in c)) <= tail(widths) * sum(abs(a) for *_, a in c) + 1e-12
    assert {r["y"] for r in bumps(frames[0], frames[1].limit(0)).collect()} == {0.0}


def test_nearest_in_a_crowd(spark, monkeypatch):
    """All but a few targets in one corner, repeated ones too: right, with some cells a query and level and not all targets."""
    rng = random.Random(5)
    q, t = crowd(rng, 200), [(rng.uniform(0, 1e-3), rng.uniform(0, 1e-3)) for _ in range(3000)] + [(5e-4, 5e-4)] * 500 + [(99.0, 40.0)]
    met = []
    monkeypatch.setattr(quadtree, "visited", lambda d: met.append(d) or d)
    got = {r["id"]: (r["nearest_id"], r["distance"]) for r in quadtree.nearest(frame(spark, q), frame(spark, t, 7)).collect()}
    a, b = np.array(q), np.array(t)
    d2 = (a[:, None, 0] - b[None, :, 0]) ** 2 + (a[:, None, 1] - b[None, :, 1]) ** 2
    assert all(got[i] == (int(np.argmin(d2[i])) + 7, pytest.approx(math.sqrt(d2[i].min()))) for i in range(len(q))) and len(got) == len(q)
    assert met[0].agg(F.max("level")).first()[0] >= 8 and len(q) <= met[0].count() <= 8 * len(q)


def test_polygons_by_cover(spark):
    """Concave and many-sided polygons; points of whole cells aren't tested."""
    rng = random.Random(6)
    star = [(50 + (20 + 15 * (k % 2)) * math.cos(k * math.pi / 12), 30 + (20 + 15 * (k % 2)) * math.sin(k * math.pi / 12)) for k in range(24)]
    shapes = [star, [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (4.0, 3.0), (0.0, 8.0)], [(90.0, 90.0), (90.5, 90.0), (90.2, 95.0)], [(1.0, 1.0), (2.0, 2.0)]]
    polygons = spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in s],) for s in shapes], "corners array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(i, rng.uniform(-5, 105), rng.uniform(-10, 105)) for i in range(3000)], "id long, x double, y double")
    each = points.crossJoin(polygons.filter("size(corners) > 2")).withColumn("h", inside(F.col("x"), F.col("y"), F.col("corners"))).groupBy("id").agg(F.max("h").alias("h"))
    want = {r["id"]: r["h"] for r in each.collect()}
    got = {r["id"]: r["interior"] for r in quadtree.masked(points, polygons).collect()}
    assert got == want and 0 < sum(got.values()) < 3000
    x, y = (np.array(c) for c in zip(*star, strict=True))
    size = abs(np.sum(x * np.roll(y, -1) - y * np.roll(x, -1))) / 2
    for halvings, share in ((5, 0.5), (8, 0.9)):
        k, _, _, whole = quadtree.cover(x, y, halvings)
        assert share * size < (4.0 ** k[whole]).sum() <= size
    assert quadtree.masked(points.limit(5), polygons.limit(0)).filter("interior").count() == 0
