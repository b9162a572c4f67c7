"""Work that grows with the input alone, and results that don't depend on how they are found."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from krylake.functions.kernels import bem_block, rbf_block
from krylake.operators import blocks, krylov, linear, reach, regression
from krylake.operators.tree_sums import gaussian_sums
from krylake.plans import catalogue, reaches
from tests.conftest import SF


def without_pairs(spark, duck, monkeypatch, name):
    """The query gives its SQL's rows although no pairs of blocks can be made."""

    def never(*_, **__):
        raise AssertionError("all pairs of blocks")

    monkeypatch.setattr(blocks, "pairwise", never)
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    cols = sorted(want.columns)
    a, b = (d[cols].astype(str).sort_values(cols).reset_index(drop=True) for d in (got, want))
    assert len(a) and a.equals(b)


def test_incident_field_by_cells(spark, duck, monkeypatch):
    without_pairs(spark, duck, monkeypatch, "incident_field")


def test_gammas_of_their_own(spark):
    """Sources of three widths, a target far off, no sources at all, a gamma of 0."""
    rng = random.Random(8)
    p = [(i, [rng.uniform(0, 50), rng.uniform(0, 50)]) for i in range(80)] + [(99, [1e4, 1e4])]
    c = [([rng.uniform(0, 50), rng.uniform(0, 50)], rng.choice([0.02, 0.3, 4.0]), rng.uniform(-1, 1)) for _ in range(60)]
    t, s = spark.createDataFrame(p, "id long, p array<double>"), spark.createDataFrame(c, "p array<double>, gamma double, w double")
    got = {r["id"]: r["y"] for r in gaussian_sums(t, s, "gamma", "w").collect()}
    assert len(got) == len(p)
    for i, a in p:
        assert abs(got[i] - sum(w * math.exp(-g * ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2)) for b, g, w in c)) < 1e-10
    assert {r["y"] for r in gaussian_sums(t, s.limit(0), "gamma", "w").collect()} == {0.0}
    with pytest.raises(ValueError):
        gaussian_sums(t, s.selectExpr("p", "0.0 AS gamma", "w"), "gamma", "w")


def test_incident_field_own_radius_by_cells(spark, duck, monkeypatch):
    without_pairs(spark, duck, monkeypatch, "incident_field_own_radius")


def test_points_at_one_place_meet_centres_once(spark, monkeypatch):
    """400 points at two places, a null one: as many rows as places in reach, and every point its sum."""
    made = []
    monkeypatch.setattr(reach, "within_reach", lambda p, c, f=reach.within_reach: made.append(f(p, c)) or made[-1])
    points = spark.range(400).selectExpr("id", "if(id = 7, null, id % 2 * 3.0) AS x", "1.0D AS y").selectExpr("id", "double(x) AS x", "y")
    centres = spark.createDataFrame([(0.0, 1.0, 1.0, 2.0), (3.0, 1.0, 1.0, 5.0)], "cx double, cy double, sigma double, amp double")
    got = {r["id"]: r["y"] for r in reach.bumps(points, centres).collect()}
    far = math.exp(-4.5)
    assert made[0].count() == 4 and len(got) == 400 and got[7] == 0.0
    assert all(got[i] == pytest.approx((5 + 2 * far) if i % 2 else (2 + 5 * far), abs=1e-12) for i in range(400) if i != 7)


def test_coupled_panels_by_cells(spark, duck, monkeypatch):
    without_pairs(spark, duck, monkeypatch, "coupled_panels")


def test_pairs_in_reach_are_counted_by_place(spark, monkeypatch, tmp_path):
    """Customers whose keys differ by 10007 stand at one place: twice the pairs, from as many rows of the join."""
    for k in (1, 2):
        c = spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey")
        c.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).selectExpr("c_custkey + 10007 * k AS c_custkey").write.parquet(f"{tmp_path}/{k}/customer.parquet")
        spark.read.parquet(f"{SF}/events.parquet").write.parquet(f"{tmp_path}/{k}/events.parquet")
    made = []
    monkeypatch.setattr(reaches, "within_reach", lambda p, c, f=reach.within_reach: made.append(f(p, c)) or made[-1])
    one, two = ({r["sigma"]: r["pairs"] for r in catalogue.QUERIES["incident_reach_pairs"](spark, f"{tmp_path}/{k}").collect()} for k in (1, 2))
    assert sum(one.values()) and two == {s: 2 * n for s, n in one.items()} and made[0].count() == made[1].count()


def test_gp_reconstruct_by_cells(spark, duck, monkeypatch):
    without_pairs(spark, duck, monkeypatch, "gp_reconstruct")


def test_a_side_is_sent_as_often_as_there_are_groups(spark, monkeypatch):
    """13 blocks against 9 in 3 groups a side: all pairs once, a row a point and task, and each block in three tasks."""
    monkeypatch.setattr(blocks, "SIDE", 3)
    rng = np.random.default_rng(3)
    a, b = rng.random((200, 4)), rng.random((140, 4))
    frame = lambda x: spark.createDataFrame([(i, p.tolist(), float(i)) for i, p in enumerate(x)], "id long, p array<double>, v double")

    def answer(li, lp, ri, rp, v):
        return pd.DataFrame({"id": li, "n": len(ri), "total": rbf_block(1.0)(lp, rp) @ v})

    rows = blocks.pairwise(frame(a), frame(b), answer, "id long, n long, total double", "v", 16, {"n": "sum", "total": "sum"}).toPandas()
    assert len(rows) == 3 * len(a) and set(rows.groupby("id")["n"].sum()) == {len(b)}
    assert np.allclose(rows.groupby("id")["total"].sum().sort_index(), rbf_block(1.0)(a, b) @ np.arange(140.0))
    assert blocks.pairwise(frame(a), frame(b).limit(0), answer, "id long, n long, total double", "v", 16).count() == 0


def test_near_and_equal_points_keep_their_distance():
    """Distances of 1e-7 beside lengths of 100: by products alone their root would be off by 1e-6 and more."""
    rng = np.random.default_rng(5)
    a = 100 * rng.random((40, 8))
    b = np.concatenate([a + 1e-7 * rng.random(a.shape), a])
    want = 1.0 / (1.0 + np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)))
    assert np.abs(bem_block(a, b) - want).max() < 1e-11


@pytest.mark.parametrize("store", ["auto", "recompute", "cache", "parquet"])
def test_products_hold_a_tile_at_a_time(spark, monkeypatch, tmp_path, store):
    """No task is given a whole row of the kernel; by itself, an operator that doesn't fit the driver isn't stored."""
    monkeypatch.setattr(linear, "LOCAL", 1)
    rng = np.random.default_rng(7)
    p, x = rng.random((5000, 3)), rng.random(5000)

    def kernel(a, b):
        if len(a) * len(b) > 512 * 2048:
            raise ValueError("whole rows")
        return rbf_block(2.0)(a, b)

    op = linear.kernel_operator(spark, p, kernel, 0.1, store, str(tmp_path / "tiles"))
    want = rbf_block(2.0)(p, p) @ x + 0.1 * x
    assert isinstance(op, linear.RecomputeOp) == (store in ("auto", "recompute"))
    assert np.allclose(op.matvec32(x), want, rtol=1e-4) and np.allclose(op.matvec64(np.stack([x, -x], 1)), np.stack([want, -want], 1))


def test_many_sides_without_a_factor(spark, monkeypatch):
    """More points than a factor is made for, more sides than share a product, one side all zero."""
    monkeypatch.setattr(regression, "FACTOR", 10)
    monkeypatch.setattr(regression, "GROUP", 2)
    rng = np.random.default_rng(9)
    p, sides = rng.random((60, 3)), np.concatenate([rng.random((4, 60)), np.zeros((1, 60))])
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(p)], "id long, p array<double>")
    rhs = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(sides)], "k long, values array<double>")
    got = {r["k"]: r for r in regression.solve_many(points, rhs, ["k"], 2.0, 0.1).collect()}
    a = rbf_block(2.0)(p, p) + 0.1 * np.eye(60)
    assert len(got) == 5 and all(np.allclose(a @ got[k]["weights"], x) and got[k]["rel_res"] < 1e-10 for k, x in enumerate(sides))


def test_residuals_of_conjugate_gradients_may_grow():
    """Ill-conditioned as a kernel of many points is: the residual grows at first, which is no end."""
    p = np.random.default_rng(1).normal(size=(1200, 16))
    p /= np.linalg.norm(p, axis=1)[:, None]
    op, b = linear.LocalOp(rbf_block(0.25)(p, p) + 0.002 * np.eye(1200)), np.arange(1200.0) % 10
    _, history, done = krylov.cg(op, b, tol=1e-3)
    assert done and max(r for _, r in history[1:]) > history[0][1]
    x, rest = krylov.cg_many(op, np.stack([b, -2 * b], 1))
    assert rest.max() < 1e-10 and np.allclose(op.a64 @ x, np.stack([b, -2 * b], 1))
