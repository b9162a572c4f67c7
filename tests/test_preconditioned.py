"""Solves of a Gaussian kernel by few products, half of its numbers at a time, and stored tiles within a bound."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from krylake.functions.kernels import rbf_block
from krylake.operators import krylov, linear, regression

GAMMA, REG = 0.25, 0.01


def vectors(n=240, dims=20, crowd=40):
    """Of length 1, some of them close together."""
    rng = np.random.default_rng(11)
    p = rng.normal(size=(n, dims))
    p[:crowd] = p[0] + 0.02 * rng.normal(size=(crowd, dims))
    return p / np.linalg.norm(p, axis=1)[:, None], np.arange(n) % 10.0


@pytest.fixture
def products(monkeypatch):
    """How often an operator of tiles was applied."""
    done = []
    for name in ("matvec32", "matvec64"):
        monkeypatch.setattr(linear.RecomputeOp, name, lambda self, x, f=getattr(linear.RecomputeOp, name): done.append(1) or f(self, x))
    return done


def operator(spark, p, reg=REG):
    return linear.RecomputeOp(spark, p, rbf_block(GAMMA), reg, 64, 120)


def dense(p, reg=REG):
    return rbf_block(GAMMA)(p, p) + reg * np.eye(len(p))


def test_cg_takes_few_products(spark, products):
    p, b = vectors()
    x, rest = krylov.cg_many(operator(spark, p), b[:, None], 1e-9)
    assert rest[0] <= 1e-9 and np.linalg.norm(dense(p) @ x[:, 0] - b) <= 2e-9 * np.linalg.norm(b) and len(products) <= 30


def test_many_sides_take_few_products(spark, products, monkeypatch):
    monkeypatch.setattr(regression, "FACTOR", 10)
    p, b = vectors()
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(p)], "id long, p array<double>")
    rhs = spark.createDataFrame([(k, (k * b).tolist()) for k in (1, 2)], "k long, values array<double>")
    got = {r["k"]: r for r in regression.solve_many(points, rhs, ["k"], GAMMA, REG).collect()}
    assert all(np.allclose(dense(p) @ got[k]["weights"], k * b, atol=1e-8) and got[k]["rel_res"] <= 1e-11 for k in (1, 2)) and len(products) <= 35


def test_refinement_takes_few_products(spark, products):
    p, b = vectors()
    x, history, done = krylov.gmres_ir(operator(spark, p), b, maxiter_outer=20)
    assert done and len(history) <= 4 and np.linalg.norm(dense(p) @ x - b) <= 2e-11 * np.linalg.norm(b) and len(products) <= 45


def test_gmres_takes_few_products(spark, products):
    p, b = vectors()
    x, _, done = krylov.gmres(operator(spark, p), b, tol=1e-8, maxiter=600, restart=100)
    assert done and np.linalg.norm(dense(p) @ x - b) <= 2e-8 * np.linalg.norm(b) and len(products) <= 30


def test_regression_takes_few_products(spark, products, monkeypatch):
    monkeypatch.setattr(linear, "LOCAL", 1)
    p, b = vectors(200)
    points = spark.createDataFrame([(i, x.tolist(), float(v)) for i, (x, v) in enumerate(zip(p, b, strict=True))], "id long, p array<double>, v double")
    gp = regression.GPRegressor(GAMMA, REG, tol=1e-10, outer=20).fit(points, "v")
    got = gp.predict(points).join(gp.weights, "id").select("id", (F.col("mean") + REG * F.col("weight")).alias("y")).collect()
    assert gp.converged and all(abs(r["y"] - b[r["id"]]) < 1e-7 for r in got) and len(products) <= 45


def test_history_falls_by_each_correction(spark):
    p, b = vectors()
    _, history, done = krylov.gmres_ir(operator(spark, p), b, maxiter_outer=20)
    assert done and len(history) <= 4 and all(after < 1e-3 * before for (_, before), (_, after) in zip(history, history[1:], strict=False))


def test_half_of_the_kernel_is_computed(spark):
    """Numbers of the kernel in a product of any precision: those of pairs of groups, each pair once."""
    p, b = vectors()
    made = spark.sparkContext.accumulator(0)

    def kernel(x, y):
        made.add(len(x) * len(y))
        return rbf_block(GAMMA)(x, y)

    assert np.allclose(linear.RecomputeOp(spark, p, kernel, REG, 32, 30).matvec64(b), dense(p) @ b) and made.value < 0.62 * len(p) ** 2


@pytest.mark.parametrize("wide", [0.3, 8.0])
def test_single_products_are_near_those_in_double(spark, wide):
    """Also of points too far apart for a quadratic part, of more axes than it has, and of a matrix."""
    for dims in (3, 70):
        p, b = vectors(300, dims)
        op = operator(spark, wide * p)
        assert op.mixed == (wide < 1 and dims == 3)
        for x in (b, np.stack([b, b[::-1]], 1)):
            want = dense(wide * p) @ x
            assert np.linalg.norm(op.matvec32(x) - want) <= 1e-6 * np.linalg.norm(want) and np.linalg.norm(op.matvec64(x) - want) <= 1e-13 * np.linalg.norm(want)


@pytest.mark.parametrize("bound", [0, 100_000, 1 << 30])
def test_stored_tiles_have_a_bound(spark, monkeypatch, tmp_path, bound):
    """What is beyond it is recomputed: the same solution."""
    monkeypatch.setattr(linear, "STORED_BYTES", bound)
    p, b = vectors()
    op = linear.StoredOp(operator(spark, p), str(tmp_path / "tiles"))
    held = sum(len(r["data"]) for r in spark.read.parquet(str(tmp_path / "tiles")).collect())
    assert held <= bound and (held > 0) == (bound > 0) and held < 0.8 * 4 * len(p) ** 2
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        x, _, done = krylov.gmres_ir(op, b, tol=1e-6, maxiter_outer=6, restart=60)
    op.close()
    assert done and np.linalg.norm(dense(p) @ x - b) <= 2e-6 * np.linalg.norm(b)
