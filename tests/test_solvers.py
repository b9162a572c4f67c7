import warnings

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from krylake.functions.kernels import rbf_block
from krylake.operators.krylov import Factored, correction, cg, gmres, gmres_ir
from krylake.operators.linear import LocalOp, RecomputeOp, StoredOp


def nonsym(n, seed=0):
    return np.random.default_rng(seed).random((n, n)) + n * np.eye(n)


def spd(n, seed=0):
    x = np.random.default_rng(seed).random((n, n))
    return x.T @ x + n * np.eye(n)


def test_refinement_reaches_double_precision():
    a, b = nonsym(256), np.arange(256.0)
    x, history, done = gmres_ir(LocalOp(a), b)
    assert done and len(history) <= 4 and np.linalg.norm(a @ x - b) <= 1e-11 * np.linalg.norm(b)


def test_cg_and_gmres_agree():
    a, b = spd(128), np.ones(128)
    (x, _, ok), (y, _, ok2) = cg(LocalOp(a), b), gmres(LocalOp(a), b)
    assert ok and ok2 and np.allclose(x, y, atol=1e-6)


@pytest.mark.parametrize("solve", [cg, gmres, gmres_ir])
def test_zero_side_and_wrong_length(solve):
    x, history, done = solve(LocalOp(np.eye(5)), np.zeros(5))
    assert done and history == [(0, 0.0)] and not x.any()
    with pytest.raises(ValueError):
        solve(LocalOp(np.eye(5)), np.zeros(4))


def test_exact_start_and_no_iterations():
    for solve in (cg, gmres):
        _, history, done = solve(LocalOp(np.eye(4)), np.ones(4), x0=np.ones(4))
        assert done and history[0] == (0, 0.0)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        _, history, done = cg(LocalOp(spd(4)), np.ones(4), maxiter=0)
    assert not done and history == [(0, 1.0)]


def test_a_space_that_ends_is_used_up():
    d, m = correction(LocalOp(np.diag([1.0, 2.0])), np.ones(2), 2, 0.0)
    assert np.allclose(d, [1.0, 0.5], atol=1e-6) and m == 2


def test_not_positive_definite():
    with pytest.raises(ArithmeticError):
        cg(LocalOp(-np.eye(3)), np.ones(3))


def test_no_convergence_warns_and_returns():
    with pytest.warns(RuntimeWarning):
        x, _, done = gmres_ir(LocalOp(nonsym(64)), np.ones(64), tol=1e-30, maxiter_outer=1)
    assert not done and np.isfinite(x).all()


def test_factor_once():
    op = LocalOp(spd(64))
    f = Factored(op)
    for k in range(3):
        b = np.random.default_rng(k).random(64)
        assert np.allclose(op.a64 @ f.solve(b)[0], b)
    f.free()
    with pytest.raises(RuntimeError):
        f.solve(np.ones(64))
    op.free64()
    with pytest.raises(RuntimeError):
        op.residual_norm(np.zeros(64), np.ones(64))


@pytest.mark.parametrize("rows", [7, 64])
def test_distributed_operators_equal_local(spark, rows, tmp_path):
    p = np.random.default_rng(1).random((50, 3))
    x = np.random.default_rng(2).random(50)
    want = (rbf_block(2.0)(p, p) + 0.1 * np.eye(50)) @ x
    exact = RecomputeOp(spark, p, rbf_block(2.0), 0.1, rows)
    assert np.allclose(exact.matvec64(x), want)
    for op in (StoredOp(exact), StoredOp(exact, str(tmp_path / "blocks"))):
        assert np.allclose(op.matvec32(x), want, rtol=1e-5)
        op.close()
        with pytest.raises(RuntimeError):
            op.matvec32(x)


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 24), st.integers(0, 99))
def test_kernel_is_symmetric_positive(n, seed):
    p = np.random.default_rng(seed).random((n, 2)) * 10
    k = rbf_block(0.2)(p, p)
    assert np.allclose(k, k.T) and np.allclose(np.diag(k), 1) and np.linalg.eigvalsh(k + 0.1 * np.eye(n)).min() > 0
