"""Solves over the table embeddings. Each query gives what the solution reproduces, by a separate distributed product: the right-hand side."""

import warnings

import pandas as pd
from pyspark.sql import functions as F

from krylake.functions.kernels import rbf_block
from krylake.operators import krylov
from krylake.operators.blocks import kernel_apply
from krylake.operators.linear import collected, kernel_operator
from krylake.operators.regression import GPRegressor, solve_many
from krylake.plans.kernels import GAMMA, REG, points
from krylake.plans.registry import query

BACK = "SELECT vec_id, CAST(label AS DOUBLE) AS b FROM embeddings"


def solution(spark, sf_dir, solve, store="auto"):
    """(id, x) and the history of a solve for the labels."""
    p = points(spark, sf_dir)
    ids, xs, (b,) = collected(p, "v")
    op = kernel_operator(spark, xs, rbf_block(GAMMA), REG, store)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        x, history, _ = solve(op, b)
    if hasattr(op, "close"):
        op.close()
    return p, spark.createDataFrame(pd.DataFrame({"id": ids, "x": x}), "id long, x double"), history


def certificate(p, x, digits):
    y = kernel_apply(p, p.select("id", "p").join(x, "id"), rbf_block(GAMMA), "x", REG)
    return y.select(F.col("id").alias("vec_id"), (F.round("y", digits) + 0.0).alias("b"))


@query(BACK)
def cg_solve(spark, sf_dir):
    """In double precision: in single, the directions lose each other, and it takes about twice the products."""

    def solve(op, b):
        x, rest = krylov.cg_many(op, b[:, None], 1e-9)
        return x[:, 0], [(0, float(rest[0]))], rest[0] <= 1e-9

    p, x, _ = solution(spark, sf_dir, solve)
    return certificate(p, x, 3)


@query(BACK)
def gmres_solve(spark, sf_dir):
    p, x, _ = solution(spark, sf_dir, lambda op, b: krylov.gmres(op, b, tol=1e-8, maxiter=600, restart=100))
    return certificate(p, x, 3)


@query(BACK)
def gmres_ir_solve(spark, sf_dir):
    p, x, _ = solution(spark, sf_dir, lambda op, b: krylov.gmres_ir(op, b, maxiter_outer=20))
    return certificate(p, x, 4)


@query(BACK)
def ooc_solve(spark, sf_dir):
    """Inner products from stored single-precision blocks, residuals from rows recomputed in double precision: a job a product."""
    p, x, _ = solution(spark, sf_dir, lambda op, b: krylov.gmres_ir(op, b, tol=1e-6, maxiter_outer=6, restart=60), "cache")
    return certificate(p, x, 3)


@query("SELECT vec_id, k, CAST(label AS DOUBLE) * k AS b FROM embeddings, (SELECT unnest([1, 2, 3])::BIGINT AS k)")
def factor_once_multi_rhs(spark, sf_dir):
    p = points(spark, sf_dir)
    values = p.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "v"))), lambda r: r["v"]).alias("v"))
    rhs = values.select(F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)])).alias("k"), "v").select("k", F.transform("v", lambda v: v * F.col("k")).alias("values"))
    solved = solve_many(p, rhs, ["k"], GAMMA, REG)
    ids = [r["id"] for r in p.select("id").orderBy("id").collect()]
    weights = solved.select("k", F.posexplode("weights").alias("at", "x")).join(spark.createDataFrame(list(enumerate(ids)), "at int, id long"), "at")
    out = [kernel_apply(p, p.select("id", "p").join(weights.filter(F.col("k") == k).select("id", "x"), "id"), rbf_block(GAMMA), "x", REG).withColumn("k", F.lit(k).cast("long")) for k in (1, 2, 3)]
    return out[0].unionByName(out[1]).unionByName(out[2]).select(F.col("id").alias("vec_id"), "k", (F.round("y", 4) + 0.0).alias("b"))


@query()
def convergence_history(spark, sf_dir):
    """(iter, rel_res) of the refinement."""
    _, _, history = solution(spark, sf_dir, lambda op, b: krylov.gmres_ir(op, b, maxiter_outer=20))
    return spark.createDataFrame([(int(k), float(r)) for k, r in history], "iter int, rel_res double")


@query("SELECT vec_id, CAST(label AS DOUBLE) AS b FROM embeddings")
def gp_fit_predict(spark, sf_dir):
    """The posterior mean at the training points plus the noise's share of the weights is the readings again."""
    p = points(spark, sf_dir)
    gp = GPRegressor(GAMMA, REG, tol=1e-10, outer=20).fit(p, "v")
    return gp.predict(p).join(gp.weights, "id").select(F.col("id").alias("vec_id"), (F.round(F.col("mean") + REG * F.col("weight"), 4) + 0.0).alias("b"))
