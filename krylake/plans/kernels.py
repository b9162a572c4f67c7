"""Kernels over the table embeddings: every pair of vectors, in blocks."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from krylake.functions.kernels import bem_block, block_sqdist, estimate_gamma, rbf_block
from krylake.operators.blocks import kernel_apply, pairwise
from krylake.plans.registry import query
from krylake.plans.tables import table

GAMMA, REG = 0.25, 0.01
PAIRS = "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS p, CAST(label AS DOUBLE) AS v FROM embeddings), d AS (SELECT a.vec_id AS i, b.vec_id AS j, b.v AS v, list_distance(a.p, b.p) ** 2 AS d2 FROM e a, e b) "


def points(spark, sf_dir):
    """(id, p, v): the vectors, with their label as a number."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("p"), F.col("label").cast("double").alias("v"))


@query(PAIRS + "SELECT i AS vec_id, round(sum(d2) / count(*), 6) AS mean_d2, round(max(d2), 6) AS max_d2 FROM d GROUP BY i")
def pairwise_sqdist(spark, sf_dir):
    def answer(li, lp, ri, rp, _):
        d = ((lp[:, None, :] - rp[None, :, :]) ** 2).sum(axis=2) if len(lp) * len(rp) * lp.shape[1] < 1 << 22 else block_sqdist(lp, rp)
        return pd.DataFrame({"id": li, "total": d.sum(axis=1), "n": len(ri), "most": d.max(axis=1)})

    p = points(spark, sf_dir)
    out = pairwise(p, p, answer, "id long, total double, n long, most double", fold={"total": "sum", "n": "sum", "most": "max"}).groupBy("id").agg(F.sum("total").alias("t"), F.sum("n").alias("n"), F.max("most").alias("m"))
    return out.select(F.col("id").alias("vec_id"), F.round(F.col("t") / F.col("n"), 6).alias("mean_d2"), F.round("m", 6).alias("max_d2"))


@query("WITH s AS (SELECT CAST(embedding AS DOUBLE[]) AS p FROM embeddings ORDER BY vec_id LIMIT 512) SELECT (SELECT count(*) FROM embeddings) AS n, round(1.0 / (2.0 * avg(list_distance(a.p, b.p) ** 2)), 6) AS gamma FROM s a, s b")
def gamma_estimate(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.agg(F.count("*").alias("n")).select("n", F.round(F.lit(estimate_gamma(p)), 6).alias("gamma"))


@query(PAIRS + f"SELECT i AS vec_id, round(sum(exp(-{GAMMA} * d2) + CASE WHEN i = j THEN {REG} ELSE 0 END), 6) AS row_sum, round(max(CASE WHEN i = j THEN exp(-{GAMMA} * d2) + {REG} END), 6) AS diagonal FROM d GROUP BY i")
def rbf_kernel_block(spark, sf_dir):
    def answer(li, lp, ri, rp, _):
        k = rbf_block(GAMMA)(lp, rp)
        k[li[:, None] == ri[None, :]] += REG
        own = np.where(li[:, None] == ri[None, :], k, -np.inf).max(axis=1)
        return pd.DataFrame({"id": li, "total": k.sum(axis=1), "own": own})

    p = points(spark, sf_dir)
    out = pairwise(p, p, answer, "id long, total double, own double", fold={"total": "sum", "own": "max"}).groupBy("id").agg(F.round(F.sum("total"), 6).alias("row_sum"), F.round(F.max("own"), 6).alias("diagonal"))
    return out.withColumnRenamed("id", "vec_id")


@query(PAIRS + f"SELECT i AS vec_id, round(sum(v * (exp(-{GAMMA} * d2) + CASE WHEN i = j THEN {REG} ELSE 0 END)), 6) AS y FROM d GROUP BY i")
def kernel_matvec(spark, sf_dir):
    p = points(spark, sf_dir)
    return kernel_apply(p, p, rbf_block(GAMMA), "v", REG).select(F.col("id").alias("vec_id"), F.round("y", 6).alias("y"))


@query(PAIRS + f"SELECT round(max(CASE WHEN i <> j THEN exp(-{GAMMA} * d2) END), 6) AS largest, round(min(CASE WHEN i = j THEN exp(-{GAMMA} * d2) + {REG} END), 6) AS diagonal, round((SELECT max(abs(exp(-{GAMMA} * x.d2) - exp(-{GAMMA} * y.d2))) FROM d x JOIN d y ON x.i = y.j AND x.j = y.i), 9) AS asymmetry FROM d")
def kernel_symmetry(spark, sf_dir):
    def answer(li, lp, ri, rp, _):
        k, same = rbf_block(GAMMA)(lp, rp), li[:, None] == ri[None, :]
        return pd.DataFrame({"largest": [np.where(same, -np.inf, k).max()], "diagonal": [np.where(same, k + REG, np.inf).min()], "asymmetry": [np.abs(k - rbf_block(GAMMA)(rp, lp).T).max()]})

    p = points(spark, sf_dir)
    return pairwise(p, p, answer, "largest double, diagonal double, asymmetry double").agg(F.round(F.max("largest"), 6).alias("largest"), F.round(F.min("diagonal"), 6).alias("diagonal"), F.round(F.max("asymmetry"), 9).alias("asymmetry"))


@query(PAIRS + "SELECT i AS vec_id, round(sum(1.0 / (1.0 + sqrt(d2))), 4) AS y FROM d GROUP BY i")
def bem_kernel_rowsum(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("one", F.lit(1.0))
    return kernel_apply(p, p, bem_block, "one").select(F.col("id").alias("vec_id"), F.round("y", 4).alias("y"))


@query(PAIRS + "SELECT i AS vec_id, round(sum(exp(-0.5 * d2) + CASE WHEN i = j THEN 0.01 ELSE 0 END), 6) AS y FROM d GROUP BY i")
def gp_kernel_rowsum(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("one", F.lit(1.0))
    return kernel_apply(p, p, rbf_block(0.5), "one", 0.01).select(F.col("id").alias("vec_id"), F.round("y", 6).alias("y"))


@query(PAIRS + f", y AS (SELECT i, sum(v * (exp(-{GAMMA} * d2) + CASE WHEN i = j THEN {REG} ELSE 0 END)) AS y FROM d GROUP BY i) SELECT round(sqrt(sum((e.v - y.y) ** 2)) / sqrt(sum(e.v ** 2)), 6) AS rel_res FROM y JOIN e ON e.vec_id = y.i")
def residual_norm(spark, sf_dir):
    p = points(spark, sf_dir)
    y = kernel_apply(p, p, rbf_block(GAMMA), "v", REG)
    return p.join(y, "id").agg(F.round(F.sqrt(F.sum((F.col("v") - F.col("y")) ** 2)) / F.sqrt(F.sum(F.col("v") ** 2)), 6).alias("rel_res"))
