import json

import numpy as np
from pyspark.sql import functions as F

from krylake.operators.krylov import cg, gmres_ir
from krylake.operators.linear import LocalOp
from krylake.operators.spatial import upserted
from krylake.sources.matrices import capabilities, definite, frame, nonsymmetric, sampled
from krylake.sources.points import grid


def test_rows_do_not_depend_on_blocks():
    a = nonsymmetric(20)
    assert (np.concatenate([nonsymmetric(20, i, 5) for i in range(0, 20, 5)]) == a).all()
    assert np.allclose(definite(20, block=3), definite(20)) and np.linalg.eigvalsh(definite(20)).min() > 0


def test_classes_of_systems():
    b = np.ones(64)
    assert gmres_ir(LocalOp(nonsymmetric(64)), b)[2] and cg(LocalOp(definite(64)), b)[2]


def test_frame_and_message(spark):
    g = grid(spark, 3, 2).withColumn("v", F.col("gy") * 10.0 + F.col("gx")).repartition(3)
    assert frame(g, {"n": F.lit(7)}, ["v"]).first()[:] == (7, [0.0, 1.0, 2.0, 10.0, 11.0, 12.0])
    assert json.loads(capabilities({"mode": F.lit(1)}, spark.range(1)).first()[0]) == {"mode": 1}


def test_sample_is_stable(spark):
    a = [r["id"] for r in sampled(spark.range(100), "id", 5).collect()]
    assert a == [r["id"] for r in sampled(spark.range(100).repartition(9), "id", 5).collect()] and len(set(a)) == 5


def test_upsert_merges_params(spark):
    ddl = "id int, type string, cx double, cy double, params map<string,double>"
    old = spark.createDataFrame([(1, "rect", 0.0, 0.0, {"w": 1.0, "h": 2.0}), (2, "circle", 1.0, 1.0, {"r": 1.0})], ddl)
    new = spark.createDataFrame([(1, None, 5.0, None, {"h": 9.0}), (3, "x", 0.0, 0.0, None)], ddl)
    assert [r[:] for r in upserted(old, new).orderBy("id").collect()] == [(1, "rect", 5.0, 0.0, {"w": 1.0, "h": 9.0}), (2, "circle", 1.0, 1.0, {"r": 1.0})]
