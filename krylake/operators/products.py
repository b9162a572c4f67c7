"""Products of tall matrices whose rows lie in a table: X'Y by partial products a task and a tree of sums; nothing is collected."""

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from krylake.plans.tables import written

TILE = 256  # columns of a tile
FAN = 32  # partial sums that are added in one place
WIDE = 4096  # columns of either side: a task holds one product of them, 128 MB


def crossed(pairs: DataFrame, tile: int = TILE, fan: int = FAN) -> DataFrame:
    """(i, j, v) of X'Y, for rows (x, y: arrays of doubles) of both. All x are of one length, and all y; rows where either is null count nothing. No rows, no entries."""

    def partial(batches):
        total = None
        for b in batches:
            x, y = (b.column(c).combine_chunks() if hasattr(b.column(c), "combine_chunks") else b.column(c) for c in (0, 1))
            if not b.num_rows:
                continue
            a, c = (v.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for v in (x, y))
            if max(a.shape[1], c.shape[1]) > WIDE:
                raise ValueError(f"rows of {a.shape[1]} and {c.shape[1]} numbers; {WIDE} is the most")
            total = a.T @ c if total is None else total + a.T @ c
        if total is not None:
            part = TaskContext.get().partitionId()
            for ti in range(0, total.shape[0], tile):
                for tj in range(0, total.shape[1], tile):
                    t = total[ti : ti + tile, tj : tj + tile]
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in (part, ti, tj, t.shape[1])] + [pa.array([t.tobytes()], pa.binary())], names=["part", "ti", "tj", "width", "data"])

    sums = written(pairs.filter("x IS NOT NULL AND y IS NOT NULL").select("x", "y").mapInArrow(partial, "part int, ti int, tj int, width int, data binary"))

    def added(rows: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(d.as_py()) for d in rows.column("data")], axis=0)
        return rows.slice(0, 1).set_column(rows.schema.get_field_index("data"), "data", pa.array([total.tobytes()], pa.binary()))

    parts = (sums.agg(F.max("part")).first()[0] or 0) + 1
    for _ in range(max(1, math.ceil(math.log(parts, fan))) if parts > 1 else 0):
        sums = sums.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("part", "ti", "tj").applyInArrow(added, sums.schema)

    def entries(batches):
        for b in batches:
            for ti, tj, width, data in zip(*[b.column(c).to_pylist() for c in ("ti", "tj", "width", "data")], strict=True):
                t = np.frombuffer(data).reshape(-1, width)
                i, j = np.indices(t.shape)
                yield pa.RecordBatch.from_arrays([pa.array((i + ti).ravel()), pa.array((j + tj).ravel()), pa.array(t.ravel())], names=["i", "j", "v"])

    return sums.mapInArrow(entries, "i long, j long, v double")


def gram(rows: DataFrame, tile: int = TILE, fan: int = FAN) -> DataFrame:
    """(i, j, v) of X'X for rows (row: array of doubles)."""
    return crossed(rows.select(F.col("row").alias("x"), F.col("row").alias("y")), tile, fan)


def transposed_product(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(i, v) of V'w for rows (k, row) and a vector (k, w): an equi-join, then one column of sums."""
    return crossed(rows.join(weights, "k").select(F.col("row").alias("x"), F.array(F.col("w").cast("double")).alias("y"))).select("i", "v")
