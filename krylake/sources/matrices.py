"""Test matrices of known character, as blocks of rows that tasks can make by themselves, and frames for clients."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nonsymmetric(n: int, first: int = 0, rows: int | None = None, seed: int = 0) -> np.ndarray:
    """Rows first.. of a random matrix with n added on the diagonal; a row depends on the seed and its number alone."""
    rows = n - first if rows is None else rows
    a = np.stack([np.random.default_rng([seed, first + i]).random(n) for i in range(rows)])
    a[np.arange(rows), first + np.arange(rows)] += n
    return a


def definite(n: int, seed: int = 0, block: int = 512) -> np.ndarray:
    """X'X + n I from blocks of rows of X."""
    total = np.zeros((n, n))
    for first in range(0, n, block):
        x = nonsymmetric(n, first, min(block, n - first), seed)
        x[np.arange(len(x)), first + np.arange(len(x))] -= n
        total += x.T @ x
    return total + n * np.eye(n)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Row blocks (i, data) as Parquet: schema and statistics instead of a bare file."""
    blocks.write.mode("overwrite").parquet(path)


def frame(cells: DataFrame, header: dict[str, Column], values: list[str]) -> DataFrame:
    """One row per frame: header fields, and each value as an array ordered by (gy, gx)."""

    def ordered(v: str) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.struct("gy", "gx", v))), lambda c: c[v].cast("float")).alias(v)

    return cells.agg(*map(ordered, values)).select(*[c.alias(k) for k, c in header.items()], *values)


def capabilities(header: dict[str, Column], source: DataFrame) -> DataFrame:
    """The message that a client gets first, as JSON."""
    return source.select(F.to_json(F.struct(*[c.alias(k) for k, c in header.items()])).alias("message"))


def sampled(rows: DataFrame, key: str, n: int, seed: int = 0, by: Column | None = None) -> DataFrame:
    """n rows, the same for a seed whatever the partitioning: the first by a hash of the key (or by `by`). Each task hands on n at most."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)) if by is None else by, key).limit(n)
