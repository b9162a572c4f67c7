"""Dense linear operators: local arrays, rows recomputed from points in tasks, and stored row blocks.

An operator of n unknowns stands for n * n numbers; vectors of n numbers live on the driver, and with
the points they are the square root of the work. Their size is checked before it is broadcast.
"""

import functools
from collections import defaultdict
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from krylake.operators.features import Preconditioner, Quadratic, both, cubic, rest_block

LOCAL = 8192  # unknowns up to which an operator fits the driver
BROADCAST_BYTES = 512 << 20
SIDE = 8  # groups of points, whose pairs are tasks: 36
STORED_BYTES = 1 << 30  # of tiles that a stored operator holds at most


class LinearOperator(Protocol):
    n: int

    def matvec32(self, x: np.ndarray) -> np.ndarray: ...

    def matvec64(self, x: np.ndarray) -> np.ndarray: ...


def checked(a: np.ndarray) -> np.ndarray:
    if a.nbytes > BROADCAST_BYTES:
        raise ValueError(f"{a.nbytes} bytes are too many for a broadcast")
    return a


class LocalOp:
    """A square matrix in memory, with a copy in single precision; the original can be let go."""

    def __init__(self, a: np.ndarray):
        a = np.asarray(a, np.float64)
        if a.ndim != 2 or a.shape[0] != a.shape[1]:
            raise ValueError("the matrix isn't square")
        self.a64, self.a32, self.n = a, a.astype(np.float32), len(a)

    def matvec32(self, x):
        return self.a32 @ x.astype(np.float32)

    def matvec64(self, x):
        if self.a64 is None:
            raise RuntimeError("the double-precision matrix was freed")
        return self.a64 @ x

    def residual_norm(self, x: np.ndarray, b: np.ndarray) -> float:
        return float(np.linalg.norm(b - self.matvec64(x)))

    def free64(self) -> None:
        self.a64 = None


class RecomputeOp:
    """Kernel rows computed from the points in tasks, a tile of `rows` x `columns` at a time, never stored. The kernel is symmetric.

    Points fall into at most SIDE groups; a task takes two groups, and off the diagonal its tiles serve both of them: half of the kernel's numbers are computed."""

    def __init__(self, spark: SparkSession, points: np.ndarray, kernel: Callable, reg: float, rows: int = 512, columns: int = 2048):
        self.spark, self.n, self.rows, self.columns = spark, len(points), rows, columns
        self.kernel, self.reg = kernel, reg
        points = checked(np.asarray(points, np.float64))
        self.points, self.gamma = spark.sparkContext.broadcast(points), getattr(kernel, "gamma", None)
        low = None if self.gamma is None or not self.n else Quadratic(points, self.gamma)
        self.mixed = low is not None and low.reach <= 1 and low.used == points.shape[1]
        if self.mixed:  # a Gaussian of points that lie close: single precision holds all of the kernel but its quadratic part, which is taken in double
            self.low, self.damping, self.rest = spark.sparkContext.broadcast(low), low.of(points)[1], rest_block(cubic(max(low.reach, 1e-3)))
        across = -(-self.n // columns)
        count = max(1, min(SIDE, across))
        ends = [min(self.n, g * across // count * columns) for g in range(1 + count)]
        groups = list(zip(ends[:-1], ends[1:], strict=True))
        self.pairs = [(*a, *b) for k, a in enumerate(groups) for b in groups[k:]]

    def tiles(self, dtype) -> Callable:
        """A function of two groups of points (first, end, first, end) that gives one of their tiles. In single precision and of a mixed product it is of what the quadratic part leaves, undamped."""
        points, kernel, reg = self.points, self.kernel, self.reg
        if self.mixed and dtype == np.float32:
            low, rest = self.low, self.rest

            def pair(i: int, i_end: int, j: int, j_end: int) -> Callable:
                p, q = (low.value.of(points.value[a:b])[0].astype(np.float32) for a, b in ((i, i_end), (j, j_end)))
                return lambda a, a_end, b, b_end: rest(p[a - i : a_end - i], q[b - j : b_end - j])

            return pair

        def tile(i: int, i_end: int, j: int, j_end: int) -> np.ndarray:
            a = kernel(points.value[i:i_end], points.value[j:j_end]).astype(dtype, copy=False)
            r = np.arange(max(i, j), min(i_end, j_end))
            a[r - i, r - j] += dtype(reg)
            return a

        return lambda *_: tile

    def single(self, x: np.ndarray, product: Callable) -> np.ndarray:
        """The operator's product, given that with its single-precision tiles. Of a mixed product some 1e-7 is lost, as the quadratic part is taken in double precision."""
        if not self.mixed:
            return product(x)
        damping = self.damping.reshape(-1, *[1] * (x.ndim - 1))
        return damping * product(damping * x) + both(self.spark, self.points, self.low, self.n, x) + self.reg * x

    def over(self, x: np.ndarray, dtype, pairs: list[tuple]) -> np.ndarray:
        """What tiles of these pairs of groups add to the product with a vector, or with each column of a matrix."""
        if not pairs:
            return np.zeros(x.shape)
        v, tiles, rows, columns = self.spark.sparkContext.broadcast(checked(x.astype(dtype))), self.tiles(dtype), self.rows, self.columns

        def run(batches):
            for pdf in batches:
                for k in pdf["id"]:
                    i, i_end, j, j_end = pairs[k]
                    tile = tiles(*pairs[k])
                    y, z = np.zeros((i_end - i, *v.value.shape[1:])), np.zeros((j_end - j, *v.value.shape[1:]))
                    for a, a_end, b, b_end in within(pairs[k], rows, columns):
                        t = tile(a, a_end, b, b_end)
                        y[a - i : a_end - i] += t @ v.value[b:b_end]
                        if i != j:
                            z[b - j : b_end - j] += t.T @ v.value[a:a_end]
                    yield pd.DataFrame({"at": [i, j], "y": [y.tobytes(), z.tobytes()]})

        got = self.spark.range(0, len(pairs), 1, len(pairs)).mapInPandas(run, "at long, y binary").collect()
        v.destroy()
        return added(x.shape, got)

    @functools.cached_property
    def precondition(self) -> Callable | None:
        """An approximate inverse, of a Gaussian kernel; made when first asked for."""
        return None if self.gamma is None or not self.n else Preconditioner(self.spark, self.points, self.gamma, self.reg)

    def matvec32(self, x):
        return self.single(x, lambda v: self.over(v, np.float32, self.pairs))

    def matvec64(self, x):
        return self.over(x, np.float64, self.pairs)


def within(pair: tuple, rows: int, columns: int) -> list[tuple]:
    """The tiles (i, its end, j, its end) of two groups of points."""
    i, i_end, j, j_end = pair
    return [(a, min(i_end, a + rows), b, min(j_end, b + columns)) for b in range(j, j_end, columns) for a in range(i, i_end, rows)]


def added(shape: tuple, parts: list) -> np.ndarray:
    """The sum of parts (at, y) of a vector, or of the rows of a matrix."""
    y = np.zeros(shape)
    for r in parts:
        part = np.frombuffer(r["y"]).reshape(-1, *shape[1:])
        y[r["at"] : r["at"] + len(part)] += part
    return y


class StoredOp:
    """Tiles in single precision, cached (`path` None: what memory doesn't hold goes to disk) or in Parquet, up to STORED_BYTES: those beyond are recomputed for each product, in single precision too.
    Double precision is recomputed from the points."""

    def __init__(self, exact: RecomputeOp, path: str | None = None):
        self.exact, self.n, self.path, self.mixed = exact, exact.n, path, exact.mixed
        tiles, rows, columns = exact.tiles(np.float32), exact.rows, exact.columns
        ends = np.cumsum([4 * (p[1] - p[0]) * (p[3] - p[2]) for p in exact.pairs])
        held = exact.pairs[: int(np.searchsorted(ends, STORED_BYTES, "right"))]
        self.others = exact.pairs[len(held) :]

        def build(batches):
            for pdf in batches:
                for k in pdf["id"]:
                    tile = tiles(*held[k])
                    for i, i_end, j, j_end in within(held[k], rows, columns):
                        yield pd.DataFrame({"i": [i], "j": [j], "twice": [held[k][0] != held[k][2]], "columns": [j_end - j], "data": [tile(i, i_end, j, j_end).tobytes()]})

        made = exact.spark.range(0, len(held), 1, max(1, len(held))).mapInPandas(build, "i long, j long, twice boolean, columns long, data binary")
        if path:
            made.write.mode("overwrite").parquet(path)
            self.frame: DataFrame | None = exact.spark.read.parquet(path)
        else:
            self.frame = made.persist(StorageLevel.MEMORY_AND_DISK)

    @property
    def precondition(self) -> Callable | None:
        return self.exact.precondition

    def matvec32(self, x):
        if self.frame is None:
            raise RuntimeError("the blocks were closed")
        return self.exact.single(x, lambda v: self.stored(v) + self.exact.over(v, np.float32, self.others))

    def stored(self, x: np.ndarray) -> np.ndarray:
        v = self.exact.spark.sparkContext.broadcast(checked(x.astype(np.float32)))

        def run(batches):
            y = defaultdict(float)  # parts of the product, by the first row and how many
            for pdf in batches:
                for i, j, twice, columns, data in pdf.itertuples(index=False):
                    t = np.frombuffer(data, np.float32).reshape(-1, columns)
                    y[i, len(t)] += (t @ v.value[j : j + columns]).astype(np.float64)
                    if twice:
                        y[j, columns] += (t.T @ v.value[i : i + len(t)]).astype(np.float64)
            yield pd.DataFrame({"at": [k[0] for k in y], "y": [part.tobytes() for part in y.values()]})

        y = added(x.shape, self.frame.mapInPandas(run, "at long, y binary").collect())
        v.destroy()
        return y

    def matvec64(self, x):
        return self.exact.matvec64(x)

    def close(self) -> None:
        if self.frame is not None and not self.path:
            self.frame.unpersist()
        self.frame = None


def collected(points: DataFrame, *values: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """ids, points and values on the driver, by id: n of them stand for n * n numbers."""
    rows = points.select("id", "p", *[F.col(v).cast("double") for v in values]).toArrow()
    order = np.argsort(rows.column("id").to_numpy(), kind="stable")
    at = lambda c: rows.column(c).to_numpy()[order]
    p = rows.column("p").combine_chunks()
    return at("id"), p.flatten().to_numpy().astype(np.float64, copy=False).reshape(len(order), -1)[order] if len(order) else np.zeros((0, 0)), [at(v) for v in values]


def kernel_operator(spark: SparkSession, points: np.ndarray, kernel: Callable, reg: float, store: str = "auto", path: str | None = None) -> LinearOperator:
    """A kernel operator: `local`, `recompute`, `cache` or `parquet`; `auto` is local up to LOCAL unknowns and recomputed beyond: n * n numbers are stored only where that is asked for."""
    if store == "local" or store == "auto" and len(points) <= LOCAL:
        return LocalOp(kernel(points, points) + reg * np.eye(len(points)))
    exact = RecomputeOp(spark, points, kernel, reg)
    return exact if store in ("auto", "recompute") else StoredOp(exact, path if store == "parquet" else None)


def from_blocks(rows: DataFrame, size: int) -> DataFrame:
    """(block, ids, data): rows (i, row: doubles) of a user's matrix packed into blocks of about `size` rows, to be stored and scanned."""
    count = max(1, -(-rows.count() // size))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [pdf["i"].to_numpy(np.int64).tobytes()], "data": [np.stack(pdf["row"].to_numpy()).astype(np.float64).tobytes()]})

    return rows.withColumn("block", F.pmod(F.xxhash64("i"), F.lit(count)).cast("int")).groupBy("block").applyInPandas(pack, "block int, ids binary, data binary")


def blocks_product(blocks: DataFrame, x: list[float]) -> DataFrame:
    """(i, y) of blocks (ids, data) times a vector as long as a row, which is checked before it goes to all tasks."""
    v = checked(np.asarray(x, np.float64))

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                ids = np.frombuffer(r.ids, np.int64)
                a = np.frombuffer(r.data).reshape(len(ids), -1)
                if a.shape[1] != len(v):
                    raise ValueError(f"rows of {a.shape[1]} numbers, a vector of {len(v)}")
                yield pd.DataFrame({"i": ids, "y": a @ v})

    return blocks.mapInPandas(run, "i long, y double")


def coordinates_product(entries: DataFrame, x: DataFrame) -> DataFrame:
    """(i, y) of entries (i, j, v) times a vector (j, x): an equi-join and a sum, neither side collected."""
    return entries.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def real_blocks(entries: DataFrame) -> DataFrame:
    """Entries (i, j, re, im) of a complex matrix as those (i, j, v) of the real one of twice the size, rows and columns interleaved."""
    four = [(0, 0, F.col("re")), (0, 1, -F.col("im")), (1, 0, F.col("im")), (1, 1, F.col("re"))]
    return entries.select(F.inline(F.array(*[F.struct((2 * F.col("i") + a).alias("i"), (2 * F.col("j") + b).alias("j"), v.alias("v")) for a, b, v in four])))
