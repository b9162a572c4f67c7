"""Connected components by alternating stars: joins and aggregates only, logarithmically many rounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from krylake.llm.common import forget, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbours and itself."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them. Edges lead from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of `edges` (a, b: long) reaches.

    Loops, repeats and both directions are allowed. A round is written to the shared folder, so a
    lost executor costs its own tasks only. Hubs are grouped before they are shuffled.
    """
    state = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        after = written(_small_star(_large_star(state).distinct()).distinct())
        now = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        forget(state)
        state = after
        if now == mark or not now[0]:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
