"""Cells that split until each holds little: nearest neighbours and polygons, whatever the points crowd into."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from krylake.plans.tables import written

DEEP = 26  # halvings of the square at most: cells are then some 1e-8 of it wide
STEP = 2  # halvings between two levels of the tree
FEW = 32  # targets of a cell that isn't split
SMALL = 100_000  # cells of a level that are broadcast (some 10 MB)


def _boxed(x: Column, y: Column, which: str) -> Column:
    """Squared distance from (x, y) to the nearest or furthest place of the box (west, east, south, north)."""
    f = {"least": lambda v, a, b: F.greatest(a - v, v - b, F.lit(0.0)), "most": lambda v, a, b: F.greatest(F.abs(v - a), F.abs(b - v))}[which]
    return F.pow(f(x, F.col("west"), F.col("east")), 2) + F.pow(f(y, F.col("south"), F.col("north")), 2)


def tree(targets: DataFrame, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """(cells, places). cells: (level, cx, cy, n, west, east, south, north), written; those with over `few` places are split, and only cells whose parent is are met. places: (level, cx, cy) of each (target, tx, ty) at all levels.

    Targets at the same place are one, with their smallest id; those without a place are left out. All levels are counted in one aggregate, a row
    a target and level before the shuffle's own summing; the square is that of the targets, so a crowd in a corner costs no levels to get to.
    """
    known = targets.filter(~F.isnan(F.coalesce(F.col("x") + F.col("y"), F.lit(math.nan))))
    west, east, south, north = known.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    side = max((east or 0.0) - (west or 0.0), (north or 0.0) - (south or 0.0)) or 1.0
    number = lambda c, low: F.least(F.floor((F.col(c) - F.lit(low or 0.0)) / side * float(1 << DEEP)), F.lit((1 << DEEP) - 1))
    places = known.groupBy("x", "y").agg(F.min("id").alias("id")).withColumn("_x", number("x", west)).withColumn("_y", number("y", south))
    deep = places.withColumn("level", F.explode(F.array(*map(F.lit, [*range(0, DEEP, STEP), DEEP]))))
    up = F.pow(F.lit(2.0), F.lit(DEEP) - F.col("level")).cast("long")
    deep = deep.withColumn("cx", F.floor(F.col("_x") / up)).withColumn("cy", F.floor(F.col("_y") / up))
    box = [F.min("x").alias("west"), F.max("x").alias("east"), F.min("y").alias("south"), F.max("y").alias("north")]
    cells = written(deep.groupBy("level", "cx", "cy").agg(F.count("*").alias("n"), *box))
    return cells, deep.select("level", "cx", "cy", F.col("id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"))


def nearest(queries: DataFrame, targets: DataFrame, few: int = FEW) -> DataFrame:
    """(id, nearest_id, distance) for points (id, p) of the plane: ties go to the smallest id. Ids of queries are unique.

    From the whole square on, a query keeps the cells whose nearest place isn't beyond the furthest place of any other cell it keeps:
    a few a level. Cells that aren't split give their targets. So the work is some cells a query and level, however the targets
    crowd. A level's cells are broadcast while they are few, and a query's rows then stay where they are; a deeper level is joined
    by a shuffle. Without targets, or without a place of its own, no query has a row.
    """
    own, others = (d.select("id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y")) for d in (queries, targets))
    cells, places = tree(others, few)
    parents = cells.filter((F.col("n") > few) & (F.col("level") < DEEP)).select((F.col("level") + STEP).alias("level"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    met = cells.withColumn("px", F.floor(F.col("cx") / (1 << STEP))).withColumn("py", F.floor(F.col("cy") / (1 << STEP)))
    met = met.join(parents, ["level", "px", "py"], "left_semi").unionByName(met.filter("level = 0"))
    size = {r["level"]: r["n"] for r in met.groupBy("level").agg(F.count("*").alias("n")).collect()}  # a row a level
    if not size:
        return own.select("id", F.col("id").alias("nearest_id"), F.lit(0.0).alias("distance")).limit(0)
    left = own.withColumn("bound", F.lit(math.inf)).withColumn("level", F.lit(-1)).withColumn("cx", F.lit(0).cast("long")).withColumn("cy", F.lit(0).cast("long")).withColumn("least", F.lit(0.0)).withColumn("open", F.lit(True))
    for level in sorted(size):
        there = met.filter(F.col("level") == level).select(F.lit(True).alias("_open"), F.col("px").alias("_px"), F.col("py").alias("_py"), F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), (F.col("n") > few).alias("_more"), "west", "east", "south", "north")
        there = F.broadcast(there) if size[level] <= SMALL else there
        step = left.join(there, (F.col("open") == F.col("_open")) & (F.col("cx") == F.col("_px")) & (F.col("cy") == F.col("_py")), "left")
        new = F.col("_cx").isNotNull()
        step = step.select(
            "id", "x", "y", F.when(new, F.lit(level)).otherwise(F.col("level")).alias("level"), F.coalesce("_cx", "cx").alias("cx"), F.coalesce("_cy", "cy").alias("cy"), F.coalesce(F.col("_more") & F.lit(level < DEEP), F.lit(False)).alias("open"),
            F.when(new, _boxed(F.col("x"), F.col("y"), "least")).otherwise(F.col("least")).alias("least"), "bound", _boxed(F.col("x"), F.col("y"), "most").alias("most"),
        )
        left = step.withColumn("bound", F.least("bound", F.min("most").over(Window.partitionBy("id")))).filter(F.col("least") <= F.col("bound")).drop("most")
    d2 = F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2)
    found = visited(left).join(places, ["level", "cx", "cy"]).groupBy("id").agg(F.min(F.struct(d2.alias("d2"), F.col("target").alias("nearest_id"))).alias("m"))
    return found.select("id", "m.nearest_id", F.sqrt("m.d2").alias("distance"))


def visited(rows: DataFrame) -> DataFrame:
    """The unsplit cells that each query looks into; tests count them."""
    return rows


def cover(x: np.ndarray, y: np.ndarray, halvings: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(k, gx, gy, whole) of cells (side 2 ** k) that cover a polygon: those that no edge touches and that lie inside are whole, and aren't split; those with an edge are, `halvings` times."""
    side = max(np.ptp(x), np.ptp(y), 1e-300)
    k = math.ceil(math.log2(side))
    x2, y2 = np.roll(x, -1), np.roll(y, -1)
    w = 2.0**k
    gx, gy = np.meshgrid(np.arange(math.floor(x.min() / w), math.floor(x.max() / w) + 1), np.arange(math.floor(y.min() / w), math.floor(y.max() / w) + 1))
    gx, gy, out = gx.ravel(), gy.ravel(), []
    def edged(gx: np.ndarray, gy: np.ndarray, w: float) -> tuple[np.ndarray, np.ndarray]:
        """Which cells an edge touches (or nearly), and which have their middle inside."""
        left, low = gx * w, gy * w
        pad = w * 1e-9  # an edge along a border touches both sides
        over = (np.maximum(x, x2)[None] >= left[:, None] - pad) & (np.minimum(x, x2)[None] <= left[:, None] + w + pad) & (np.maximum(y, y2)[None] >= low[:, None] - pad) & (np.minimum(y, y2)[None] <= low[:, None] + w + pad)
        beside = [(x2 - x)[None] * (low[:, None] + dy - y[None]) - (y2 - y)[None] * (left[:, None] + dx - x[None]) for dx in (-pad, w + pad) for dy in (-pad, w + pad)]
        mx, my = (left + w / 2)[:, None], (low + w / 2)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            odd = (((y > my) != (y2 > my)) & (mx < (x2 - x) * (my - y) / (y2 - y) + x)).sum(axis=1) % 2 == 1
        return (over & ~(np.all([b > 0 for b in beside], axis=0) | np.all([b < 0 for b in beside], axis=0))).any(axis=1), odd

    for turn in range(halvings + 1):
        some = max(1, (1 << 20) // len(x))  # cells at a time: their product with the edges is held
        parts = [edged(gx[i : i + some], gy[i : i + some], 2.0 ** (k - turn)) for i in range(0, len(gx), some)]
        touched, odd = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, bool) for i in (0, 1))
        last = turn == halvings
        for chosen, whole in ((~touched & odd, True), (touched & last, False)):
            out.append((np.full(int(chosen.sum()), k - turn), gx[chosen], gy[chosen], np.full(int(chosen.sum()), whole)))
        gx, gy = (np.concatenate([2 * g[touched] + d for d in ds]) for g, ds in ((gx, (0, 0, 1, 1)), (gy, (0, 1, 0, 1))))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def covered(polygons: DataFrame, halvings: int = 4) -> tuple[DataFrame, DataFrame]:
    """(whole, border): distinct cells (k, gx, gy) wholly inside some polygon; cells on a border with the edges (x, y, x2, y2) that a ray to the right from the cell can meet."""

    fields = pa.schema([("k", pa.int32()), ("gx", pa.int64()), ("gy", pa.int64()), ("whole", pa.bool_()), ("edges", pa.list_(pa.struct([(c, pa.float64()) for c in ("x", "y", "x2", "y2")])))])

    def run(batches):
        for b in batches:
            for corners in b.column(0):
                x, y = (np.array([c[a] for c in corners.as_py()], float) for a in ("x", "y"))
                if len(x) < 3:
                    continue
                k, gx, gy, whole = cover(x, y, halvings)
                x2, y2 = np.roll(x, -1), np.roll(y, -1)
                some = max(1, (1 << 20) // len(x))
                for i in range(0, len(k), some):
                    w, west, low, sure = 2.0 ** k[i : i + some, None], gx[i : i + some, None], gy[i : i + some, None], whole[i : i + some, None]
                    own = ~sure & (np.maximum(y, y2) >= low * w) & (np.minimum(y, y2) <= (low + 1) * w) & (np.maximum(x, x2) >= west * w)
                    edge = np.nonzero(own)[1]
                    ends = np.append(0, np.cumsum(own.sum(axis=1))).astype(np.int32)
                    edges = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c[edge]) for c in (x, y, x2, y2)], names=["x", "y", "x2", "y2"]))
                    columns = (k[i : i + some].astype(np.int32), gx[i : i + some], gy[i : i + some], whole[i : i + some], edges)
                    yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=fields)

    both = written(polygons.select("corners").filter("corners IS NOT NULL").repartition(polygons.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "k int, gx long, gy long, whole boolean, edges array<struct<x:double,y:double,x2:double,y2:double>>"))
    return both.filter("whole").select("k", "gx", "gy").distinct(), both.filter("NOT whole").select("k", "gx", "gy", "edges")


def masked(points: DataFrame, polygons: DataFrame, halvings: int = 4) -> DataFrame:
    """points (id, x, y) with `interior`: whether any polygon (corners) holds them; on an edge it is undefined. Ids are unique.

    Points of cells wholly inside are decided untested; those of cells on a border count the edges that a ray to the right crosses, of those
    that can matter in their cell; all others are outside. A point asks once for each size of cells (a few powers of two).
    """
    whole, border = covered(polygons, halvings)
    sizes = sorted(r[0] for r in whole.select("k").union(border.select("k")).distinct().collect())
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("k")))
    asked = points.select("id", "x", "y", F.explode(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>")).alias("k")).withColumn("gx", at("x")).withColumn("gy", at("y"))
    sure = asked.join(whole, ["k", "gx", "gy"], "left_semi").select("id")
    x, y = F.col("x"), F.col("y")
    crossed = lambda e: F.when((e["y"] > y) != (e["y2"] > y), x < (e["x2"] - e["x"]) * (y - e["y"]) / (e["y2"] - e["y"]) + e["x"]).otherwise(F.lit(False))
    tested = asked.join(border, ["k", "gx", "gy"]).filter(F.size(F.filter("edges", crossed)) % 2 == 1).select("id")
    hit = sure.unionByName(tested).distinct().withColumn("_in", F.lit(True))
    return points.join(hit, "id", "left").withColumn("interior", F.coalesce("_in", F.lit(False))).drop("_in")
