"""Embedding near-dedup: navigable small-world graphs per shard, audited searches, components of the links.

Equal vectors of a label are one node with a multiplicity. The nodes of a label are dealt to shards
of bounded size, each with a hierarchical small-world graph. Every node queries every shard of its
label in blocks of bounded size; beams widen until an audit against full scans finds the wanted
recall over all shards of a label together, and for a query alone while its whole beam still lies within the radius. Cosines are verified
in double precision. A block hands on counts and a spanning forest of its links, never all pairs.
"""

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from krylake.llm.common import batch, mixed, table, written
from krylake.llm.components import components

COSINE = 0.98
SHARD, BLOCK = 2048, 8192  # nodes of a graph, queries of a block
LINKS, BEAM, BATCH = 12, 32, 256  # links a node chooses, smallest beam, nodes or queries searched at once
RECALL = 0.99  # that audits ask for
AUDITED, TRUTH, BEAMS = 64, 100, 16  # queries of a label audited at first (16 times as many in each further round), links that an audit must see, widths of beams that are tried
VECTORS = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("vec", pa.binary())])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vec): double-precision bytes of the vectors that can be linked, null for the others."""

    def run(batches):
        for b in batches:
            vec = []
            for x, label in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = None if x is None or label is None or None in x else np.array(x, np.float64)
                vec.append(v.tobytes() if v is not None and np.isfinite(v).all() and v.any() else None)
            yield batch(VECTORS, b.column(0), b.column(1), vec)

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "vec_id long, label long, vec binary")


def unit(vecs: list[bytes]) -> np.ndarray:
    """Rows of length one; scaled first, so that huge or tiny components don't overflow."""
    v = np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Graph:
    """Levels of neighbour lists over unit vectors; node indices everywhere, -1 for none."""

    def __init__(self, v: np.ndarray, levels: list[np.ndarray]):
        self.v, self.levels = v, levels

    def search(self, q: np.ndarray, beam: int, upto: int = 0, entry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Beams (queries, beam) of nodes and cosines, best first, after descending the levels down to `upto`; all queries in step."""
        at = np.zeros((len(q), 1), np.int64) if entry is None else entry
        for level in range(len(self.levels) - 1, upto - 1, -1):
            at, cos = self._walk(q, at, self.levels[level], beam if level == upto else 4)
        return at, cos

    def _walk(self, q, entry, links, beam):
        n = len(q)
        ids, cos = np.full((n, beam), -1), np.full((n, beam), -np.inf)
        entry = entry[:, :beam]
        k = entry.shape[1]
        ids[:, :k] = entry
        cos[:, :k] = np.where(entry >= 0, np.einsum("nkd,nd->nk", self.v[entry], q), -np.inf)
        done, seen, rows = np.zeros((n, beam), bool), np.zeros((n, len(self.v)), bool), np.arange(n)
        seen[rows[:, None], np.maximum(entry, 0)] |= entry >= 0
        while len(rows):
            open_ = np.where(done[rows] | (ids[rows] < 0), -np.inf, cos[rows])
            best = open_.argmax(axis=1)
            go = open_[np.arange(len(rows)), best] > -np.inf
            rows, best = rows[go], best[go]
            if not len(rows):
                break
            done[rows, best] = True
            near = links[ids[rows, best]]
            fresh = (near >= 0) & ~seen[rows[:, None], np.maximum(near, 0)]
            seen[rows[:, None], np.maximum(near, 0)] |= near >= 0
            c = np.where(fresh, np.einsum("nkd,nd->nk", self.v[near], q[rows]), -np.inf)
            all_ids, all_cos = np.concatenate([ids[rows], np.where(fresh, near, -1)], 1), np.concatenate([cos[rows], c], 1)
            all_done = np.concatenate([done[rows], np.zeros(near.shape, bool)], 1)
            order = np.argsort(-all_cos, axis=1, kind="stable")[:, :beam]
            ids[rows], cos[rows], done[rows] = (np.take_along_axis(x, order, 1) for x in (all_ids, all_cos, all_done))
        return ids, cos


def chosen(v: np.ndarray, own: np.ndarray, ids: np.ndarray, cos: np.ndarray, most: int) -> np.ndarray:
    """Of candidates, best first, those nearer to the node than to any one chosen before, filled up with the nearest others."""
    n, k = ids.shape
    order = np.argsort(-cos, axis=1, kind="stable")
    ids, cos = np.take_along_axis(ids, order, 1), np.take_along_axis(cos, order, 1)
    again = np.tril(ids[:, :, None] == ids[:, None, :], -1).any(axis=2)
    ids = np.where((ids == own[:, None]) | again | ~np.isfinite(cos), -1, ids)
    x = v[ids]
    between = np.einsum("nid,njd->nij", x, x)
    pick, count = np.zeros((n, k), bool), np.zeros(n, int)
    for j in range(k):
        near = np.where(pick, between[:, j], -np.inf).max(axis=1)
        take = (ids[:, j] >= 0) & (cos[:, j] > near) & (count < most)
        pick[:, j] = take
        count += take
    rank = np.where(pick, 0, np.where(ids >= 0, 1, 2)) * k + np.arange(k)
    out = np.take_along_axis(np.where(ids >= 0, ids, -1), np.argsort(rank, axis=1)[:, :most], 1)
    return np.pad(out, ((0, 0), (0, max(0, most - out.shape[1]))), constant_values=-1)


def build(v: np.ndarray, seeds: np.ndarray) -> Graph:
    """A graph over unit vectors; a node's level comes from a hash of its id, a tenth of a level's nodes also lie in the next."""
    n = len(v)
    height = np.minimum(6, (-np.log((mixed(seeds.view(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2**53 + 1e-18) / np.log(10)).astype(int))
    top = height.argmax()  # the search's first entry becomes node 0
    order = np.concatenate([[top], np.delete(np.arange(n), top)])
    inverse = np.argsort(order)
    g = Graph(v[order], [])
    height = height[order]
    for level in range(int(height.max()), -1, -1):
        members = np.flatnonzero(height >= level)
        members = members[np.argsort(-height[members], kind="stable")]  # entries from the levels above come first
        links = np.full((n, 2 * LINKS), -1)
        g.levels.insert(0, links)
        entry_graph = Graph(g.v, g.levels[1:])
        at = 0
        while at < len(members):
            new = members[at : at + min(BATCH, max(16, at))]
            q = g.v[new]
            ids, cos = new[None, :].repeat(len(new), 0), q @ q.T
            if at:
                start = np.zeros((len(new), 1), np.int64)
                if g.levels[1:]:
                    start = np.concatenate([start, entry_graph.search(q, 4)[0]], 1)
                    start[:, 1:][start[:, 1:] == 0] = -1
                found, near = g._walk(q, start, links, BEAM)
                ids, cos = np.concatenate([ids, found], 1), np.concatenate([cos, np.where(found >= 0, near, -np.inf)], 1)
            best = np.argsort(-cos, axis=1, kind="stable")[:, : BEAM + 1]
            picks = chosen(g.v, new, np.take_along_axis(ids, best, 1), np.take_along_axis(cos, best, 1), LINKS)
            links[new, :LINKS] = picks
            back = np.stack([picks.ravel(), np.repeat(new, LINKS)])[:, picks.ravel() >= 0]
            back = back[:, np.argsort(back[0], kind="stable")]
            heads = np.flatnonzero(np.append(True, back[0, 1:] != back[0, :-1])[: back.shape[1]])
            for lo, hi in zip(heads.tolist(), np.append(heads[1:], back.shape[1]).tolist(), strict=False):
                node = back[0, lo]
                own = np.unique(np.concatenate([links[node][links[node] >= 0], back[1, lo:hi]]))
                if len(own) > 2 * LINKS:
                    own = chosen(g.v, np.array([node]), own[None], (g.v[own] @ g.v[node])[None], 2 * LINKS)[0]
                links[node] = -1
                links[node, : len(own)] = own
            at += len(new)
    out = Graph(v, [])
    for links in g.levels:  # back to the order of the input
        out.levels.append(np.where(links >= 0, order[links], -1)[inverse])
    out.entry = int(top)
    return out


def audited(queries: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
    """For audited queries and a shard: the links other than with themselves that a full scan finds, and those that each beam finds."""
    if queries.empty or own.empty:
        return pd.DataFrame({"label": [], "dim": [], "beam": [], "hit": [], "truth": []}).astype("int64")
    g, ids, _ = shard_of(own.iloc[0])
    reps, out, first = queries["rep"].to_numpy(np.int64), Counter(), own.iloc[0]
    sizes = [BEAM << i for i in range(max(1, int(np.ceil(np.log2(max(2, len(ids)) / BEAM))) + 1))]
    for at in range(0, len(reps), BATCH):
        q = unit(queries["vec"].iloc[at : at + BATCH].tolist())
        truth = (q @ g.v.T >= COSINE) & (reps[at : at + BATCH, None] != ids)
        some = np.flatnonzero(truth.any(axis=1))
        for beam in sizes if len(some) else []:
            (a, b), _ = beams(g, q[some], beam)
            hit = int(truth[some][a, b].sum())
            out[beam] += hit
        out[0] += int(truth.sum())
    most = out[sizes[-1]]  # wider beams than this shard has nodes find what the widest finds
    rows = [(beam, out[beam] if beam in sizes else most, out[0]) for beam in (BEAM << i for i in range(BEAMS))]
    return pd.DataFrame(rows, columns=["beam", "hit", "truth"]).assign(label=first.label, dim=first.dim)[["label", "dim", "beam", "hit", "truth"]]


def audit(dealt: DataFrame, built: DataFrame) -> DataFrame:
    """(label, dim, beam, recall, truth): the smallest beam whose recall over all shards of a label together reaches RECALL.

    Queries are drawn until a label has shown TRUTH links, at last all its nodes: then the scan was full, and a label
    without a link has recall 1 by that. Raises if the widest beam misses the recall.
    """
    keys, most = ["label", "dim", "shard"], AUDITED
    sizes = dealt.groupBy("label", "dim").agg(F.count("*").alias("size"))
    largest = sizes.agg(F.max("size")).first()[0] or 0
    left, done = dealt, None
    while True:
        chance = F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 30)) < F.lit((most + 6 * most**0.5 + 10) * (1 << 30)) / F.col("size")
        own = left.join(sizes, ["label", "dim"]).filter(chance).select("label", "dim", "rep", "vec", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
        got = own.groupBy(*keys).cogroup(built.groupBy(*keys)).applyInPandas(audited, "label long, dim int, beam long, hit long, truth long")
        got = got.groupBy("label", "dim", "beam").agg(F.sum("hit").alias("hit"), F.sum("truth").alias("truth"))
        best = got.withColumn("recall", F.when(F.col("truth") == 0, 1.0).otherwise(F.col("hit") / F.col("truth"))).groupBy("label", "dim").agg(
            F.min(F.when(F.col("recall") >= RECALL, F.struct("beam", "recall"))).alias("b"), F.max("truth").alias("truth")
        )
        best = written(best.select("label", "dim", "b.beam", "b.recall", "truth"))
        if not best.filter("beam IS NULL").isEmpty():
            raise RuntimeError("the widest beam misses the recall")
        settled = best.join(sizes, ["label", "dim"]).filter((F.col("truth") >= TRUTH) | (F.col("size") <= most)).drop("size")
        done = settled if done is None else done.unionByName(settled)
        if most >= largest:
            return written(done)
        left = left.join(settled.select("label", "dim"), ["label", "dim"], "left_anti")
        if left.isEmpty():
            return written(done)
        most *= 16


def beams(g: Graph, q: np.ndarray, beam: int) -> tuple[tuple[np.ndarray, np.ndarray], None]:
    """Pairs within the radius; a query whose beam ends within it searches again with a beam four times as wide, at last the whole shard."""
    rows, left = [np.zeros(0, np.int64)], np.arange(len(q))
    cols = [np.zeros(0, np.int64)]
    while len(left):
        again = []
        for at in range(0, len(left), BATCH):
            own = left[at : at + BATCH]
            if beam * 4 >= len(g.v):
                r, c = np.nonzero(q[own] @ g.v.T >= COSINE)
                rows.append(own[r])
                cols.append(c)
                continue
            ids, cos = g.search(q[own], beam, entry=np.full((len(own), 1), g.entry))
            full = cos[:, -1] >= COSINE
            again.append(own[full])
            r, k = np.nonzero((cos >= COSINE) & (ids >= 0) & ~full[:, None])
            rows.append(own[r])
            cols.append(ids[r, k])
        left, beam = np.concatenate(again) if again else left[:0], beam * 4
    pairs = np.unique(np.concatenate(rows) * len(g.v) + np.concatenate(cols))
    return (pairs // len(g.v), pairs % len(g.v)), None


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n indices reaches over the pairs (a, b)."""
    labels = np.arange(n)
    while True:
        before = labels.copy()
        low = np.minimum(labels[a], labels[b])
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        labels = labels[labels]
        if (labels == before).all():
            return labels


def graphs(nodes: DataFrame) -> DataFrame:
    """(label, dim, shard, rep, ids, mult, vecs, links, entry): a row for each shard's graph."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        g = build(unit(pdf["vec"].tolist()), pdf["rep"].to_numpy(np.int64))
        levels = np.stack(g.levels).astype(np.int16 if len(pdf) < 1 << 15 else np.int32)
        first = pdf.iloc[0]
        return pd.DataFrame({"label": [first.label], "dim": [first.dim], "shard": [first.shard], "ids": [pdf["rep"].to_numpy(np.int64).tobytes()], "mult": [pdf["mult"].to_numpy(np.int64).tobytes()], "vecs": [b"".join(pdf["vec"])], "links": [levels.tobytes()], "levels": [len(levels)], "entry": [g.entry]})

    return nodes.groupBy("label", "dim", "shard").applyInPandas(run, "label long, dim int, shard int, ids binary, mult binary, vecs binary, links binary, levels int, entry int")


def shard_of(s) -> tuple[Graph, np.ndarray, np.ndarray]:
    """Graph, ids and multiplicities of a row that graphs() made."""
    ids, mult = np.frombuffer(s.ids, np.int64), np.frombuffer(s.mult, np.int64)
    n, size = len(ids), len(s.links) // (s.levels * len(ids) * 2 * LINKS)
    g = Graph(unit([s.vecs[i * len(s.vecs) // n : (i + 1) * len(s.vecs) // n] for i in range(n)]), list(np.frombuffer(s.links, np.int16 if size == 2 else np.int32).reshape(s.levels, n, 2 * LINKS).astype(np.int64)))
    g.entry = int(s.entry)
    return g, ids, mult


def answers(queries: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
    """For a block of queries and a shard: links by query (a, n) and edges (a, b) of a spanning forest."""
    if queries.empty or own.empty:
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
    g, ids, mult = shard_of(own.iloc[0])
    reps = queries["rep"].to_numpy(np.int64)
    (a, b), _ = beams(g, unit(queries["vec"].tolist()), int(own["beam"].iloc[0]))
    other = reps[a] != ids[b]
    a, b = a[other], b[other]
    links = np.bincount(a, mult[b], minlength=len(reps)).astype(np.int64)
    names = np.unique(np.concatenate([reps[a], ids[b]]))
    label = joined(len(names), np.searchsorted(names, reps[a]), np.searchsorted(names, ids[b])) if len(names) else np.zeros(0, int)
    moved = np.flatnonzero(label != np.arange(len(names)))
    some = np.flatnonzero(links)
    edges = pd.DataFrame({"a": names[moved], "b": names[label[moved]], "n": 0})
    return pd.concat([edges, pd.DataFrame({"a": reps[some], "b": reps[some], "n": links[some]})])


def near_vectors(vectors: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of `vectors` (vec_id, embedding, label; others are ignored).

    Vectors are compared within a label and a dimension. Null, zero and non-finite vectors and those
    with a null component or label are linked to nothing: n_links 0, component_id their own. Equal
    vectors are linked to each other. Rows that repeat a vec_id count as vectors of their own, whatever
    else has it; a row without vec_id links as any other does, and its component_id is null if no row
    that it reaches has one. No rows, no answer.
    """
    rows = written(usable(vectors))
    nodes = rows.filter("vec IS NOT NULL").groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("mult")).withColumn("dim", F.octet_length("vec"))
    nodes = written(nodes.withColumn("rep", F.monotonically_increasing_id()))  # a number for each different vector
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("size")).withColumn("shards", F.ceil(F.col("size") / shard).cast("int")).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    dealt = nodes.join(sizes.drop("size"), ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("shards")).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("blocks")).cast("int"))
    dealt = written(dealt)
    built = written(graphs(dealt.select("label", "dim", "shard", "rep", "mult", "vec")))
    meet = built.join(F.broadcast(audit(dealt, built).select("label", "dim", "beam")), ["label", "dim"]).join(sizes.select("label", "dim", "blocks"), ["label", "dim"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = dealt.select("label", "dim", "block", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "rep", "vec")
    keys = ["label", "dim", "shard", "block"]
    out = written(asked.groupBy(*keys).cogroup(meet.groupBy(*keys)).applyInPandas(answers, "a long, b long, n long"))
    counts = out.filter("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    groups = components(out.filter("a <> b").select("a", "b"))
    own = written(nodes.join(groups, F.col("rep") == F.col("node"), "left").select("label", "vec", "rep", "mult", "least", F.coalesce("component", "rep").alias("group")))
    told = own.join(own.groupBy("group").agg(F.min("least").alias("component")), "group").join(counts, "rep", "left").select("label", "vec", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component")
    linked = rows.filter("vec IS NOT NULL").join(told, ["label", "vec"]).select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.filter("vec IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
