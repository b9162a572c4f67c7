"""SimHash near-dedup: bit-sliced comparison of fingerprints within buckets.

Fingerprints within the radius agree in at least k - radius of k blocks of bits, so every pair of
them meets in a bucket of one choice of blocks. A bucket is stored as bit planes: word w of plane p
has bit p of 64 fingerprints. All distances to many fingerprints are kept in carry-save counters, a
plane at a time, and a part of a bucket is abandoned once all its distances exceed the radius. A
bucket hands on a spanning forest of its links, never all pairs; large buckets are split into parts
that meet pairwise.
"""

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from krylake.llm.common import batch, hot_keys, lowered, split_join, table, written
from krylake.llm.components import components

PART = 4096  # fingerprints of a bucket that meet in one piece
FULL_BUCKET = 2048  # bucket size at which one more block is used
PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64 bits, each set if set in over half of the shingles' XXH64 (seed 42); 0 without words."""
    words = lowered(text).split()
    if not words:
        return 0
    plain = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        h = np.array([digest(plain[i:j], 42) for i, j in zip(starts[at : at + (1 << 15)], stops[at : at + (1 << 15)], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp as a signed long) of whole texts."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                own = b.slice(at, 512)
                fp = np.array([fingerprint(t, shingle) for t in own.column(1).to_pylist()], np.uint64)
                yield batch(PRINTS, own.column(0), fp.view(np.int64))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def planes(fp: np.ndarray) -> np.ndarray:
    """(64, words): bit planes, the last word filled up with zeros."""
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((-(-len(fp) // 64) * 64, 64), np.uint8)
    padded[: len(fp)] = bits
    return np.ascontiguousarray(np.packbits(padded.T, axis=1, bitorder="little")).view(np.uint64)


def within(queries: np.ndarray, sliced: np.ndarray, radius: int) -> np.ndarray:
    """(queries, words) masks of the fingerprints within `radius` (at most 6) of each query."""
    rows, words = np.arange(len(queries)), sliced.shape[1]
    out = np.zeros((len(queries), words), np.uint64)
    ones, twos, fours, over = (np.zeros((len(queries), words), np.uint64) for _ in range(4))
    # counters hold 7 - radius at the start: they overflow when a distance exceeds the radius
    start = 7 - radius
    for k, c in enumerate((ones, twos, fours)):
        if start >> k & 1:
            c[:] = ~np.uint64(0)
    flips = np.where((queries[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), ~np.uint64(0), np.uint64(0))
    for p in range(64):
        carry = sliced[p][None, :] ^ flips[:, p, None]
        for c in (ones, twos, fours):
            carry, c[:] = carry & c, c ^ carry
        over |= carry
        if p % 8 == 7 and p < 63:
            alive = (over != ~np.uint64(0)).any(axis=1)
            if not alive.any():
                return out
            if alive.mean() < 0.7:  # queries of which all distances exceed the radius are abandoned
                rows, flips, ones, twos, fours, over = (x[alive] for x in (rows, flips, ones, twos, fours, over))
    out[rows] = ~over
    return out


def forest(fp: np.ndarray, mine: np.ndarray, other: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the first index it is joined to by links between `mine` and `other` (index arrays)."""
    labels, sliced = np.arange(len(fp)), planes(fp[other])
    step = max(1, (1 << 19) // max(1, sliced.shape[1]))
    for at in range(0, len(mine), step):
        own = mine[at : at + step]
        hits = within(fp[own], sliced, radius)
        some = np.flatnonzero(np.bitwise_count(hits).sum(axis=1) > 0)
        for r in some:
            near = other[np.flatnonzero(np.unpackbits(hits[r].view(np.uint8), bitorder="little")[: len(other)])]
            seen = np.unique(labels[np.append(near, own[r])])
            for x in seen[1:]:
                labels[labels == x] = seen[0]
    return labels


def bucket_edges(rows: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between representatives: rows (t, key, piece, side, fp, rep) come sorted by t, key, piece, rep."""

    def run(batches):
        held = None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                if not b.num_rows:
                    continue
                got = [b.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
                held = got if held is None else [np.concatenate(x) for x in zip(held, got, strict=True)]
            if held is None:
                return
            t, key, piece, side, fp, rep = held
            heads = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])))
            ends = np.append(heads[1:], len(t))
            whole = len(heads) if b is None else len(heads) - 1
            a_out, b_out = [], []
            for lo, hi in zip(heads[:whole].tolist(), ends[:whole].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                s = side[lo:hi]
                every = np.arange(hi - lo)
                mine, other = (every, every) if (s == 2).all() else (np.flatnonzero(s == 0), np.flatnonzero(s == 1))
                if not len(mine) or not len(other):
                    continue
                labels = forest(fp[lo:hi].view(np.uint64), mine, other, radius)
                moved = np.flatnonzero(labels != every)
                a_out.append(rep[lo:hi][moved])
                b_out.append(rep[lo:hi][labels[moved]])
            if a_out:
                yield batch(EDGES, np.concatenate(a_out), np.concatenate(b_out))
            if b is None:
                return
            held = [x[heads[-1] :] for x in held]

    return rows.mapInArrow(run, "a long, b long")


def choices(radius: int, distinct: int) -> list[int]:
    """Masks of bits: every pair within `radius` agrees on all bits of at least one; buckets stay small for so many fingerprints."""
    for k in range(radius + 1, radius + 5):
        bounds = [round(i * 64 / k) for i in range(k + 1)]
        blocks = [((1 << bounds[i + 1]) - 1) & ~((1 << bounds[i]) - 1) for i in range(k)]
        if distinct >> (64 * (k - radius) // k) <= FULL_BUCKET:
            break
    return [sum(c) for c in itertools.combinations(blocks, k - radius)]


def linked(prints: DataFrame, radius: int) -> DataFrame:
    """prints (fp, rep: one row a fingerprint): the edges of a spanning forest of all links, perhaps with some more."""
    masks = choices(radius, prints.count())
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    entries = prints.select("fp", "rep", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("key")) for i, m in enumerate(masks)])).alias("e")).select("e.t", "e.key", "fp", "rep")
    hot = entries.groupBy("t", "key").agg(F.count("*").alias("c")).filter(F.col("c") > PART).select("t", "key", F.ceil(F.col("c") / PART).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    # a bucket of several parts: every two parts meet in a piece of their own; side tells them apart, 2 is a part with itself
    dealt = entries.join(hot, ["t", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    piece = F.least("own", "with") * F.col("parts") + F.greatest("own", "with")
    side = F.when(F.col("own") == F.col("with"), 2).when(F.col("own") < F.col("with"), 0).otherwise(1)
    rows = dealt.select("t", "key", piece.cast("int").alias("piece"), side.cast("int").alias("side"), "fp", "rep")
    return bucket_edges(rows.repartition("t", "key", "piece").sortWithinPartitions("t", "key", "piece", "rep"), radius)


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of `docs` (doc_id, text; others are ignored).

    Documents whose fingerprints differ in at most `radius` bits are linked; component_id is the
    smallest doc_id that links reach. Texts without words (null, empty, blanks) have fingerprint 0 and
    are linked like any other. A row without doc_id links as any other does; its component_id is null if
    no row that it reaches has one. Rows that repeat each get a row; no rows give none.
    """
    prints = written(fingerprints(docs, shingle))
    own = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(linked(own.select("fp", F.col("fp").alias("rep")), radius))  # a fingerprint is its own number
    told = own.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    groups = written(told.join(told.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("fp", "component_id"))
    return split_join(prints, groups, "fp", hot_keys(prints, "fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
