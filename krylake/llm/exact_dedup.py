"""Exact dedup: binary-fuse filters over immutable snapshots screen the digests of a new batch.

Texts are equal when identical after lower-casing A-Z. A snapshot is a table of digests that no
longer changes; it keeps one binary-fuse filter per bucket of digests. A new batch is first grouped
on its own; the digests that a filter lets through join the snapshot's exact buckets, and whatever
then has company is compared byte by byte. Copies are grouped before they are shuffled, so a text
that a third of all rows share costs a row per task.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from krylake.llm.common import batch, hot_keys, lowered, mixed, split_join, table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKET_ROWS = 200_000
DIGESTS = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary())])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and SHA-256 of the normalised text; a null text counts as empty."""

    def run(batches):
        for b in batches:
            yield batch(DIGESTS, b.column(0), [hashlib.sha256(lowered(t)).digest() for t in b.column(1).to_pylist()])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, sha binary")


def fuse_slots(keys: np.ndarray, seed: int, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots in consecutive segments, and an 8-bit fingerprint, for each key."""
    h = mixed(keys ^ mixed(np.array([seed], np.uint64)))
    first = ((h >> np.uint64(40)) * np.uint64(segments)) >> np.uint64(24)
    mask, spread = np.uint64(length - 1), mixed(h)
    slots = np.stack([(first + np.uint64(j)) * np.uint64(length) + ((spread >> np.uint64(20 * j)) & mask) for j in range(3)])
    return slots.astype(np.int64), (h ^ (h >> np.uint64(32))).astype(np.uint8)


def fuse_build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, table) of a static filter over distinct keys."""
    n = max(2, len(keys))
    length = 1 << max(2, min(18, int(np.log(n) / np.log(3.33) + 2.25)))
    space = n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
    for seed in range(1, 1000):
        segments = max(1, int(np.ceil(space / length)) - 2)
        size = (segments + 2) * length
        slots, prints = fuse_slots(keys, seed, length, segments)
        alive, rounds = np.arange(len(keys)), []
        while len(alive):
            degree = np.bincount(slots[:, alive].ravel(), minlength=size)
            single = degree[slots[:, alive]] == 1
            free = single.any(axis=0)
            if not free.any():
                break
            rounds.append((alive[free], single.argmax(axis=0)[free]))
            alive = alive[~free]
        if len(alive):
            space *= 1.02
            continue
        cells = np.zeros(size, np.uint8)
        for who, own in reversed(rounds):  # a slot of its own in its round: no other key of that round touches it
            cells[slots[own, who]] = prints[who] ^ cells[slots[(own + 1) % 3, who]] ^ cells[slots[(own + 2) % 3, who]]
        return seed, length, segments, cells.tobytes()
    raise ValueError("no seed fits: keys repeat")


def fuse_holds(keys: np.ndarray, seed: int, length: int, segments: int, cells: bytes) -> np.ndarray:
    """True for every key built in, and for about one in 256 others."""
    slots, prints = fuse_slots(keys, seed, length, segments)
    found = np.frombuffer(cells, np.uint8)[slots]
    return (found[0] ^ found[1] ^ found[2]) == prints


def snapshot(digest_rows: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Exact buckets (bucket, key, sha, n) of a snapshot, and a filter for each bucket."""
    exact = keyed(digest_rows, buckets)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, length, segments, cells = fuse_build(np.unique(pdf["key"].to_numpy(np.int64).view(np.uint64)))
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "seed": [seed], "length": [length], "segments": [segments], "cells": [cells]})

    return exact, exact.select("bucket", "key").groupBy("bucket").applyInPandas(build, "bucket int, seed long, length long, segments long, cells binary")


def keyed(digest_rows: DataFrame, buckets: int) -> DataFrame:
    """One row per distinct digest: how many rows have it, its 64-bit key and its bucket."""
    grouped = digest_rows.groupBy("sha").agg(F.count("*").alias("n"))
    return grouped.withColumn("key", F.xxhash64("sha")).withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))


def screened(batch_keys: DataFrame, filters: DataFrame) -> DataFrame:
    """The digests of the batch that a snapshot's filter lets through."""

    def screen(keys: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if keys.empty or own.empty:
            return keys[["sha"]].iloc[:0]
        f = own.iloc[0]
        return keys.loc[fuse_holds(keys["key"].to_numpy(np.int64).view(np.uint64), int(f.seed), int(f.length), int(f.segments), f.cells), ["sha"]]

    return batch_keys.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(screen, "sha binary")


def exact_dedup(docs: DataFrame, is_new=None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of `docs`.

    docs: doc_id, text; other columns are ignored. is_new: a boolean Column that tells the incoming
    batch from the snapshot (default: a quarter of the rows by a hash of doc_id). A null text equals
    an empty one. Of equal texts the largest doc_id stays. An empty table gives an empty result. Rows
    that repeat a doc_id each get a row and count in group_size.
    """
    new = F.coalesce(is_new if is_new is not None else F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0, F.lit(True))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", new.alias("new"))
    old, fresh = (digests(docs.filter(c)).withColumn("new", F.lit(v)) for v, c in ((False, ~F.col("new")), (True, F.col("new"))))
    rows = written(old.unionByName(fresh))
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    exact, filters = snapshot(rows.filter(~F.col("new")), buckets)
    incoming = keyed(rows.filter("new"), buckets)
    through = screened(incoming, filters).join(exact.select("sha"), "sha", "left_semi")
    company = through.select("sha").unionByName(exact.filter("n > 1").select("sha")).unionByName(incoming.filter("n > 1").select("sha")).distinct()
    company = written(company)
    hot = hot_keys(rows, "sha")
    suspects = split_join(rows, company, "sha", hot).select("doc_id", "sha").distinct()
    plain = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    texts = docs.join(suspects, docs.doc_id.eqNullSafe(suspects.doc_id)).select(docs.doc_id, "sha", plain.alias("plain")).filter(F.sha2(F.col("plain").cast("binary"), 256) == F.lower(F.hex("sha")))
    groups = written(texts.groupBy("sha", "plain").agg(F.max("doc_id").alias("keep"), F.count("*").alias("size")))
    by_sha = groups.groupBy("sha").agg(F.count("*").alias("variants"), F.max("keep").alias("keep"), F.max("size").alias("size"))
    clash = by_sha.filter("variants > 1").select("sha")
    found = split_join(rows, written(by_sha.filter("variants = 1")), "sha", hot, "left")
    if clash.isEmpty():
        told = found
    else:  # different texts with one digest: told apart by their bytes
        apart = texts.join(clash, "sha", "left_semi").join(groups, ["sha", "plain"]).select("doc_id", "sha", F.col("keep").alias("k2"), F.col("size").alias("s2")).distinct()
        told = found.join(apart, ["doc_id", "sha"], "left").withColumn("keep", F.coalesce("keep", "k2")).withColumn("size", F.coalesce("size", "s2"))
    keep = F.coalesce("keep", "doc_id")
    return told.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), (keep.eqNullSafe(F.col("doc_id"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256 FROM d JOIN g USING (h)
"""
