"""Mixture-controlled packing: deficit round-robin over source queues, window after window.

Every source has a queue of tokens. In each round a queue earns tokens by its target proportion and,
when it has earned a quantum, hands over its next quantum; what it is owed beyond that is its deficit,
which it carries on. Quantum j of a queue with the target w therefore falls due at the time
(j + 1/2) * quantum / w, and the order of all quanta by due time (ties by queue) is known without playing
the rounds: how many quanta of each queue come before a given one is arithmetic over the queues' totals.
So each task places its documents in the global stream by itself, deficits carry over from one window and
partition to the next, and only sums per task and source are shuffled. A queue that is used up has no
quanta left, so the others share its part by their targets. Without targets they are the corpus's own
proportions, and all queues last to the end.
"""

import functools
import json
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from krylake.llm.common import table, written

END = 0
SPECIAL = "<|endoftext|>"
SOURCES = 4096  # queues: beyond, the sources with the fewest tokens share the last one
ROWS = pa.schema([("part", pa.int32()), ("source", pa.string()), ("doc_id", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.cache
def encoder(path: str):
    """Text to ids of the byte-level BPE in a tokenizer.json. Its merges stand in the order of the ids, so ranks encode alike (and faster)."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # byte-level BPE writes these bytes as themselves, others from 256 on
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in added}
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if SPECIAL not in text or SPECIAL not in added:
            return bpe.encode_ordinary(text)
        first, *rest = text.split(SPECIAL)
        return functools.reduce(lambda ids, x: [*ids, added[SPECIAL], *bpe.encode_ordinary(x)], rest, bpe.encode_ordinary(first))

    return encode


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """ids of each document and the tokens of its source before it in its task; written, so that later reads agree."""

    def run(batches):
        encode, part, before = encoder(path), TaskContext.get().partitionId(), Counter()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                out = []
                own = b.slice(at, 256)
                for doc_id, source, text in zip(*[c.to_pylist() for c in own.columns], strict=True):
                    ids = np.array([*encode(text or ""), END], "<u4")
                    q = source or ""
                    out.append((part, q, doc_id, before[q], len(ids), ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes()))
                    before[q] += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ROWS, strict=True)], schema=ROWS)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")
    return written(rows.mapInArrow(run, "part int, source string, doc_id long, before long, n long, ids binary"), "zstd")


def place(totals: np.ndarray, weights: np.ndarray, queue: np.ndarray, j: np.ndarray, quantum: int) -> np.ndarray:
    """Where quantum j of a queue begins in the global stream: the tokens of all quanta due before it."""
    due = (j + 0.5) * quantum / weights[queue]
    out = np.zeros(len(j), np.int64)
    for q in np.flatnonzero(totals):
        total, last, weight = int(totals[q]), -(-int(totals[q]) // quantum), float(weights[q])
        low = np.clip(np.floor(np.minimum(due * weight / quantum, last + 2.0) - 0.5).astype(np.int64) - 1, 0, last)
        count = low.copy()
        for k in range(4):  # rounding may be off by one either way: compare the due times themselves
            mine = (low + k + 0.5) * quantum / weight
            count += (low + k < last) & ((mine < due) | ((mine == due) & (q < queue)))
        count = np.where(queue == q, j, count)
        out += np.minimum(count * quantum, total)
    return out


def weighed(names: list[str], totals: np.ndarray, targets: dict[str, float] | None) -> np.ndarray:
    """What each queue earns a round: its target; sources without one share what targets leave of 1 by their tokens, and come last where nothing is left."""
    if not targets:
        return totals.astype(float)
    own = np.array([max(0.0, float(targets.get(x, 0.0))) for x in names])
    rest = np.where([x in targets for x in names], 0, totals)
    out = own + max(0.0, 1.0 - own.sum()) * rest / max(1, rest.sum())
    return np.where(out > 0, out, (out[out > 0].min() if (out > 0).any() else 1.0) * 1e-9 * totals / max(1, totals.sum()))


def cut(totals: np.ndarray, weights: np.ndarray, queue: np.ndarray, start: np.ndarray, n: np.ndarray, quantum: int, window: int) -> tuple:
    """(document's index, its ids before, length, global position) of each piece; a piece stays within a window."""
    first, last = start // quantum, (start + n - 1) // quantum
    doc = np.repeat(np.arange(len(n)), last - first + 1)
    j = np.arange(len(doc)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[doc]
    a, b = np.maximum(j * quantum, start[doc]), np.minimum((j + 1) * quantum, (start + n)[doc])
    at = place(totals, weights, queue[doc], j, quantum) + a - j * quantum
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (at[1:] != (at + b - a)[:-1])  # neighbours in the stream stay together
    h = np.flatnonzero(head)
    doc, pre, at, size = doc[h], (a - start[doc])[h], at[h], np.add.reduceat(b - a, h)
    w0, w1 = at // window, (at + size - 1) // window
    k = np.repeat(np.arange(len(h)), w1 - w0 + 1)
    w = np.arange(len(k)) - np.repeat(np.cumsum(w1 - w0 + 1) - (w1 - w0 + 1), w1 - w0 + 1) + w0[k]
    lo, hi = np.maximum(w * window, at[k]), np.minimum((w + 1) * window, (at + size)[k])
    return doc[k], pre[k] + lo - at[k], hi - lo, lo


def pack(docs: DataFrame, path: str, window: int = 1024, quantum: int = 256, targets: dict[str, float] | None = None, sources: int = SOURCES) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all rows of `docs`.

    docs: doc_id, source, text; others are ignored. A null or empty text is its end token alone; a
    null source is the source "". targets: the share of each window's tokens that a source is to have
    (default: its share of all tokens). A source is a queue, up to `sources` of them: beyond, those with the
    fewest tokens share the last queue. Every sequence but the last holds exactly `window` tokens. Rows that
    repeat are packed each. No rows, no pieces.
    """
    rows = tokenized(docs, path)
    sums = written(rows.groupBy("part", "source").agg(F.sum("n").alias("tokens")))
    own = sums.groupBy("source").agg(F.sum("tokens").alias("t")).orderBy(F.desc("t"), "source").limit(sources).collect()
    names = [r["source"] for r in own]
    number = {x: i for i, x in enumerate(names)}
    if len(names) == sources:  # the last one stands for all others too
        numbered = sums.join(F.broadcast(docs.sparkSession.createDataFrame(list(number.items()), "source string, queue int")), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(sources - 1)))
        totals = np.zeros(sources, np.int64)
        for r in numbered.groupBy("queue").agg(F.sum("tokens").alias("t")).collect():
            totals[r["queue"]] = r["t"]
    else:
        numbered = sums.join(F.broadcast(docs.sparkSession.createDataFrame(list(number.items()), "source string, queue int")), "source")
        totals = np.array([r["t"] for r in own], np.int64)
    weights = weighed(names, totals, targets)
    earlier = Window.partitionBy("queue").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    bases = numbered.select("part", "source", "queue", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            queue, start, n = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))
            doc, pre, size, at = cut(totals, weights, queue, start, n, quantum, window)
            blobs = [np.frombuffer(x, "<u2" if len(x) == 2 * k else "<u4").astype("<u4").tobytes() for x, k in zip(b.column(4).to_pylist(), n.tolist(), strict=True)]
            crc = [zlib.crc32(memoryview(blobs[d])[4 * p : 4 * (p + s)]) for d, p, s in zip(doc.tolist(), pre.tolist(), size.tolist(), strict=True)]
            ids = b.column(0).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([ids, pa.array(pre), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(at // window), pa.array(at % window)], schema=PIECES)

    return rows.join(bases, ["part", "source"]).select("doc_id", "queue", (F.col("base") + F.col("before")).alias("start"), "n", "ids").mapInArrow(run, PIECES_DDL)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
