"""Ranked lexical search over an inverted index in shards: Block-Max MaxScore, then the shards' heaps are merged.

A shard is a stretch of documents of one part of the table. For each of its terms the index has a row: the
documents that hold it (numbers within the shard, as gaps) and how often, in compressed blocks of up to 128, and
beside them, uncompressed, each block's last document, greatest count and shortest document. From the latter two
follows what the block can give at most, whatever the corpus's statistics turn out to be.

A query's lists of a shard are ordered by the most that they can give. The threshold is the score of the tenth
best among documents that are scored first, those of the strongest lists. Lists that together can't reach it are
not essential: only documents of the other lists are candidates. The non-essential lists are then taken in turn, the
strongest first; a candidate stays while what it has, what its block of the list can give and what all later lists can
give reach the threshold, and only blocks with such a candidate are decompressed. Nothing that could tie is rejected.
"""

import itertools
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from krylake.llm.common import table, written

BLOCK = 128
WORDS = 1 << 20  # of a shard, about: documents are whole
ITEMS = 256  # queries that a task answers together
SMALL = 1 << 18  # pairs of a query and a term up to which they are broadcast (some 20 MB)
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or c >= 97 and c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = "shard long, term binary, n_docs long, tokens long, last binary, most binary, least binary, place binary, data binary"
INDEX_FIELDS = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("n_docs", pa.int64()), ("tokens", pa.int64()), *[(c, pa.binary()) for c in ("last", "most", "least", "place", "data")]])
BEST = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms(text: str | None) -> list[bytes]:
    """Runs of letters, digits and whatever isn't ASCII; A-Z as a-z."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split()


def slices(data: bytes, ends: np.ndarray) -> pa.Array:
    """One binary array of consecutive slices."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype("<i8").tobytes()), pa.py_buffer(data)]).cast(pa.binary())


def widths(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bytes that the largest value of each block takes: 1, 2 or 4."""
    top = np.maximum.reduceat(values, starts)
    return np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, 4))


def squeezed(values: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, each as wide as told, and where each begins."""
    at = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    for k in range(4):
        wide = width > k
        out[at[wide] + k] = (values[wide] >> (8 * k)) & 255
    return out, at


class Shard:
    """Documents gathered until there are enough of them; then rows of the index."""

    def __init__(self):
        self.ids, self.sizes, self.words, self.total = [], [], [], 0
        self.number: dict[bytes, int] = defaultdict(itertools.count().__next__)

    def add(self, doc_id: int | None, text: str | None) -> None:
        own = terms(text)
        self.ids.append(doc_id)
        self.sizes.append(len(own))
        self.total += len(own)
        self.words.append(np.fromiter(map(self.number.__getitem__, own), np.int64, len(own)))

    def rows(self, shard: int) -> pa.RecordBatch:
        """A row a term, and one with a null term for the documents: their ids (`data`), whether these are null (`place`) and their lengths (`least`)."""
        sizes, n = np.array(self.sizes, np.int64), len(self.ids)
        doc = np.repeat(np.arange(n), sizes)
        key, count = np.unique(np.concatenate([*self.words, np.empty(0, np.int64)]) * n + doc, return_counts=True)
        term, doc = key // n, key % n
        columns: list[list] = [[None], [int((sizes > 0).sum())], [int(sizes.sum())], [b""], [b""], [sizes.astype("<i4").tobytes()], [np.array([x is None for x in self.ids], "u1").tobytes()], [np.array([x or 0 for x in self.ids], "<i8").tobytes()]]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, list(INDEX_FIELDS)[1:], strict=True)]
        if len(term):
            first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
            df = np.diff(np.append(first, len(term)))
            inside = np.arange(len(term)) - np.repeat(first, df)
            head = inside % BLOCK == 0
            starts, block = np.flatnonzero(head), np.cumsum(head) - 1
            ends = np.append(starts[1:], len(term))
            gap = np.where(head, 0, doc - np.concatenate([[0], doc[:-1]]))  # a block's first document is told in `place`
            wide_gap, wide_count = widths(gap, starts), widths(count, starts)
            gaps, gap_at = squeezed(gap, wide_gap[block])
            counts, count_at = squeezed(count, wide_count[block])
            size = (ends - starts) * (wide_gap + wide_count)
            at = np.cumsum(size) - size
            data = np.zeros(int(size.sum()), np.uint8)
            own = np.arange(len(term)) - starts[block]
            for values, wide, begin in ((gaps, wide_gap, 0), (counts, wide_count, (ends - starts) * wide_gap)):
                to = (at + begin)[block] + own * wide[block]
                source = gap_at if values is gaps else count_at
                for k in range(4):
                    deep = wide[block] > k
                    data[to[deep] + k] = values[source[deep] + k]
            blocks = np.add.reduceat(head.astype(np.int64), first)  # of a term
            block_ends, data_ends = np.cumsum(blocks), np.cumsum(np.add.reduceat(size, np.cumsum(blocks) - blocks))
            place = np.stack([doc[starts], at - np.repeat(data_ends - np.add.reduceat(size, np.cumsum(blocks) - blocks), blocks), wide_gap, wide_count], axis=1).astype("<i4")
            per = {"last": doc[ends - 1], "most": np.maximum.reduceat(count, starts), "least": np.minimum.reduceat(sizes[doc], starts)}
            names = list(self.number)
            more = [pa.array([names[t] for t in term[first].tolist()], pa.binary()), pa.array(df), pa.array(np.add.reduceat(count, first))]
            more += [slices(per[c].astype("<i4").tobytes(), block_ends * 4) for c in ("last", "most", "least")]
            more += [slices(place.tobytes(), block_ends * 16), slices(data.tobytes(), data_ends)]
            arrays = [pa.concat_arrays([a, b.cast(a.type)]) for a, b in zip(arrays, more, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(arrays[0]), shard)), *arrays], schema=INDEX_FIELDS)


def index(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The inverted index of doc_id and text of all rows, written. A null text holds no terms; a row stands for itself, with or without a doc_id of its own."""

    def run(batches):
        part, done, shard = TaskContext.get().partitionId(), 0, Shard()
        for b in batches:
            for first in range(0, b.num_rows, 64):
                own = b.slice(first, 64)
                for doc_id, text in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True):
                    shard.add(doc_id, text)
                    if shard.total >= words or len(shard.ids) >= words:
                        yield shard.rows(part << 24 | done)
                        done, shard = done + 1, Shard()
        if shard.ids:
            yield shard.rows(part << 24 | done)

    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, INDEX), "zstd")


class Postings:
    """A term's list in a shard: what its blocks can give at most is known before they are decompressed."""

    def __init__(self, row: dict, weight: int, norm):
        self.last, self.place = np.frombuffer(row["last"], "<i4"), np.frombuffer(row["place"], "<i4").reshape(-1, 4)
        self.n, self.data, self.weight = row["n_docs"], np.frombuffer(row["data"], np.uint8), weight
        most, least = np.frombuffer(row["most"], "<i4").astype(np.int64), np.frombuffer(row["least"], "<i4")
        self.bounds = given(weight, most, norm(least))
        self.bound = int(self.bounds.max())
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and counts of a block, decompressed."""
        if k not in self.known:
            first, at, wide_gap, wide_count = self.place[k].tolist()
            n = min(BLOCK, self.n - k * BLOCK)
            gaps = self.data[at : at + n * wide_gap].view(f"<u{wide_gap}")
            counts = self.data[at + n * wide_gap : at + n * (wide_gap + wide_count)].view(f"<u{wide_count}")
            self.known[k] = (first + np.cumsum(gaps, dtype=np.int64), counts.astype(np.int64))
        return self.known[k]

    def some(self, blocks) -> tuple[np.ndarray, np.ndarray]:
        both = [self.block(k) for k in blocks]
        return np.concatenate([a for a, _ in both]), np.concatenate([b for _, b in both])


def given(weight: int, count: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term gives a document that holds it `count` times; more of it, or a shorter document, never gives less."""
    return weight * ((1_000_000_000 * count) // (1000 * count + 8 * m))


def search(lists: list[Postings], norms: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (numbers within the shard) and scores above 0: all that may be among the `keep` best, ties included."""
    lists = sorted(lists, key=lambda x: -x.bound)
    rest = np.append(np.cumsum([x.bound for x in lists][::-1])[::-1], 0)  # what list k and all weaker ones can give

    def scored(docs: np.ndarray, scores: np.ndarray, first: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        for k in range(first, len(lists)):
            x = lists[k]
            block = np.searchsorted(x.last, docs)
            inside = block < len(x.last)
            most = np.where(inside, x.bounds[np.minimum(block, len(x.last) - 1)], 0)
            stay = scores + most + rest[k + 1] >= threshold
            docs, scores, block, inside = docs[stay], scores[stay], block[stay], inside[stay]
            if inside.any():
                held, count = x.some(np.unique(block[inside]).tolist())
                at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
                hit = np.flatnonzero(held[at] == docs)
                scores[hit] += given(x.weight, count[at[hit]], norms[docs[hit]])
        return docs, scores

    def gathered(chosen: list[Postings]) -> tuple[np.ndarray, np.ndarray]:
        both = [x.some(range(len(x.last))) for x in chosen]
        docs = np.unique(np.concatenate([d for d, _ in both]))
        scores = np.zeros(len(docs), np.int64)
        for x, (d, c) in zip(chosen, both, strict=True):
            scores[np.searchsorted(docs, d)] += given(x.weight, c, norms[d])
        return docs, scores

    first, have = 0, 0
    while first < len(lists) and have < keep:
        have, first = have + lists[first].n, first + 1
    docs, scores = scored(*gathered(lists[:first]), first, 0)
    threshold = int(np.partition(scores, len(scores) - keep)[-keep]) if len(scores) >= keep else 0
    essential = max(1, int(np.searchsorted(-rest, -threshold, side="right")))  # lists from there on can't reach the threshold together
    if essential > first or threshold == 0:
        essential = essential if threshold else len(lists)
        docs, scores = scored(*gathered(lists[:essential]), essential, threshold)
    good = (scores >= max(threshold, 1))
    return docs[good], scores[good]


def best(docs: DataFrame, items: DataFrame, keep: int = 10, words: int = WORDS, group: int = ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `keep` best documents of each item.

    docs: doc_id, text; items: item_id, text; other columns are ignored, whatever their names. Of equal scores the
    smaller doc_id comes first, one that is null last; documents with a score of 0 are left out. Every row of `items` is
    a query and has its ranks, with a null or repeated item_id too; every row of `docs` is a document. A text that is null,
    empty or without terms counts nowhere. No documents or no items, no rows.

    Weights, lengths and counts are those of all documents. Terms of the queries are broadcast up to `SMALL` of them,
    beyond it joined by a shuffle; a shard's lists meet `group` queries in a task.
    """
    asked = written(items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").cast("string").alias("text")))

    def split(batches):
        for b in batches:
            pairs = [(i, t) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t in dict.fromkeys(terms(text))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int64()), pa.array([t for _, t in pairs], pa.binary())], names=["item", "term"])

    groups = max(1, -(-asked.count() // group))
    pairs = asked.select("item", "text").mapInArrow(split, "item long, term binary")
    wanted = written(pairs.withColumn("group", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int")))
    few = F.broadcast if wanted.count() <= SMALL else lambda d: d
    built = index(docs, words)
    of_docs, of_terms = built.filter("term IS NULL"), built.filter("term IS NOT NULL")
    n, length = of_docs.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    df = of_terms.join(few(wanted.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("n_docs").alias("df"))
    weights = df.select("term", F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1))).cast("long").alias("weight"))
    needs = written(wanted.join(weights, "term").groupBy("group", "term", "weight").agg(F.collect_list("item").alias("items")))
    shown = ["n_docs", "last", "most", "least", "place", "data"]
    lists = of_terms.join(few(needs), "term").select("shard", "group", "weight", "items", *shown)
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    documents = of_docs.select("shard", every.alias("group"), F.lit(None).cast("long").alias("weight"), F.lit(None).cast("array<long>").alias("items"), *shown)

    def answer(rows: pa.Table) -> pa.Table:
        every = rows.to_pylist()
        own = next(r for r in every if r["weight"] is None)
        ids, empty = np.frombuffer(own["data"], "<i8"), np.frombuffer(own["place"], "u1")
        norm = lambda size: 10 + (90 * size.astype(np.int64) * n) // max(1, length)
        norms = norm(np.frombuffer(own["least"], "<i4"))
        queries: dict[int, list[Postings]] = defaultdict(list)
        for r in every:
            if r["weight"]:
                x = Postings(r, r["weight"], norm)
                for i in r["items"]:
                    queries[i].append(x)
        out: list[tuple] = []
        for i, found in queries.items():
            docs_, scores = search(found, norms, keep)
            top = np.lexsort((ids[docs_], empty[docs_], -scores))[:keep]
            out += [(i, None if empty[d] else int(ids[d]), int(s)) for d, s in zip(docs_[top].tolist(), scores[top].tolist(), strict=True)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else ([], [], []), BEST, strict=True)], schema=BEST)

    heaps = lists.unionByName(documents).groupBy("shard", "group").applyInArrow(answer, "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    merged = heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)
    return merged.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""WITH d AS (SELECT doc_id, {TERMS} AS ts FROM documents), s AS (SELECT count(*) AS big_n, sum(len(ts))::BIGINT AS big_l FROM d WHERE len(ts) > 0),
p AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d), q AS (SELECT DISTINCT item_id, unnest({TERMS}) AS t FROM benchmark),
f AS (SELECT doc_id, n, t, count(*) AS tf FROM p WHERE t IN (SELECT t FROM q) GROUP BY doc_id, n, t),
w AS (SELECT t, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY t),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score FROM q JOIN f USING (t) JOIN w USING (t), s GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10"""
