"""Runs of words that repeat with a short period, found over a harmonic grid with constant-time common extensions.

The words of many texts form one sequence of numbers, texts parted by numbers of their own. How far two
places agree (their LCE) is answered by a sample of the suffixes: those that begin at places of a difference
cover modulo V, so that for any two places some shift below V takes both onto the sample. Only these suffixes
are sorted: blocks of V words first, then pairs of blocks that follow each other, twice as long in each turn,
until all differ. Their common prefixes lie in a sparse table of minima. A query compares words one by one
until it finds a difference or both places are on the sample, and then takes one minimum of two overlapping ranges.

A run of period q and length 4q or more holds 3q places that agree with the place q further on, so one of
them is a multiple of 3q: for each q only these places are asked, n / 3q of them, n log n in all. Where a
place agrees, the sequence and its reverse tell how far, forwards and backwards. The smallest period of a
stretch is the least that found it.
"""

import functools
import itertools
import zlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from krylake.llm.common import table

V, COVER = 31, np.array([1, 5, 11, 24, 25, 27])  # every difference modulo 31 is one of two of these
POWER, SHORTEST = 4, 6  # a run is at least four periods and six words long
WORDS = 100_000  # of texts that share a sequence; a longer text has its own
QUERIES = 1 << 20  # places of the grid that are asked at a time
FOUND = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


@functools.cache
def shifts() -> np.ndarray:
    """[a, b]: the least shift that takes places of residues a and b both onto the cover."""
    on = np.isin(np.arange(V), COVER)
    places = (np.arange(V)[:, None] + np.arange(V)[None, :]) % V  # [residue, shift]
    return np.argmax(on[places][:, None, :] & on[places][None, :, :], axis=2).astype(np.int64)


class Extensions:
    """How far two places of a sequence of numbers agree; the sequence ends in numbers that occur once."""

    def __init__(self, words: np.ndarray):
        self.words = np.concatenate([words, -1 - np.arange(V + 1)]).astype(np.int64)  # past the end nothing agrees
        n = len(words)
        self.at = np.flatnonzero(np.isin(np.arange(n + V) % V, COVER))
        self.at = self.at[self.at < n]
        self.number = np.full(n + 2 * V, -1, np.int64)  # a sampled place's number
        self.number[self.at] = np.arange(len(self.at))
        blocks = np.minimum(self.at[:, None] + np.arange(V)[None, :], len(self.words) - 1)
        text = np.ascontiguousarray((self.words[blocks] + (V + 2)).astype(">i4")).view(f"S{4 * V}").ravel()  # big-endian and positive: bytes sort as the numbers do
        names = [np.unique(text, return_inverse=True)[1].ravel()]
        step = V
        while len(names[-1]) and names[-1].max() + 1 < len(names[-1]):
            later = np.minimum(self.at + step, n + V)
            follow = np.where(self.number[later] >= 0, names[-1][self.number[later]] + 1, 0)
            names.append(np.unique(names[-1] * (len(self.at) + 2) + follow, return_inverse=True)[1].ravel())
            step *= 2
        self.rank = names[-1]
        order = np.empty(len(self.at), np.int64)
        order[self.rank] = np.arange(len(self.at))
        self.minima = [self._shared(order[:-1], order[1:], names)]
        while 1 << len(self.minima) <= len(self.minima[0]):
            half, last = 1 << (len(self.minima) - 1), self.minima[-1]
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def _shared(self, a: np.ndarray, b: np.ndarray, names: list[np.ndarray]) -> np.ndarray:
        """The common prefixes of neighbours in the order: the longest named blocks that are equal first, single words last."""
        x, y, out = self.at[a], self.at[b], np.zeros(len(a), np.int64)
        for k in range(len(names) - 2, -1, -1):
            i, j = self.number[x + out], self.number[y + out]
            same = (i >= 0) & (j >= 0) & (names[k][np.maximum(i, 0)] == names[k][np.maximum(j, 0)])
            out[same] += V << k
        return out + self._compared(x + out, y + out, np.full(len(x), V))[0]

    def _compared(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that agree one by one, up to `most`, and which pairs agree as far as that."""
        out, left = np.zeros(len(x), np.int64), np.flatnonzero(most > 0)
        full = most <= 0
        while len(left):
            left = left[self.words[x[left] + out[left]] == self.words[y[left] + out[left]]]
            out[left] += 1
            done = out[left] == most[left]
            full[left[done]] = True
            left = left[~done]
        return out, full

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The number of words from x on that agree with those from y on, for places x < y of the sequence (or its end)."""
        out, on = self._compared(x, y, shifts()[x % V, y % V])
        i, j = self.number[x[on] + out[on]], self.number[y[on] + out[on]]
        inside = (i >= 0) & (j >= 0)
        on = np.flatnonzero(on)[inside]
        a, b = np.sort([self.rank[i[inside]], self.rank[j[inside]]], axis=0)
        level = np.frexp((b - a).astype(float))[1] - 1  # of the two ranges of 2 ** level that cover [a, b)
        for k in np.unique(level):
            own = level == k
            row = self.minima[k]
            out[on[own]] += np.minimum(row[a[own]], row[b[own] - (1 << k)])
        return out


def runs(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period; text k is words[starts[k]:ends[k]], places count from its start.

    Between two texts stands at least one number that occurs once."""
    n, forward, backward, found = len(words), None, None, []
    sizes = ends - starts
    longest = int(sizes.max(initial=0)) // POWER
    by_size = np.argsort(-sizes, kind="stable")
    q, step = 1, max(1, POWER - 1)
    while q <= longest:
        pairs, asked = [], 0
        while q <= longest and asked < QUERIES:
            own = by_size[: np.searchsorted(-sizes[by_size], -POWER * q, side="right")]  # the texts that may hold such a run
            many = (sizes[own] - 1 - q) // (step * q) + 1
            text = np.repeat(own, many)
            k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
            at = starts[text] + k * (step * q)
            same = words[at] == words[at + q]
            pairs.append((text[same], at[same], np.full(int(same.sum()), q)))
            asked += len(text)
            q += 1
        text, at, period = (np.concatenate(c) for c in zip(*pairs, strict=True))
        if not len(text):
            continue
        if forward is None:
            forward, backward = Extensions(words), Extensions(words[::-1])
        ahead = forward(at, at + period)
        behind = backward(n - at - period, n - at)
        length = period + ahead + behind
        good = length >= np.maximum(SHORTEST, POWER * period)
        found.append((text[good], (at - behind - starts[text])[good], length[good], period[good]))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    text, start, length, period = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((period, length, start, text))
    text, start, length, period = text[order], start[order], length[order], period[order]
    first = np.ones(len(text), bool)  # of equal stretches the least period is the smallest
    first[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, period = text[first], start[first], length[first], period[first]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, told by their id, get a tail that repeats itself."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + list(itertools.islice(itertools.cycle(words[a : a + p]), n - a))


def answers(ids: list, texts: list, rewrite: Callable | None) -> tuple[list, list, list]:
    """n_words, runs and the text without repeats, for some texts together."""
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    if rewrite:
        split = [rewrite(i, w) for i, w in zip(ids, split, strict=True)]
    sizes = np.array([len(w) for w in split], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    number: dict[bytes, int] = defaultdict(itertools.count().__next__)
    words = np.empty(int((sizes + 1).sum()), np.int64)
    for s, own in zip(starts.tolist(), split, strict=True):
        words[s : s + len(own)] = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
    words[starts + sizes] = len(number) + np.arange(len(sizes))
    text, start, length, period = runs(words, starts, starts + sizes)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts[text] + start + period, 1)
    np.add.at(change, starts[text] + start + length, -1)
    kept = np.cumsum(change)[:-1] == 0
    found: list[list[dict]] = [[] for _ in split]
    for k, s, m, q in zip(text.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        found[k].append({"start": s, "length": m, "period": q})
    left = [b" ".join(itertools.compress(w, kept[s : s + len(w)].tolist()) if f else w).decode("utf-8", "surrogatepass") for w, s, f in zip(split, starts.tolist(), found, strict=True)]
    return sizes.tolist(), found, left


def find(docs: DataFrame, rewrite: Callable | None = None) -> DataFrame:
    """docs: doc_id and text, other columns are ignored. Gives doc_id, n_words, runs (start, length, period; by start, then period) and collapsed.

    A run is a stretch of words with the smallest period q, at least max(6, 4 q) long, that no neighbour extends. In
    `collapsed`, the kept words joined by one space, each run's words after its first q are dropped. Words are whatever stands
    between the white space of ASCII. A null or empty text has no words, no runs and an empty text. Rows stand for themselves:
    repeated and null doc_ids are answered a row each. No rows, no answer. `rewrite` (doc_id, words) may change the words first.
    A text is held by one task: some 400 bytes a word while it is searched.
    """
    fields = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])

    def run(batches):
        for b in batches:
            ids, texts, first = b.column(0).to_pylist(), b.column(1), 0
            weights = np.cumsum([len(x) // 5 + 8 if x else 8 for x in texts.to_pylist()])
            while first < len(ids):
                last = max(first + 1, int(np.searchsorted(weights, (weights[first - 1] if first else 0) + WORDS)))
                own = ids[first:last]
                columns = (own, *answers(own, texts.slice(first, last - first).to_pylist(), rewrite))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)
                first = last

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, {FOUND}")


def strongest(found: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equals the one that starts first, then of the least period."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(found, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = find(table(spark, sf_dir, "documents"), repeated).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
