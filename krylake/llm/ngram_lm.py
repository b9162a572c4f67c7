"""LM scoring with a log-frequency Bloom filter.

Counts of words are exact; counts of n-grams are quantised to powers of two, and a Bloom filter holds
an entry for each level up to that of the n-gram's count, so a count is read by probing level after
level until one is missing. A chunk of documents sends each bucket its different words and n-grams once, with
their counts in its training texts: the bucket adds up the counts, builds its part of the filter and answers all
chunks. So every hash is shuffled once, both to be counted and to be asked about, and no filter leaves its bucket. Chunks are
made where their rows are read, twice, and only their compressed texts are shuffled, once; hashes travel as compressed gaps between sorted numbers.
"""

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from krylake.llm.common import batch, lowered, mixed, table, written
from krylake.llm.pieces import chunks_of, opened, packed

BITS, PROBES = 14, 6  # bits of the filter for an entry, hash functions
PROBED = 1 << 19  # n-grams that a bucket answers at once
CHUNK_ROWS, CHUNK_BYTES = 2048, 6 << 20
BROADCAST_BYTES = 64 << 20
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
ASKED = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
ASKED_DDL = "chunk long, kind int, bucket int, keys binary, counts binary"
TOLD = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("got", pa.binary()), ("kinds", pa.int64()), ("total", pa.int64())])
TOLD_DDL = "chunk long, kind int, bucket int, got binary, kinds long, total long"
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def token_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a whole text's words, then that of the end."""
    words = lowered(text).split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def grams(tokens: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends in each token of texts that follow one another, as a hash; before a text stand start signs."""
    first = np.append(True, tokens[:-1] == END)[: len(tokens)]
    h = before = tokens
    with np.errstate(over="ignore"):
        for i in range(1, order):
            before = np.append(START, before[:-1])
            before[first] = START
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i)) + before
    return mixed(h)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their counts added up."""
    order = np.argsort(keys, kind="stable") if counts is not None else None
    keys = np.sort(keys) if counts is None else keys[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    sums = np.diff(np.append(heads, len(keys))) if counts is None else np.add.reduceat(counts[order], heads) if len(keys) else counts
    return keys[heads], sums.astype(np.int64)


def blocks(keys: np.ndarray, bits: int):
    """(bucket, slice) for sorted keys: the bucket is the key's leading bits."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(keys)])
    for lo, hi in zip(heads.tolist(), np.append(heads[1:], len(keys)).tolist(), strict=False):
        yield int(bucket[lo]), slice(lo, hi)


@functools.cache
def codec() -> tuple:
    """One compressor and one decompressor a process: each takes longer to make than a block to squeeze."""
    import zstandard

    return zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


def narrow(values: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes, compressed."""
    return codec()[0].compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def wide(blob: bytes, form: str) -> np.ndarray:
    """What narrow() was given."""
    planes = np.frombuffer(codec()[1].decompress(blob), np.uint8).reshape(np.dtype(form).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(form).ravel()


def gaps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as their differences, which np.cumsum undoes."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def below(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits of n-grams below those of the bucket."""
    return ((keys << np.uint64(bits)) >> np.uint64(32)).astype("<u4")


def counts_out(counts: np.ndarray) -> bytes:
    """Counts in 1, 4 or 8 bytes each, the width in front."""
    most = int(counts.max(initial=0))
    form = "<u1" if most < 1 << 8 else "<u4" if most < 1 << 32 else "<u8"
    return form[2].encode() + narrow(counts.astype(form))


def counts_in(blob: bytes) -> np.ndarray:
    return wide(blob[1:], f"<u{blob[:1].decode()}").astype(np.int64)


def squeezed(keys: np.ndarray, counts: np.ndarray, kind: int, bits: int) -> tuple[bytes, bytes]:
    """Bytes of a block: n-grams keep 32 bits below those of the bucket; of their counts only those other than one are kept."""
    if kind == 1:
        return narrow(gaps(keys)), counts_out(counts)
    other = np.flatnonzero(counts != 1)
    return narrow(gaps(below(keys, bits))), narrow(np.stack([gaps(other), np.minimum(counts[other], (1 << 32) - 1)]).astype("<u4").ravel())


def loosed(kind: int, keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys (of n-grams the bits below those of the bucket) and counts of a block."""
    if kind == 1:
        return np.cumsum(wide(keys, "<u8"), dtype=np.uint64), counts_in(counts)
    own = np.cumsum(wide(keys, "<u4"), dtype=np.uint64)
    n = np.ones(len(own), np.int64)
    at, other = wide(counts, "<u4").reshape(2, -1)
    n[np.cumsum(at, dtype=np.int64)] = other
    return own, n


def different(tokens: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """What a chunk's tokens are told apart by: words, or bigrams by the bits of the bucket and the 32 below them, others zero."""
    if kind == 1:
        return tokens
    rest = np.uint64(32 - bits)
    return grams(tokens, 2) >> rest << rest


def probes(keys: np.ndarray, level: int, size: np.ndarray | int):
    """PROBES times the positions in filters of `size` bits (under 2^32) for the entries (key, level): call with the entries still of interest."""
    with np.errstate(over="ignore"):
        a = mixed(keys + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
        b = mixed(a) | np.uint64(1)
        size = np.asarray(size).astype(np.uint64)
        left = np.arange(len(keys))
        for i in range(PROBES):
            own = size if size.ndim == 0 else size[left]
            left = yield (((a[left] + np.uint64(i) * b[left]) >> np.uint64(32)) * own >> np.uint64(32)).astype(np.int64), left


def bloom(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Filter over (key, 0..level) with level = floor(log2 count): counts of one have level 0."""
    levels = np.floor(np.log2(counts)).astype(int)
    size = max(64, -(-int((levels + 1).sum()) * BITS // 64) * 64)
    bits = np.zeros(size, np.uint8)
    for level in range(int(levels.max(initial=-1)) + 1):
        found = probes(keys[levels >= level], level, size)
        at, left = next(found)
        try:
            while True:
                bits[at] = 1
                at, left = found.send(left)
        except StopIteration:
            pass
    return np.packbits(bits, bitorder="little").tobytes()


class Filters:
    """The buckets' filters side by side; answers by probing level after level."""

    def __init__(self, parts: dict[int, bytes], bits: int):
        self.bits, n = bits, 1 << bits
        sizes = np.array([len(parts.get(i, b"\0" * 8)) for i in range(n)], np.int64)
        self.start, self.size = np.cumsum(sizes) - sizes, sizes * 8
        self.bytes = np.frombuffer(b"".join(parts.get(i, b"\0" * 8) for i in range(n)), np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        bucket = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        return self.levels_at(bucket, below(keys, self.bits).astype(np.uint64))

    def levels_at(self, bucket: np.ndarray, short: np.ndarray) -> np.ndarray:
        """The levels of n-grams by bucket and the bits below."""
        keys = short
        out, left, level = np.full(len(keys), -1, np.int8), np.arange(len(keys)), 0  # -1: not in the filter
        while len(left) and level < 64:
            found = probes(short[left], level, self.size[bucket[left]])
            at, own = next(found)
            try:
                while True:  # those that a probe misses aren't probed again
                    own = own[(self.bytes[self.start[bucket[left[own]]] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 > 0]
                    at, own = found.send(own)
            except StopIteration:
                pass
            left = left[own]
            out[left] = level
            level += 1
        return out


def answered(asked: pa.Table) -> pa.Table:
    """For each block of a bucket (kind, bucket) its answers: training counts of words, levels of n-grams + 1. A row without chunk has the distinct and total numbers."""
    kind, bucket = asked.column("kind")[0].as_py(), asked.column("bucket")[0].as_py()
    own = [loosed(kind, k, c) for k, c in zip(asked.column("keys").to_pylist(), asked.column("counts").to_pylist(), strict=True)]
    keys, counts = summed(np.concatenate([k for k, _ in own]), np.concatenate([n for _, n in own]))
    keys, counts = keys[counts > 0], counts[counts > 0]
    got: list[bytes] = []
    if kind == 1:
        for k, _ in own:
            at = np.minimum(np.searchsorted(keys, k), max(0, len(keys) - 1))
            got.append(counts_out(np.where(keys[at] == k, counts[at], 0) if len(keys) else np.zeros(len(k), np.int64)))
    else:
        filters, sizes = Filters({0: bloom(keys, counts)}, 0), np.array([len(k) for k, _ in own])
        part = np.cumsum(sizes) // PROBED
        for p in range(int(part[-1]) + 1):  # blocks are short: several are probed together
            some = np.flatnonzero(part == p)
            if len(some):
                short = np.concatenate([own[i][0] for i in some])
                levels = filters.levels_at(np.zeros(len(short), np.int64), short).astype(np.int64) + 1
                got += map(counts_out, np.split(levels, np.cumsum(sizes[some])[:-1]))
    n = len(got)
    return pa.Table.from_batches([batch(TOLD, [*asked.column("chunk").to_pylist(), None], [kind] * (n + 1), [bucket] * (n + 1), [*got, None], [None] * n + [len(keys)], [None] * n + [int(counts.sum())])])


def scored(c: np.ndarray, before: np.ndarray, levels: np.ndarray, total: int, kinds: int, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the base and the model's probability of tokens; c, before: exact counts of each and of its context; levels of its n-gram."""
    base = (c + 1) / (total + kinds + 1)
    seen = np.where((levels >= 0) & (before > 0), np.minimum(1.0, np.exp2(levels.astype(float)) / np.maximum(before, 1)), 0.0)
    return np.log10(base), np.log10((1 - weight) * base + weight * seen)


def held_out(doc_id, mod: int = 7):
    """Boolean Column: documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % mod == 2, F.lit(False))


def score_texts(docs: DataFrame, weight: float = 0.2, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of `docs` (doc_id, text; others are ignored).

    Bigrams: log10 of (1 - weight) * (c(w) + 1) / (N + V + 1) + weight * count(v w) / c(v), where the
    filter's count is the power of two at or below the true one (1 for counts of one), so that the
    probabilities of a context sum to at most one. Null and empty texts consist of the end alone.
    Rows without doc_id are learned from. With nothing to learn from, N = V = 0 and all scores are 0
    or the weight's share of it. Rows that repeat count each time. docs is read several times and has to give its rows
    in the same order: a scan or a written table. `broadcast_bytes` has no effect: hashes go to their buckets to be counted, and are
    answered there, so a filter of any size stays where it is.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learns = ~held_out("doc_id")
    rows, size, trained = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)), F.count(F.when(learns, 1))).first()
    chunks = max(1, -(-rows // CHUNK_ROWS), -(-size // CHUNK_BYTES))
    bits = max(4, min(14, int(chunks).bit_length()))
    own = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))

    def ask(batches):
        for chunk, part in chunks_of(batches, CHUNK_ROWS, CHUNK_BYTES):
            texts = [token_hashes(t) for t in part.column("text").to_pylist()]
            tokens, train = np.concatenate(texts), np.repeat(~np.array(part.column("held_out").to_pylist(), bool), [len(t) for t in texts])
            del texts
            for kind in (1, 2):
                every = different(tokens, kind, bits)
                keys, (seen, n) = np.unique(every), summed(every[train])
                counts = np.zeros(len(keys), np.int64)
                counts[np.searchsorted(keys, seen)] = n
                out = [(chunk, kind, bucket, *squeezed(keys[s], counts[s], kind, bits)) for bucket, s in blocks(keys, bits)]
                yield batch(ASKED, *zip(*out, strict=True))

    told = written(own.mapInArrow(ask, ASKED_DDL).groupBy("kind", "bucket").applyInArrow(answered, TOLD_DDL))
    sums = {r["kind"]: r for r in told.filter("chunk IS NULL").groupBy("kind").agg(F.sum("kinds").alias("kinds"), F.sum("total").alias("total")).collect()}
    total, kinds = (int(sums[1][k]) if 1 in sums else 0 for k in ("total", "kinds"))

    def score(group: pa.Table, told: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.Table.from_batches([], schema=SCORES)
        part = opened(group.column("blob")[0].as_buffer())
        texts = [token_hashes(t) for t in part.column("text").to_pylist()]
        lengths, tokens = np.array([len(t) for t in texts]), np.concatenate(texts)
        answers = sorted(zip(told.column("kind").to_pylist(), told.column("bucket").to_pylist(), told.column("got").to_pylist(), strict=True))
        counts, levels = (np.concatenate([np.zeros(0, np.int64), *[counts_in(g) for k, _, g in answers if k == kind]]) for kind in (1, 2))
        words, place = np.unique(tokens, return_inverse=True)
        if len(words) != len(counts):
            raise RuntimeError("the rows of docs came in another order than before: score a written table")
        c = counts[place]
        level = levels[np.unique(different(tokens, 2, bits), return_inverse=True)[1]] - 1
        starts = np.cumsum(lengths) - lengths
        before = np.append(0, c[:-1])
        before[starts] = trained
        base, model = (np.add.reduceat(x, starts) for x in scored(c, before, level, total, kinds, weight))
        known = np.add.reduceat((c > 0).astype(np.int64), starts)
        return pa.Table.from_batches([batch(SCORES, part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), lengths, known, np.full(len(lengths), total), base, model)])

    answers = told.filter("chunk IS NOT NULL").select("chunk", "kind", "bucket", "got")
    return packed(own, CHUNK_ROWS, CHUNK_BYTES).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, SCORES_DDL)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
