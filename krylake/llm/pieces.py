"""SentencePiece encoding and decoding over a relational lattice.

A piece vocabulary with merge ranks encodes by merging the best-ranked neighbours again and again. The
result is also the one path of the lattice of pieces on which no two neighbours would have merged across
their border: so Viterbi finds it, with costs of nothing or infinity between neighbours, in one pass over
the ends of edges. Two neighbours would have merged across their border if, while both still are a part of
each (on the right spine of the left one's merges, on the left spine of the right one's), the two parts
together are a piece of a better rank than what either part merges into within its own. Ties go to the left.

Texts are cut into runs, between signs that no piece has side by side. Every distinct run of the corpus is
exploded into its substrings up to the longest piece's length; an equi-join with the piece table leaves the
edges; they are grouped by run, and a higher-order aggregate folds the path. Signs that no piece covers
become byte pieces. Texts stay in packed chunks, which ask buckets of runs once for all their runs.
"""

import functools
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from krylake.llm.common import table, written

SPACE = "▁"
CHUNK_ROWS, CHUNK_BYTES = 16384, 8 << 20
SLICE = 1 << 20  # signs of texts that are cut into runs at once
PAIRS = 200_000  # pairs of pieces whose answer a task remembers
BLOCK = 256  # signs that the inner fold takes at once: arrays are copied when they grow
NEVER = (1 << 20) - 1  # later than any rank
PACKED, PACKED_DDL = pa.schema([("chunk", pa.int64()), ("blob", pa.binary())]), "chunk long, blob binary"
ASKED, ASKED_DDL = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("runs", pa.binary())]), "chunk long, bucket int, runs binary"
TOLD, TOLD_DDL = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("ids", pa.binary())]), "chunk long, bucket int, ids binary"
ENCODED = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids", pa.list_(pa.int32()))])


@functools.cache
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.cache
def piece_rows(path: str) -> list[tuple[str, int, int]]:
    """(piece, id, rank) of the pieces that match text: 0 for single signs, the best score of the others 1."""
    sp = processor(path)
    own = [(sp.id_to_piece(i), i, sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    rank = {s: k + 1 for k, s in enumerate(sorted({s for p, _, s in own if len(p) > 1}, reverse=True))}
    return [(p, i, rank[s] if len(p) > 1 else 0) for p, i, s in own]


def tree(piece: str, ranks: dict[str, int]) -> tuple | None:
    """(text, time it is formed, parts) by the merges of a piece's own signs; None if they don't end in the piece. A time is the worst rank so far."""
    parts: list[tuple] = [(c, 0, None) for c in piece]
    while len(parts) > 1:
        best = min(((ranks[a[0] + b[0]], k) for k, (a, b) in enumerate(pairwise(parts)) if a[0] + b[0] in ranks), default=None)
        if best is None:
            return None
        a, b = parts[best[1] : best[1] + 2]
        parts[best[1] : best[1] + 2] = [(a[0] + b[0], max(best[0], a[1], b[1]), (a, b))]
    return parts[0]


def piece_table(path: str) -> list[tuple]:
    """(piece, id, rank, left, right). left: parts at the piece's start, their signs, when formed and until when they last;
    right: parts at its end by their signs, formed << 20 | until, 0 for none."""
    rows = piece_rows(path)
    ranks, out = {p: r for p, _, r in rows if r}, []
    for p, i, r in rows:
        left, right = [], [0] * len(p)
        whole = tree(p, ranks)
        for side in (0, 1):
            node, until = whole, NEVER
            while node:
                if side:
                    right[len(node[0]) - 1] = node[1] << 20 | until
                else:
                    left.append((len(node[0]), node[1], until))
                until, node = node[1], node[2] and node[2][side]
        out.append((p, i, r, left, right))
    return out


@functools.cache
def neighbours(path: str) -> tuple[np.ndarray, np.ndarray]:
    """A class for each sign, 0 for those in no piece, and whether some piece has two classes side by side."""
    signs = {c: i for i, c in enumerate(sorted({c for p, _, _ in piece_rows(path) for c in p}), 1)}
    classes, beside = np.zeros(0x110000, np.int16), np.zeros((len(signs) + 1, len(signs) + 1), bool)
    for c, i in signs.items():
        classes[ord(c)] = i
    for a, b in {x for p, _, _ in piece_rows(path) for x in pairwise(p)}:
        beside[signs[a], signs[b]] = True
    return classes, beside


def runs(texts: list[str | None], path: str) -> tuple[list[str], np.ndarray]:
    """The parts of texts between signs that no piece has side by side, spaces as their sign and one in front of each text, and how many each text has."""
    classes, beside = neighbours(path)
    marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
    joined, first = "".join(marked), np.cumsum([0, *map(len, marked)])
    if not joined:
        return [], np.zeros(len(texts), np.int64)
    own = classes[np.frombuffer(joined.encode("utf-32-le"), "<u4")]
    head = np.append(True, ~beside[own[:-1], own[1:]])
    head[first[:-1][first[:-1] < len(head)]] = True
    at = np.flatnonzero(head)
    return [joined[x:y] for x, y in pairwise([*at.tolist(), len(joined)])], np.diff(np.searchsorted(at, first))


def let(value: Column, use) -> Column:
    """use(value), the value evaluated once."""
    return F.transform(F.array(value), use)[0]


class Crossings:
    """Whether two pieces side by side would have merged across their border: asked of pairs of ids (+ 1; 0 is a sign without a piece), a pair's answer remembered."""

    def __init__(self, path: str):
        self.ranks, self.left, self.right, self.known = {}, {0: []}, {0: []}, {}
        for text, i, rank, left, right in piece_table(path):
            if rank:
                self.ranks[text] = rank
            self.left[i + 1] = [(text[:n], formed, until) for n, formed, until in left]
            self.right[i + 1] = [(text[len(text) - k - 1 :], r >> 20, r & NEVER) for k, r in enumerate(right) if r]

    def crossed(self, a: int, b: int) -> bool:
        for mine, formed, until in self.right[a]:
            for other, begun, ended in self.left[b]:
                rank = self.ranks.get(mine + other)
                if rank is not None:
                    when = max(rank, formed, begun)
                    if when <= ended and when < until:
                        return True
        return False

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        codes, of = np.unique(a << 20 | b, return_inverse=True)
        if len(self.known) > PAIRS:
            self.known.clear()
        out = np.empty(len(codes), bool)
        for k, code in enumerate(codes.tolist()):
            told = self.known.get(code)
            if told is None:
                told = self.known[code] = self.crossed(code >> 20, code & NEVER)
            out[k] = told
        return out[of.ravel()]


@functools.cache
def crossings(path: str) -> Crossings:
    return Crossings(path)


def judged(grouped: DataFrame, path: str) -> DataFrame:
    """Adds `prev` to (bucket, run, edges): for each edge the places, among its run's, of those that end where it begins and that it may follow."""

    def run(batches):
        crosses = crossings(path)
        for b in batches:
            edges = b.column(2)
            at, e = edges.offsets.to_numpy(), edges.values.to_numpy(zero_copy_only=False)
            at, e = at - at[0], e[at[0] : at[-1]]
            of = np.repeat(np.arange(b.num_rows), np.diff(at))
            end = of << 40 | e >> 26  # sorted: edges are, by their ends first
            begin = end - (e >> 20 & 63)
            low, high = np.searchsorted(end, begin, "left"), np.searchsorted(end, begin, "right")
            right = np.repeat(np.arange(len(e)), high - low)
            left = np.arange(len(right)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[right]
            ok = ~crosses(e[left] & NEVER, e[right] & NEVER)
            left, right = left[ok], right[ok]
            ends = np.append(0, np.cumsum(np.bincount(right, minlength=len(e)))).astype(np.int32)
            inner = pa.ListArray.from_arrays(pa.array(ends), pa.array((left - at[of[left]]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(e)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), inner)], names=["bucket", "run", "edges", "prev"])

    return grouped.select("bucket", "run", "edges").mapInArrow(run, "bucket int, run string, edges array<long>, prev array<array<int>>")


def lattice(rows: DataFrame, path: str) -> DataFrame:
    """rows (bucket, run: each once, not empty): adds the ids of its path. The piece table is a fixed vocabulary and broadcast; rows that lie by bucket aren't shuffled.

    An edge is one long: its end, its length (6 bits), its piece's id + 1 (20 bits; 0: a sign without a piece, never merged).
    Which edges may follow each other is a matter of their two pieces alone, and is judged before the fold, once a pair of pieces in a task.
    """
    known = piece_table(path)
    longest, first_byte = max(len(r[0]) for r in known), processor(path).piece_to_id("<0x00>")
    if longest > 63 or max(r[1] for r in known) >= NEVER - 1 or max(r[2] for r in known) >= NEVER:
        raise ValueError("pieces of over 63 signs, or too many")

    pieces = F.broadcast(rows.sparkSession.createDataFrame([(r[0], r[1]) for r in known], "piece string, id int"))
    # a number for each run: rows of edges are grouped by it, in the task that numbered them
    starts = rows.withColumn("no", F.monotonically_increasing_id()).withColumn("end", F.explode(F.sequence(F.lit(1), F.length("run"))))
    spans = starts.withColumn("len", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("end")))))
    found = spans.withColumn("piece", F.col("run").substr(F.col("end") - F.col("len") + 1, F.col("len"))).join(pieces, "piece", "left").filter("id IS NOT NULL OR len = 1")
    edge = F.shiftleft(F.col("end").cast("long"), 26).bitwiseOR(F.shiftleft(F.col("len").cast("long"), 20)).bitwiseOR(F.coalesce(F.col("id") + 1, F.lit(0)).cast("long"))
    grouped = found.groupBy("bucket", "no").agg(F.first("run").alias("run"), F.sort_array(F.collect_list(edge)).alias("edges"))

    edge_at = lambda i: F.get("edges", i)
    end_of = lambda e: F.shiftright(e, 26).cast("int")
    start_of = lambda e: (F.shiftright(e, 26) - F.shiftright(e, 20).bitwiseAND(F.lit(63))).cast("int")
    piece_of = lambda e: e.bitwiseAND(F.lit(NEVER)).cast("int")
    # where the edges of each end begin among the sorted ones, and where the last end's stop
    heads = F.filter(F.sequence(F.lit(0), F.size("edges") - 1), lambda i: (i == 0) | (end_of(edge_at(i)) != end_of(edge_at(i - 1))))
    grouped = judged(grouped, path).select("bucket", "run", "edges", "prev", F.concat(heads, F.array(F.size("edges"))).alias("heads"))
    edges_of = lambda end: F.sequence(F.get("heads", end - 1), F.get("heads", end) - 1)

    def step(s, end):
        """One end: which of its edges may follow the best edge at its start; there is only one. `own` are the best edges so far, by their places."""
        size = lambda i: F.shiftright(edge_at(i), 20).bitwiseAND(F.lit(63)).cast("int")
        fits = lambda i: F.when(size(i) == end, True).otherwise(F.array_contains(F.get("prev", i), F.element_at(s["own"], -size(i))))
        return F.struct((s["at"] + 1).alias("at"), F.concat(s["own"], F.array(F.array_max(F.filter(edges_of(end), fits)))).alias("own"))

    n = F.length("run")

    def block(s, k):
        inner = F.aggregate(F.sequence(k * BLOCK + 1, F.least(n, (k + 1) * BLOCK)), F.struct(s["at"].alias("at"), s["tail"].alias("own")), step)

        def kept(r):  # what a piece may reach back to goes along
            size = F.size(r["own"])
            return F.struct(r["at"].alias("at"), F.slice(r["own"], F.greatest(F.lit(1), size - longest + 1), F.lit(longest)).alias("tail"), F.concat(s["out"], F.array(F.slice(r["own"], F.size(s["tail"]) + 1, size))).alias("out"))

        return let(inner, kept)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("tail"), F.array().cast("array<array<int>>").alias("out"))
    folded = grouped.withColumn("out", F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), start, block)["out"])

    def back(s, k):  # from the last end to the first; `end` is where the next edge of the path ends
        def edge_of(e):
            return F.struct((s["at"] - 1).alias("at"), start_of(e).alias("end"), F.concat(F.array(F.shiftleft(start_of(e).cast("long"), 20).bitwiseOR(piece_of(e).cast("long"))), s["own"]).alias("own"))

        return F.when(s["at"] == s["end"], let(edge_at(k), edge_of)).otherwise(F.struct((s["at"] - 1).alias("at"), s["end"].alias("end"), s["own"].alias("own")))

    def back_block(s, b):
        inner = F.aggregate(F.reverse(b), F.struct(s["at"].alias("at"), s["end"].alias("end"), F.array().cast("array<long>").alias("own")), back)
        return let(inner, lambda r: F.struct(r["at"].alias("at"), r["end"].alias("end"), F.concat(F.array(r["own"]), s["out"]).alias("out")))

    paths = folded.select("bucket", "run", F.flatten(F.aggregate(F.reverse("out"), F.struct(n.alias("at"), n.alias("end"), F.array().cast("array<array<long>>").alias("out")), back_block)["out"]).alias("path"))

    def ids_of(e):
        i = e.bitwiseAND(F.lit(NEVER)).cast("int")
        hexed = F.hex(F.col("run").substr(F.shiftright(e, 20).cast("int") + 1, F.lit(1)))
        as_bytes = F.transform(F.sequence(F.lit(1), (F.length(hexed) / 2).cast("int")), lambda k: F.conv(F.substring(hexed, 2 * k - 1, F.lit(2)), 16, 10).cast("int") + first_byte)
        return F.when(i == 0, as_bytes).otherwise(F.array(i - 1))

    return paths.select("bucket", "run", F.flatten(F.transform("path", ids_of)).alias("ids"))


def squeezed(values: list[bytes]) -> bytes:
    """Byte strings as one: their number, lengths, then the bytes, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(3).compress(np.array([len(values), *map(len, values)], "<u4").tobytes() + b"".join(values))


def loosed(blob: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    at = [4 * n + 4, *(np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 * n + 4).tolist()]
    return [raw[a:b] for a, b in pairwise(at)]


def chunks_of(batches, most_rows: int, most_bytes: int):
    """(chunk, table): the rows (doc_id, text, others) of a task in chunks of bounded size; a longer text is a chunk of its own."""
    import pyarrow.compute as pc

    held, rows, size, k, task = [], 0, 0, 0, TaskContext.get().partitionId() << 32
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < b.num_rows:
            room = np.searchsorted(np.cumsum(sizes[at:]), most_bytes - size, "right")
            n = int(min(max(room, not rows), most_rows - rows, b.num_rows - at))
            if n:
                held.append(b.slice(at, n))
                rows, size, at = rows + n, size + int(sizes[at : at + n].sum()), at + n
            if at < b.num_rows or rows >= most_rows or size >= most_bytes:
                yield task | k, pa.Table.from_batches(held)
                held, rows, size, k = [], 0, 0, k + 1
    if held:
        yield task | k, pa.Table.from_batches(held)


def packed(docs: DataFrame, most_rows: int = CHUNK_ROWS, most_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, blob): the rows of chunks_of(), compressed."""

    def run(batches):
        for chunk, part in chunks_of(batches, most_rows, most_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=7))) as w:
                w.write_table(part.combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=PACKED)

    return docs.mapInArrow(run, PACKED_DDL)


def opened(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def few(texts: list[str | None], most: int = SLICE):
    """Texts some at a time, by about `most` signs: cutting them into runs takes many times their size."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def by_bucket(own: set[str], buckets: int) -> dict[int, list[bytes]]:
    """Distinct runs by bucket, sorted."""
    out: dict[int, list[bytes]] = {}
    for r in sorted(r.encode() for r in own):
        out.setdefault(zlib.crc32(r) % buckets, []).append(r)
    return out


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids for each row of `docs` (doc_id, text; others are ignored): those of the model's own encoder, for runs of any length.

    docs is read twice and has to give its rows in the same order: a scan or a written table. Null and empty
    texts have no pieces, and a text's own spacing sign is a space. Rows that repeat each get a row. No rows give none. A run without a
    place where no piece can go on (letters without a space, say) is one row of the fold: 8 bytes an edge, more while they are gathered.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    chunks = max(1, -(-rows // CHUNK_ROWS), -(-size // CHUNK_BYTES))
    buckets, width = 4 * chunks, 2 if processor(path).get_piece_size() < 1 << 16 else 4  # bytes of an id

    def ask(batches):
        for chunk, part in chunks_of(batches, CHUNK_ROWS, CHUNK_BYTES):
            own: set[str] = set()
            for texts in few(part.column("text").to_pylist()):
                own.update(runs(texts, path)[0])
            if asked := by_bucket(own, buckets):
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(asked), pa.int64()), pa.array(list(asked), pa.int32()), pa.array([squeezed(x) for x in asked.values()], pa.binary())], schema=ASKED)

    def distinct(asked: pa.Table) -> pa.Table:
        """A bucket's distinct runs, and for each chunk which of them it asks for, by their place among the sorted ones."""
        own = [loosed(x) for x in asked.column("runs").to_pylist()]
        every = sorted({r for x in own for r in x})
        place = {r: i for i, r in enumerate(every)}
        at = [squeezed([np.diff([place[r] for r in x], prepend=0).astype("<u4").tobytes()]) for x in own]
        bucket, n = asked.column("bucket")[0].as_py(), len(every)
        return pa.table([pa.array([bucket] * (n + len(at)), pa.int32()), pa.array([r.decode() for r in every] + [None] * len(at), pa.string()), pa.array([None] * n + asked.column("chunk").to_pylist(), pa.int64()), pa.array([None] * n + at, pa.binary())], names=["bucket", "run", "chunk", "at"])

    def answer(asked: pa.Table, told: pa.Table) -> pa.Table:
        own, ids = [r.encode() for r in told.column("run").to_pylist()], told.column("ids").to_pylist()
        known = [np.array(ids[i], f"<u{width}").tobytes() for i in sorted(range(len(own)), key=own.__getitem__)]
        got = [squeezed([known[i] for i in np.cumsum(np.frombuffer(loosed(x)[0], "<u4"), dtype=np.int64).tolist()]) for x in asked.column("which").to_pylist()]
        return pa.table([asked.column("by"), asked.column("of"), pa.array(got, pa.binary())], schema=TOLD)

    def apply(chunk: pa.Table, told: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return pa.Table.from_batches([], schema=ENCODED)
        part = opened(chunk.column("blob")[0].as_buffer())
        every: dict[str, int] = {}  # a number for each run
        places, counts = [], []
        for texts in few(part.column("text").to_pylist()):
            own, n = runs(texts, path)
            places.append(np.fromiter((every.setdefault(r, len(every)) for r in own), np.int64, len(own)))
            counts.append(n)
        asked = by_bucket(set(every), buckets)
        if set(told.column("bucket").to_pylist()) != set(asked):
            raise RuntimeError("the rows of docs came in another order than before: encode a written table")
        known: list[bytes] = [b""] * len(every)
        for bucket, got in zip(told.column("bucket").to_pylist(), told.column("ids"), strict=True):
            for r, ids in zip(asked.pop(bucket), loosed(got.as_buffer()), strict=True):
                known[every[r.decode()]] = ids
        del every
        ids = np.frombuffer(b"".join(known), f"<u{width}").astype(np.int32)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // width
        first, own = np.cumsum(sizes) - sizes, np.concatenate(places)
        del known, places
        ends = np.append(0, np.cumsum(sizes[own]))  # of the runs of all texts among their ids
        out = np.empty(int(ends[-1]), np.int32)
        for at in range(0, len(own), 1 << 18):
            some = own[at : at + (1 << 18)]
            lo, hi = ends[at], ends[at + len(some)]
            out[lo:hi] = ids[np.repeat(first[some] - ends[at : at + len(some)], sizes[some]) + np.arange(lo, hi)]
        ends = ends[np.append(0, np.cumsum(np.concatenate(counts)))]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))
        return pa.table([part.column("doc_id").combine_chunks(), pa.array(np.diff(ends)), lists], schema=ENCODED)

    wanted = written(docs.mapInArrow(ask, ASKED_DDL).groupBy("bucket").applyInArrow(distinct, "bucket int, run string, chunk long, at binary"), "zstd")
    found = lattice(wanted.filter("run IS NOT NULL").select("bucket", "run").repartition(2 * chunks, "bucket"), path)
    wishes = wanted.filter("run IS NULL").select(F.col("bucket").alias("of"), F.col("chunk").alias("by"), F.col("at").alias("which"))
    told = wishes.groupBy("of").cogroup(found.groupBy("bucket")).applyInArrow(answer, TOLD_DDL)
    return packed(docs).groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(apply, "doc_id long, n_pieces long, ids array<int>")


def decode(encoded: DataFrame, path: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """Adds the text of `ids` (null for null): pieces and bytes looked up by id, joined as bytes, spaces put back."""
    sp = processor(path)
    hexed = [sp.id_to_piece(i)[3:5] if sp.is_byte(i) else "" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i).encode().hex() for i in range(sp.get_piece_size())]
    by_id = F.split(F.lit(",".join(hexed)), ",")  # a constant of the plan: folded once, not copied into rows
    raw = F.array_join(F.transform(F.col(ids), lambda i: F.element_at(by_id, i + 1)), "")
    spaced = F.replace(F.decode(F.unhex(raw), "UTF-8"), F.lit(SPACE), F.lit(" "))
    return encoded.withColumn(name, F.when(F.startswith(spaced, F.lit(" ")), spaced.substr(F.lit(2), F.length(spaced))).otherwise(spaced))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodings with the length and checksum of what they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    out = decode(encode(table(spark, sf_dir, "documents"), path), path, name="decoded")
    return out.select("doc_id", "n_pieces", "ids", F.octet_length("decoded").cast("long").alias("decoded_bytes"), F.crc32("decoded").alias("decoded_crc32"))
