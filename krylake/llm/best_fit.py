"""Best-fit packing planned over the histogram of lengths: documents only take the slots planned for their length.

Documents are cut into pieces of at most a window. Which pieces share a sequence depends on their lengths
alone, so the plan is made from counts by length (at most `window` of them): from the longest length to the
shortest, the whole count of a length goes to the fullest sequences that still hold it, as many in a sequence
as fit, and what no open sequence holds opens new ones. Sequences that were filled alike are one interval of
numbers, so a step of the plan fills an interval, never a sequence; a length splits at most one interval. The
plan's size follows from the window, not from the documents. A piece finds its slot by its rank within its
length: the number of such pieces in earlier parts of the table, and before it in its own part.
"""

import bisect
import functools
import re
import struct
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from krylake.llm.common import batch, table, written

END = 1
WINDOW = 4096
CACHE = 300_000  # words of which a task remembers the ids
WORD = 64  # longer ones aren't remembered
PIECES = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
PIECES_DDL = "part int, before long, doc_id long, piece int, start long, length long, doc_tokens long, ids binary"
PLAN_DDL = "of_length long, low long, high long, each long, first long, at long"


#: What the words are made of whose ids are put together here: ASCII and the Latin letters from U+00C0 to U+017F (but U+0130, whose small form is two signs). They are their own normal form.
PLAIN = re.compile(r"[\x00-\x7F\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]*")
#: The tokenizer's own split, for such words.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]+|[0-9]|[^\x09-\x0D\x20a-z0-9\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]+")
BYTES = dict(zip(range(256), (chr(b) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD else "" for b in range(256)), strict=True))  # byte-level BPE writes these bytes as themselves
BYTES |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if not BYTES[b])}  # and the others from 256 on


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Words(dict):
    """Ids of a word without white space, as bytes: looked up, or found by the tokenizer and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.parts, self[""] = self.tokenizer.model, {}, b""

    def part(self, text: str) -> bytes:
        ids = self.parts.get(text)
        if ids is None:
            if len(self.parts) > CACHE:
                self.parts.clear()
            letters = text if text.isascii() and text.isprintable() else "".join(map(BYTES.__getitem__, text.encode()))
            ids = packed([t.id for t in self.model.tokenize(letters)])
            if len(text) <= WORD:
                self.parts[text] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        if "<|" not in word and PLAIN.fullmatch(word):
            ids = b"".join(map(self.part, SPLIT.findall(word.lower())))
        else:  # tokens of its own, signs with a normal form: by the tokenizer as a whole
            ids = packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(self) > CACHE:
            self.clear()
            self[""] = b""
        if len(word) <= WORD:
            self[word] = ids
        return ids


@functools.cache
def encoder(path: str):
    """A text to its ids (little-endian, 32 bits each) by a tokenizer.json that lowers letters and drops white space: no token spans two words, so each is encoded by itself."""
    words = Words(path)
    return lambda text: b"".join(map(words.__getitem__, text.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ")))


def cut(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """A row a piece: its ids (little-endian, 32 bits each) and how many pieces of its length came before it in its part; written, so that later reads agree."""

    def run(batches):
        encode, part, before, end = encoder(path), TaskContext.get().partitionId(), Counter(), packed([END])
        for b in batches:
            for first in range(0, b.num_rows, 64):
                own = b.slice(first, 64)
                out = []
                for doc_id, text in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), strict=True):
                    ids = encode(text or "") + end
                    for start in range(0, len(ids) // 4, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        out.append((part, before[len(piece)], doc_id, start // window, start, len(piece) // 4, len(ids) // 4, piece))
                        before[len(piece)] += 1
                yield batch(PIECES, *zip(*out, strict=True))

    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES_DDL), "zstd")


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, each, first, at): pieces of that length with ranks from low up to high fill sequences from `first` on, `each` in one, from place `at` on.

    Best fit over counts: longest first, always into the sequences with the least room that suffices.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left: intervals (first sequence, how many) filled alike
    rooms: list[int] = []  # the keys of `room`, sorted
    opened, steps = 0, []

    def leave(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in room:
                bisect.insort(rooms, space)
                room[space] = []
            room[space].append((first, n))

    for length in sorted(counts, reverse=True):
        low, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                space = rooms[k]
                first, n = room[space].pop()
                if not room[space]:
                    del room[space], rooms[k]
            else:
                space, first, n = window, opened, -(-left // (window // length))
                opened += n
            each = space // length
            full = min(n, left // each)
            if full:
                steps.append((length, low, low + full * each, each, first, window - space))
                leave(space - each * length, first, full)
            low, left, first, n = low + full * each, left - full * each, first + full, n - full
            if left and n:  # fewer than `each` of them: one sequence takes them all
                steps.append((length, low, low + left, left, first, window - space))
                leave(space - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            leave(space, first, n)
    return steps


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Pieces (doc_id, piece, start, length, doc_tokens, ids, ids_crc32, sequence_id, offset) of all rows of `docs`; `ids` are little-endian 32-bit numbers.

    docs: doc_id, text; other columns are ignored, whatever their names. A null or empty text is its end token
    alone. Only documents longer than `window` are cut, every `window` tokens. Rows that repeat, and rows
    without a doc_id, are packed each. No rows, no pieces. Every sequence is filled from 0 without gaps.

    To the driver comes one count a length, at most `window`; the plan, of a size that follows from them, is broadcast.
    """
    pieces = cut(docs, path, window).withColumn("ids_crc32", F.crc32("ids"))  # before the join, which then needn't carry the ids of who asks for no more
    sums = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("of").orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("part").alias("of_part"), F.col("length").alias("of"), "n").withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    steps = plan({r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}, window)
    slots = docs.sparkSession.createDataFrame(steps, PLAN_DDL)
    ranked = pieces.join(bases, (F.col("part") == F.col("of_part")) & (F.col("length") == F.col("of"))).withColumn("rank", F.col("base") + F.col("before"))
    found = ranked.join(F.broadcast(slots), (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    place = F.col("rank") - F.col("low")
    return found.select("doc_id", "piece", "start", "length", "doc_tokens", "ids", "ids_crc32", (F.col("first") + F.floor(place / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + place % F.col("each") * F.col("length")).alias("offset"))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, tokens, ids): the pieces of each sequence in their order, at most a window of tokens."""
    own = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.unhex(F.array_join(F.transform(own, lambda x: x["ids"]), "")).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    p = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return p.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "doc_tokens")
