"""Best-fit packing, periodic runs and ranked search against plain versions: nulls, empty and long texts, ties, repeats, no rows, clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from krylake.llm import best_fit, lexical_search, periodic_runs

DDL = "doc_id long, text string, source string, part int, rank long, length long, shard long, term string, score double"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(12000))
TEXTS = ["The cat sat on the mat by the old door", "the CAT sat on the mat by the old door", None, "", " \t\n ", "été à la plage l'été", LONG, LONG + " end", "ab" * 3000, "a", "a", "漢字 と かな 🙂 <|endoftext|>x it's 1234", "na " * 40 + "end", "x y " * 9 + "z " * 7, "The cat sat on the mat by the old door"]


@pytest.fixture(scope="module")
def rows():
    ids = [*range(10, 10 + 10 * len(TEXTS), 10)]
    ids[3], ids[9] = None, ids[10]
    return [(i, t, ["hot", None][k % 2], 1, 2, 3, 4, "k", 0.5) for k, (i, t) in enumerate(zip(ids, TEXTS, strict=True))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def test_plan_is_best_fit_over_counts():
    """Every rank of every length has one place, sequences are filled without gaps, and their number is close to the least possible."""
    rng = random.Random(3)
    for _ in range(60):
        window = rng.choice([1, 7, 64, 300])
        counts = Counter(rng.choice([rng.randint(1, window), min(window, 3)]) for _ in range(rng.randint(1, 400)))
        filled, ranks = defaultdict(list), defaultdict(list)
        for length, low, high, each, first, at in best_fit.plan(dict(counts), window):
            for r in range(low, high):
                ranks[length].append(r)
                filled[first + (r - low) // each].append((at + (r - low) % each * length, length))
        assert all(sorted(ranks[n]) == list(range(counts[n])) for n in counts)
        for own in filled.values():
            own.sort()
            assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(own)) and sum(own[-1]) <= window
        free: list[int] = []
        for n in sorted(counts.elements(), reverse=True):  # best fit, one after another
            k = min((k for k, f in enumerate(free) if f >= n), key=lambda k: free[k], default=None)
            if k is None:
                free.append(window - n)
            else:
                free[k] -= n
        assert len(filled) == len(free)
    assert best_fit.plan({}) == []


def test_best_fit_packing(docs, rows, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    want = Counter()
    for i, t, *_ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, best_fit.END]
        for k in range(0, len(ids), 4096):
            want[(i, k // 4096, k, len(ids[k : k + 4096]), np.array(ids[k : k + 4096], "<u4").tobytes(), len(ids))] += 1
    pieces = best_fit.pack(docs, path)
    got = pieces.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"], bytes(r["ids"])))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in itertools.pairwise(own)) and own[-1][0] + own[-1][1] <= 4096
    whole = {r["sequence_id"]: (r["tokens"], bytes(r["ids"])) for r in best_fit.sequences(pieces).collect()}
    assert whole == {s: (sum(x[1] for x in own), b"".join(x[2] for x in own)) for s, own in by.items()}
    assert len(by) == max(-(-sum(len(b) // 4 for _, b in whole.values()) // 4096), len(by)) and sum(n for n, _ in whole.values()) > 4096 * (len(by) - 2)
    assert best_fit.pack(none, path).count() == 0


def plain_runs(w):
    """Every stretch of every period, those of a multiple of their smallest period left out."""
    found = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.add((i, j - i + q, q))
            i = j + 1
    return sorted(((s, n, q) for s, n, q in found if not any((s, n, p) in found for p in range(1, q))), key=lambda r: (r[0], r[2]))


def plain_answer(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    if doc_id is not None and w and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    r = plain_runs(w)
    top = min(r, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
    drop = {k for s, n, q in r for k in range(s + q, s + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(r), *top, 1000 * top[1] // top[2] if r else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in r).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in drop)))


def test_periodic_runs(spark, rows, none, tmp_path):
    rng = random.Random(5)
    more = []
    for k in range(400):
        w = [f"w{rng.randrange(rng.choice([1, 2, 3, 50]))}" for _ in range(rng.choice([0, 1, 5, 6, 30, 200]))]
        for _ in range(rng.randrange(3)):
            w += w[: rng.randrange(1, 40)] * rng.randrange(1, 9)
        more.append((1000 + k, " ".join(w), "s", 1, 2, 3, 4, "k", 0.5))
    short = [r for r in rows if r[1] is None or len(r[1]) < 20000]
    spark.createDataFrame([*short, *more], DDL).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = Counter(tuple(r[c] for c in names) for r in periodic_runs.query(spark, str(tmp_path)).collect())
    assert got == Counter(plain_answer(r[0], r[1]) for r in [*short, *more])
    assert sum(k[1] > 0 for k in got) > 100
    assert periodic_runs.find(none).count() == 0


def test_extensions_agree_with_comparison():
    rng = np.random.default_rng(2)
    for n, k in ((1, 1), (40, 1), (700, 2), (700, 30)):
        words = np.append(rng.integers(0, k, n), 1000)
        e = periodic_runs.Extensions(words)
        x, y = np.sort(rng.integers(0, n + 1, (2, 500)), axis=0)
        x, y = x[x < y], y[x < y]
        want = [next(d for d in itertools.count() if b + d > n or words[a + d] != words[b + d]) for a, b in zip(x, y, strict=True)]
        assert e(x, y).tolist() == want


def test_long_runs_take_no_longer_than_their_length():
    n = 60_000
    for words in (["a"] * n, [f"x{k % 1000}" for k in range(n)]):
        _, found, left = periodic_runs.answers([1], [" ".join(words)], None)
        q = len(set(words))
        assert found == [[{"start": 0, "length": n, "period": q}]] and left == [" ".join(words[:q])]


def plain_terms(t):
    return [x.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) for x in re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode())]


def plain_search(rows, items):
    held = [(r[0], Counter(plain_terms(r[1]))) for r in rows]
    sizes = [sum(c.values()) for _, c in held]
    n, total, df = sum(s > 0 for s in sizes), sum(sizes), Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc_id, c), size in zip(held, sizes, strict=True):
            m = 10 + 90 * size * n // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if t in c)
            if s > 0:
                found.append((-s, doc_id is None, doc_id))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(found)[:10])]
    return Counter(out)


def test_ranked_search(spark, docs, rows, none):
    """Scores, ties by doc_id and ranks as by scoring every document, with shards and groups of any size."""
    rng = random.Random(8)
    extra = [(1000 + k, " ".join(rng.choice(["the", "cat", "door", "old", "zebra", f"t{rng.randrange(60)}"]) for _ in range(rng.randrange(1, 60))), None, 1, 2, 3, 4, "k", 0.5) for k in range(900)]
    every = [*rows, *extra, *[(5000 + k, "the zebra sat by the door", None, 1, 2, 3, 4, "k", 0.5) for k in range(300)]]
    items = [(1, "The cat, the door!"), (2, None), (3, ""), (4, "zebra ZEBRA t1 t2 t3 t4"), (5, "nothing-here"), (6, "W5x5 été"), (6, "a"), (None, "the old t7 door sat by"), (7, " ".join(f"t{k}" for k in range(60)))]
    d = spark.createDataFrame(every, DDL).repartition(4)
    i = spark.createDataFrame([(a, b, "x", 1.0) for a, b in items], "item_id long, text string, term string, score double")
    want = plain_search(every, items)
    for words, group in ((1 << 20, 256), (3000, 2)):
        got = lexical_search.best(d, i, words=words, group=group).collect()
        assert Counter(tuple(r) for r in got) == want
    assert lexical_search.best(none, i).count() == 0 and lexical_search.best(docs, i.limit(0)).count() == 0


def test_search_rejects_blocks_before_decompression(spark):
    """One short document holds the rare term: of the frequent term's list only the block with it is opened."""
    texts = ["rare common"] + ["common " + "filler " * 30 for _ in range(5000)]
    shard = lexical_search.Shard()
    for k, t in enumerate(texts):
        shard.add(k, t)
    built = {r["term"]: r for r in shard.rows(0).to_pylist()}
    sizes = np.frombuffer(built[None]["least"], "<i4").astype(np.int64)
    norm = lambda s: 10 + 90 * s.astype(np.int64) * len(texts) // int(sizes.sum())
    rare, common = (lexical_search.Postings(built[t], w, norm) for t, w in ((b"rare", 9000), (b"common", 10)))
    docs, scores = lexical_search.search([rare, common], norm(sizes), 1)
    assert docs.tolist() == [0] and len(common.last) == 40 and list(common.known) == [0]
