"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Suspicious tokens (leetspeak inside words, letters spaced out, drawn-out repetitions) become a
lattice of characters; Viterbi picks the restoration that a character trigram model and the channel
find likeliest. The restored words and their beginnings are the features of a logistic model.
Language model, features and classifier learn from all labelled texts that aren't held out: tasks count
trigrams of characters and features, sums come together in a shuffle, and the weights are fitted over a
distributed table. Toxic texts say first which features may count; clean texts are counted for these alone,
the frequent ones first, until no other can be among the best. The driver holds the trigrams, the features
counted at once and those that were chosen, never texts.
"""

import math
import re
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from krylake.llm.common import annotated, batch, forget, table, written
from krylake.llm.langid import held_out, trainable

#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "*": "aeiou", "#": "h", "ø": "o"}
STRIP = ".,;:?\"'()[]{}<>-_/\\|!*~`#&=%+"
SUSPECT = re.compile(r"[^\W\d_][0-9@$!|+(<€£¥*#]|[0-9@$!|+(<€£¥*#][^\W\d_]|([^\W\d_])\1\1|[^\W\d_]([.\-_*~])[^\W\d_]\2[^\W\d_]")
DRAWN = re.compile(r"([^\W\d_])\1\1")  # all that can be suspect in a word of letters
SPACED = re.compile(r"(?<!\S)[^\W_](?:[ .\-_*]{1,2}[^\W_]){2,}(?!\w)")
CACHE = 100_000  # words a task remembers; beyond, it begins anew
FLUSH = 200_000  # features that a task counts before it hands them on
ABLE = 1 << 17  # features that clean texts are counted for at once
GRAMS = pa.schema([("gram", pa.string()), ("n", pa.int64())])
FOUND = pa.schema([("f", pa.string()), ("k", pa.int32()), ("n", pa.int64()), ("before", pa.list_(pa.int64()))])
SEEN = pa.schema([("f", pa.string()), ("c1", pa.int64()), ("c2", pa.int64()), ("c3", pa.int64())])
TEXTS = pa.schema([("toxic", pa.int32()), ("at", pa.list_(pa.int32()))])


def named(f: str, k: int) -> str:
    return f if k == 1 else f"{f}#{k}"


def repeated(hits: Counter) -> set[str]:
    """Features, and that two or three different words of the text have one."""
    return {named(f, k) for f, n in hits.items() for k in range(1, min(n, 3) + 1)}


def char_grams(words: Counter) -> tuple[list[str], list[int]]:
    """How often the characters of words occur, alone and after the one or two before them."""
    if not words:
        return [], []
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 3
    signs = np.frombuffer("".join(f"^^{w}$" for w in words).encode("utf-32-le"), "<u4").astype(np.int64)
    times, inner, first = np.repeat(np.fromiter(words.values(), np.int64, len(words)), sizes), np.ones(len(signs), bool), np.cumsum(sizes) - sizes
    inner[first] = inner[first + 1] = False
    at = np.flatnonzero(inner)
    grams, counts = [], []
    for k in range(3):
        keys, of = np.unique(sum(signs[at - j] << 21 * j for j in range(k + 1)), return_inverse=True)
        text = np.stack([keys >> 21 * j & 0x1FFFFF for j in range(k, -1, -1)], axis=1).astype("<u4").tobytes().decode("utf-32-le")
        grams += [text[i : i + k + 1] for i in range(0, len(text), k + 1)]
        counts += np.bincount(of, times[at]).astype(np.int64).tolist()
    return grams, counts


class CharModel:
    """Log-probabilities of a character after the two before it, interpolated with lower orders."""

    def __init__(self, grams: dict[str, int]):
        self.counts, self.before = [Counter(), Counter(), Counter()], [Counter(), Counter(), Counter()]
        for g, n in grams.items():
            self.counts[len(g) - 1][g] += n
            self.before[len(g) - 1][g[:-1]] += n
        self.kinds, self.memo = len(self.counts[0]) + 1, {}

    def cost(self, context: str, c: str) -> float:
        key = context + c
        if (got := self.memo.get(key)) is None:
            p = (self.counts[0][c] + 1) / (self.before[0][""] + self.kinds)
            for k in (1, 2):
                n = self.before[k][context[2 - k :]]
                p = (self.counts[k][context[2 - k :] + c] + 3 * p) / (n + 3)
            got = self.memo[key] = -math.log(p)
        return got


def lattice(token: str, spaced: bool = False) -> list[list[tuple[str, float]]]:
    """For each run of one sign, the letters it may stand for and the channel's cost; spacers may vanish. In spaced-out text every sign stands alone."""
    out = []
    for m in re.finditer(r"." if spaced else r"(.)\1*", token, re.S):
        c, n = m[0][0], len(m[0])
        if c.isalpha():
            paths = [(c, 0.3 * (n > 1) * (n != 2) + (n == 2) * 1.5), (c * 2, 0.0 if n == 2 else 1.0)] if n > 1 else [(c, 0.0)]
            paths += [(x, 1.0) for x in LEET.get(c, "")]
        elif c in LEET:
            paths = [(x * k, 1.0 + 0.5 * (k != n)) for x in LEET[c] for k in {1, min(n, 2)}] + [(c * n, 6.0)]
        else:
            paths = [("", 0.5), (c * n, 6.0)]
        out.append(paths)
    return out


def restore(token: str, model: CharModel, spaced: bool = False) -> str:
    """The likeliest word behind a token, of any length; in spaced-out text the likeliest words, as a word may end after any sign.

    Viterbi over states of two characters, of which there are as many as two neighbouring runs allow; a state
    keeps its cost and where it came from. Ties go to the path met first.
    """
    best, trail = {"^^": (0.0, -1)}, []
    for paths in lattice(token, spaced):
        after: dict[str, tuple[float, int, str]] = {}
        for state, (cost, at) in best.items():
            for letters, channel in paths:
                total, s = cost + channel, state
                for c in letters:
                    total += model.cost(s, c)
                    s = s[1] + c
                if s not in after or total < after[s][0]:
                    after[s] = (total, at, letters)
        if spaced and (ends := [(cost + model.cost(s, "$"), at, f"{letters} ") for s, (cost, at, letters) in after.items() if s != "^^"]):
            end = min(ends)
            if "^^" not in after or end[0] < after["^^"][0]:
                after["^^"] = end
        best = {}
        for s, (cost, at, letters) in after.items():
            best[s] = (cost, len(trail))
            trail.append((at, letters))
    _, at = min((cost + (model.cost(s, "$") if s != "^^" else 0.0), at) for s, (cost, at) in best.items())
    out = []
    while at >= 0:
        at, letters = trail[at]
        out.append(letters)
    return "".join(reversed(out))


def normal(token: str, model: CharModel | None) -> list[str]:
    """The word of a token, and what it is restored to if it looks obfuscated."""
    word = token.strip(STRIP)
    if model and SUSPECT.search(token):
        whole = restore(token.rstrip(".,;:?!\"')]}"), model)
        return [w for w in dict.fromkeys((word, whole.strip(STRIP))) if w]
    return [word] if word else []


def tokens(text: str, model: CharModel | None) -> set[str]:
    """Distinct lower-cased tokens of a whole text, and the words that runs of spaced letters spell, whole and parted."""
    low = text.lower()
    out = set(low.split())
    if model:
        for m in SPACED.finditer(low):
            joined = re.sub(r"[ .\-_*]", "", m[0])
            out.update(restore(joined, model, spaced=True).split())
            out.add(restore(joined, model))
    return out


def features(word: str) -> list[str]:
    """The word and its beginnings of four to six characters."""
    return [f"={word}", *[f"^{word[:n]}" for n in (4, 5, 6) if len(word) >= n]]


class Known:
    """The features of words and of what they are restored to, as `able` names them, if given, and no others; the last ones are remembered."""

    def __init__(self, chars: CharModel | None, able: dict | None = None):
        self.chars, self.able, self.memo, self.restored = chars, able, {}, {}  # restoring takes longest, and few words need it
        self.heads = {f[1:5] for f in able or ()}  # a word that begins otherwise has none of them

    def named(self, words: list[str]) -> tuple:
        if self.able is None:
            return tuple(f for w in words if w for f in features(w))
        return tuple(self.able[f] for w in words if w[:4] in self.heads for f in features(w) if f in self.able)

    def told(self, x: str) -> tuple:
        if (DRAWN if x.isalpha() else SUSPECT).search(x):
            if (got := self.restored.get(x)) is None:
                if len(self.restored) > CACHE:
                    self.restored.clear()
                got = self.restored[x] = self.named(normal(x, self.chars))
            return got
        w = x.strip(STRIP)
        return () if self.able is not None and w[:4] not in self.heads else self.named([w])

    def all(self, every: set[str]):
        """The features of a text's tokens, once for each token that has one."""
        if len(self.memo) > CACHE:
            self.memo.clear()
        for x in every.difference(self.memo):
            self.memo[x] = self.told(x)
        return chain.from_iterable(map(self.memo.__getitem__, every))


def char_model(train: DataFrame) -> CharModel:
    """The character model of all words of letters in the texts of `train`."""

    def run(batches):
        found: Counter = Counter()

        def out():
            words: Counter = Counter()
            for x, n in found.items():
                if (w := x.strip(STRIP)).isalpha():
                    words[w] += n
            found.clear()
            return batch(GRAMS, *char_grams(words))

        for b in batches:
            for t in b.column(0).to_pylist():
                found.update(t.lower().split())
                if len(found) > CACHE:
                    yield out()
        yield out()

    sums = train.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return CharModel({r["gram"]: r["n"] for r in sums.collect()})


def evidence(toxic: DataFrame, chars: CharModel, contexts: int) -> DataFrame:
    """(f, k, n, before): of a task's toxic texts, those with k different words that have the feature f; hashes of words before it, `contexts` at most: so many of
    one task are enough."""

    def run(batches):
        known, seen, before = Known(chars), Counter(), defaultdict(set)

        def out():
            keys = list(seen)
            return batch(FOUND, [f for f, _ in keys], [k for _, k in keys], list(seen.values()), [list(before.get(f, ())) if k == 1 else [] for f, k in keys])

        for b in batches:
            for t in b.column(0).to_pylist():
                ws = t.lower().split()
                every = tokens(t, chars)
                for f, n in Counter(known.all(every)).items():
                    for k in range(1, min(n, 3) + 1):
                        seen[f, k] += 1
                row = [*ws, *sorted(every.difference(ws))]
                for last, x in set(zip(["", *row], row, strict=False)):
                    h = xxhash.xxh64_intdigest(last.encode("utf-8", "surrogatepass")) - (1 << 63)
                    for f in known.memo[x]:
                        if len(before[f]) < contexts:
                            before[f].add(h)
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
                    before.clear()
        if seen:
            yield out()

    return toxic.select("text").mapInArrow(run, "f string, k int, n long, before array<long>")


def seen_in(clean: DataFrame, chars: CharModel, names: list[str]) -> DataFrame:
    """(f, c1, c2, c3): clean texts with one, two and three different words that have one of the features `names`; those with none aren't listed."""

    def run(batches):
        known, n = Known(chars, {f: i for i, f in enumerate(names)}), len(names)
        sums = np.zeros((3, n), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                own = [np.fromiter(known.all(tokens(t, chars)), np.int64) for t in b.column(0).slice(at, 256).to_pylist()]
                keys, times = np.unique(np.concatenate([x + i * n for i, x in enumerate(own)]), return_counts=True)
                for k in range(3):
                    sums[k] += np.bincount(keys[times > k] % n, minlength=n)
        some = np.flatnonzero(sums[0])
        yield batch(SEEN, [names[i] for i in some.tolist()], *sums[:, some])

    return clean.select("text").mapInArrow(run, "f string, c1 long, c2 long, c3 long").groupBy("f").agg(*[F.sum(c).alias(c) for c in ("c1", "c2", "c3")])


def telling(train: DataFrame, chars: CharModel, n0: int, n1: int, limit: int, contexts: int, ratio: float) -> list[tuple[str, int]]:
    """The `limit` best features (f, k), those with the largest share of toxic texts less `ratio` times that of clean ones.

    Clean texts can only lower that, so features are taken by their toxic texts, ABLE at a time, until the best are better than any that is left could be."""
    found = written(evidence(train.filter("toxic = 1"), chars, contexts))
    able = found.filter(F.size("before") > 0).select("f", F.explode("before").alias("b")).distinct().groupBy("f").agg(F.count("*").alias("c")).filter(F.col("c") >= contexts).select("f")
    toxic = written(found.groupBy("f").agg(*[F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"t{k}") for k in (1, 2, 3)]).join(able, "f", "left_semi"))
    best, rest = [], toxic
    while (told := rest.orderBy(F.desc("t1"), "f").limit(ABLE).select("f", "t1").toArrow()).num_rows:
        names, most, t = told.column("f").to_pylist(), told.column("t1")[0].as_py(), told.column("t1")[-1].as_py()
        if len(best) == limit and most / n1 < -best[-1][0]:
            break
        after = (F.col("t1") < t) | ((F.col("t1") == t) & (F.col("f") > names[-1]))
        both = rest.filter(~after).join(seen_in(train.filter("toxic = 0"), chars, names), "f", "left")
        worth = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"t{k}") / n1 - ratio * F.coalesce(f"c{k}", F.lit(0)) / n0).alias("worth")) for k in (1, 2, 3)]))
        got = both.select("f", worth.alias("w")).select("f", "w.k", "w.worth").filter("worth > 0").orderBy(F.desc("worth"), "f", "k").limit(limit).collect()
        best = sorted([*best, *[(-r["worth"], r["f"], r["k"]) for r in got]])[:limit]
        rest = rest.filter(after)
    for x in (found, toxic):
        forget(x)
    return [(f, k) for _, f, k in best]


def fit(train: DataFrame, limit: int = 4000, contexts: int = 5, ratio: float = 5.0) -> dict | None:
    """Character model, and weights of the features that tell toxic texts; None without rows of both classes. train: text, toxic (0 or 1), a written table.

    A feature needs at least `contexts` different words before it in toxic texts (so that what
    copies of one text share doesn't count as evidence) and a share of toxic texts `ratio` times that of others.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    n0, n1 = train.agg(F.count(F.when(F.col("toxic") == 0, 1)), F.count(F.when(F.col("toxic") == 1, 1))).first()
    if not n0 or not n1:
        return None
    chars = char_model(train)
    best = telling(train, chars, n0, n1, limit, contexts, ratio)
    chosen = [named(f, k) for f, k in best]
    if not chosen:
        return {"chars": chars, "weights": {}, "bias": 0.0}
    index, plain = {f: i for i, f in enumerate(chosen)}, {f: f for f, _ in best}

    def run(batches):
        known = Known(chars, plain)
        for b in batches:
            at = [sorted(index[f] for f in repeated(Counter(known.all(tokens(t, chars)))) if f in index) for t in b.column(0).to_pylist()]
            yield batch(TEXTS, b.column(1).to_pylist(), at)

    size = len(chosen)
    vector = F.udf(lambda at: Vectors.sparse(size, at, [1.0] * len(at)), VectorUDT())
    weight = F.when(F.col("toxic") == 1, (n0 + n1) / (2 * n1)).otherwise((n0 + n1) / (2 * n0))  # both classes weigh the same
    alike = train.select("text", "toxic").mapInArrow(run, "toxic int, at array<int>").groupBy("toxic", "at").agg(F.count("*").alias("n"))
    rows = written(alike)  # texts with the same features are one point
    points = rows.select(F.col("toxic").cast("double").alias("label"), (weight * F.col("n")).alias("weight"), vector("at").alias("features"))
    model = LogisticRegression(weightCol="weight", regParam=1e-5, standardization=False, maxIter=100).fit(points)
    forget(rows)
    w = model.coefficients.toArray()
    return {"chars": chars, "weights": {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}, "bias": float(model.intercept)}


def scorer(model: dict | None):
    """Text to score; with nothing learned, or nothing in the text, the bias alone speaks."""
    chars, weights, bias = (model["chars"], model["weights"], model["bias"]) if model else (None, {}, -5.0)
    known = Known(chars, {f: f for w in weights for f in (w, w.split("#")[0], w.rsplit("#", 1)[0])})

    def score(text: str | None) -> float:
        hits = Counter(known.all(tokens(text or "", chars)))
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, bias + sum(weights.get(f, 0.0) for f in sorted(repeated(hits)))))))

    return score


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with the label toxic; several labels of a document count as their largest. Labels grow as the documents do: they are never broadcast."""
    own = labels.groupBy(F.col("doc_id").cast("long").alias("_label_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return docs.join(own.hint("shuffle_merge"), F.col("doc_id") == F.col("_label_id")).select("doc_id", "text", "toxic")


def learned(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model from all labelled rows with a text whose crc32(doc_id as text) mod 4 is not 2; rows that repeat count each time."""
    train = written(labelled(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2), labels).transform(lambda d: trainable(d, "toxic")).select("text", F.least(F.col("toxic"), F.lit(1)).alias("toxic")), "zstd")
    model = fit(train)
    forget(train)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs` (doc_id, text; other columns are ignored).

    labels: doc_id, toxic (null: no label). Null and empty texts get the score of a text without
    telling words. Without labels of both classes every score is that of a low prior (0.007).
    Rows that repeat each get a row. No rows give none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return annotate(docs, labels, threshold).select("doc_id", F.col("_held_out").alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").cast("int").alias("predicted"))


def annotate(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """`docs` with _held_out, _score and _predicted added; it has none of these."""
    model = learned(docs.select("doc_id", "text"), labels)

    def answer():
        score = scorer(model)

        def found(ids, texts):
            got = [score(t) for t in texts]
            return [held_out(i) for i in ids], got, [int(x >= threshold) for x in got]

        return found

    return annotated(docs, "_held_out boolean, _score double, _predicted long", answer)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
