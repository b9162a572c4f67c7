"""Language ID with a byte convolutional network, trained and applied in numpy.

Bytes (A-Z lower-cased) become classes; filters of widths 2, 3 and 4 slide over windows of fixed
length; max pooling over a window and a softmax give the window's probabilities, and a text has the
mean of its windows'. Texts are covered from end to end by windows. The network is fitted on at most
`per_language` labelled documents of each language, picked by a hash of doc_id.
"""

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from krylake.llm.common import annotated, lowered, table

WINDOW, WIDTHS, FILTERS, DEPTH = 256, (2, 3, 4), 16, 8
CHUNK = 1024  # windows that are scored at once
LETTER = re.compile(r"[^\W\d_]")


def byte_classes() -> np.ndarray:
    """Class of each byte: 0 parts words, 1 digits, 2 other ASCII, then a-z, continuation bytes one by one, lead bytes in groups."""
    c = np.full(256, 2, np.int32)
    c[[0x20, *range(0x09, 0x0E), 0]] = 0
    c[0x30:0x3A] = 1
    c[0x61:0x7B] = np.arange(3, 29)
    c[0x80:0xC0] = np.arange(29, 93)
    c[0xC0:0xE0] = 93 + np.arange(32) // 2
    c[0xE0:0xF0] = 109 + np.arange(16) // 4
    c[0xF0:] = 113
    return c


LABELS = 4096  # classes at most
CLASSES, N_CLASSES = byte_classes(), 114


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte classes (windows, WINDOW) of whole texts, each text padded at its end; the windows of each text."""
    n = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], np.int64)
    joined = b"".join(t.ljust(int(k) * WINDOW, b"\0") for t, k in zip(texts, n, strict=True))
    return CLASSES[np.frombuffer(joined, np.uint8)].reshape(-1, WINDOW), n


def fit(texts: list[bytes], labels: list[str], epochs: int = 6, per_text: int = 4, seed: int = 7) -> dict | None:
    """Weights, or None without labelled text. Adam on cross-entropy; ties in pooling go to the first position."""
    names = sorted(set(labels))
    if not names:
        return None
    rng, xs, ys = np.random.default_rng(seed), [], []
    for t, y in zip(texts, labels, strict=True):
        w, _ = windows([t])
        w = w[np.unique(np.linspace(0, len(w) - 1, per_text).astype(int))]
        w = w[(w > 2).sum(axis=1) >= min(16, (w > 2).sum())]
        xs.append(w)
        ys += [names.index(y)] * len(w)
    x, y = np.concatenate(xs), np.array(ys)
    p = {"e": rng.normal(0, 0.5, (N_CLASSES, DEPTH)), "w": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(names))), "b": np.zeros(len(names))}
    p |= {f"k{n}": rng.normal(0, (2 / (n * DEPTH)) ** 0.5, (n * DEPTH, FILTERS)) for n in WIDTHS} | {f"c{n}": np.zeros(FILTERS) for n in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    size = 64
    for _ in range(max(epochs, min(200, 3000 * epochs // max(1, len(x))))):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // size)):
            own, goal = x[at], y[at]
            e, pools, tops = p["e"][own], [], []
            for n in WIDTHS:
                cols = np.concatenate([e[:, i : WINDOW - n + 1 + i] for i in range(n)], axis=2)
                r = cols @ p[f"k{n}"]
                top = r.argmax(axis=1)
                tops.append(top)
                pools.append(np.take_along_axis(r, top[:, None], 1)[:, 0] + p[f"c{n}"])
            h = np.maximum(np.concatenate(pools, axis=1), 0)
            z = h @ p["w"] + p["b"]
            q = np.exp(z - z.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(len(at)), goal] -= 1
            q /= len(at)
            g = {"w": h.T @ q, "b": q.sum(axis=0), "e": np.zeros_like(p["e"])}
            gh = (q @ p["w"].T) * (h > 0)
            for j, n in enumerate(WIDTHS):
                own_g = gh[:, j * FILTERS : (j + 1) * FILTERS]
                g[f"c{n}"] = own_g.sum(axis=0)
                pos = tops[j][:, :, None] + np.arange(n)  # (batch, filters, n)
                ids = own[np.arange(len(at))[:, None, None], pos]
                seen = p["e"][ids].reshape(len(at), FILTERS, n * DEPTH)
                g[f"k{n}"] = np.einsum("bf,bfd->df", own_g, seen)
                back = (own_g[:, :, None] * p[f"k{n}"].T[None]).reshape(len(at), FILTERS, n, DEPTH)
                np.add.at(g["e"], ids, back)
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= (0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return {"names": names} | p


def tables(model: dict) -> dict:
    """The filters' answers by pair of classes, so that scoring looks up and adds."""
    e, out = model["e"], {"w": model["w"], "b": model["b"], "names": model["names"]}
    one = {(n, i): e @ model[f"k{n}"][i * DEPTH : (i + 1) * DEPTH] for n in WIDTHS for i in range(n)}
    pair = lambda n, i: (one[n, i][:, None] + one[n, i + 1][None]).reshape(-1, FILTERS)
    return out | {"p2": pair(2, 0), "p3": pair(3, 0), "s3": one[3, 2], "p4": pair(4, 0), "q4": pair(4, 2), "c": np.concatenate([model[f"c{n}"] for n in WIDTHS])}


def probabilities(t: dict, x: np.ndarray) -> np.ndarray:
    """(windows, languages) for windows of byte classes."""
    pairs = x[:, :-1] * N_CLASSES + x[:, 1:]
    r3 = t["p3"].take(pairs[:, :-1], axis=0)
    r3 += t["s3"].take(x[:, 2:], axis=0)
    r4 = t["p4"].take(pairs[:, :-2], axis=0)
    r4 += t["q4"].take(pairs[:, 2:], axis=0)
    h = np.concatenate([t["p2"].take(pairs, axis=0).max(axis=1), r3.max(axis=1), r4.max(axis=1)], axis=1)
    z = np.maximum(h + t["c"], 0) @ t["w"] + t["b"]
    q = np.exp(z - z.max(axis=1, keepdims=True))
    return q / q.sum(axis=1, keepdims=True)


def predict(t: dict | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and its probability; und, 0 where a text is null, has no letter, or nothing was learned."""
    out, at = [("und", 0.0)] * len(texts), [i for i, s in enumerate(texts) if s and LETTER.search(s)]
    if t is None or not at:
        return out
    x, n = windows([lowered(texts[i]) for i in at])
    q = np.concatenate([probabilities(t, x[i : i + CHUNK]) for i in range(0, len(x), CHUNK)])
    weight = ((x > 2).sum(axis=1) + 1e-6)[:, None]  # by letters: a window of digits says little
    starts = np.cumsum(n) - n
    means = np.add.reduceat(q * weight, starts, axis=0) / np.add.reduceat(weight, starts, axis=0)
    for i, row in zip(at, means, strict=True):
        out[i] = (t["names"][int(row.argmax())], float(min(1.0, row.max())))
    return out


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def sampled(rows: DataFrame, label: str, per_label: int, by: tuple[str, ...] = ("doc_id", "text")) -> list:
    """Different rows, at most `per_label` of each label, those with the smallest hashes of `by`: different rows of a label are counted
    first (by a sketch), and a hash threshold lets through little more than is wanted, so that nothing is ranked at large. Rows that repeat, however
    often, come to the driver once; a row with the same `by` as another has its label's other columns alike or is told apart by them."""
    rows = rows.withColumn("_h", F.pmod(F.xxhash64(*by, F.lit(5)), F.lit(1 << 30)))
    cut = F.ceil((per_label + 6 * per_label**0.5 + 10) / F.greatest(F.approx_count_distinct("_h", 0.02), F.lit(1)) * (1 << 30))
    cuts = rows.groupBy(F.col(label).alias("_label")).agg(cut.alias("_cut")).limit(LABELS + 1).collect()
    if len(cuts) > LABELS:
        raise ValueError(f"over {LABELS} labels: each would be a class of the model")
    few = rows.sparkSession.createDataFrame(cuts, f"_label {dict(rows.dtypes)[label]}, _cut long")
    got = rows.join(F.broadcast(few), F.col(label) == F.col("_label")).filter("_h < _cut").drop("_label", "_cut").distinct().collect()
    taken: Counter = Counter()
    out = []
    for r in sorted(got, key=lambda r: (r["_h"], str(r))):
        taken[r[label]] += 1
        if taken[r[label]] <= per_label:
            out.append(r)
    return out


def trainable(docs: DataFrame, label: str) -> DataFrame:
    """Rows with a label and a text whose crc32(doc_id as text) mod 4 is not 2."""
    return docs.filter(F.col(label).isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))


def identify(docs: DataFrame, per_language: int = 300, per_text: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of `docs` (doc_id, text, lang; others are ignored).

    Learns from rows with a lang whose crc32(doc_id as text) mod 4 is not 2: at most `per_language` different ones
    of each language, and of each `per_text` windows spread over the text (at both ends and between), as bounds of the
    sample; a prediction reads all windows of its text. More than LABELS languages are an error: each is a class of the model. `und` with
    score 0 for null or empty texts, texts without a letter, and when nothing could be learned (no such row).
    Ties between languages go to the first by name. Rows that repeat each get a row. No rows give none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    return annotate(docs, per_language, per_text).select("doc_id", F.col("_held_out").alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


def annotate(docs: DataFrame, per_language: int = 300, per_text: int = 4) -> DataFrame:
    """`docs` with _held_out, _lang_pred, _score and _letters (whether the text has a letter) added; it has none of these."""
    rows = sampled(trainable(docs.select("doc_id", "text", "lang"), "lang"), "lang", per_language)
    model = fit([lowered(r["text"]) for r in rows], [r["lang"] for r in rows], per_text=per_text)
    t = tables(model) if model else None

    def answer():
        def found(ids, texts):
            got = predict(t, texts)
            return [held_out(i) for i in ids], [x for x, _ in got], [x for _, x in got], [bool(s and LETTER.search(s)) for s in texts]

        return found

    return annotated(docs, "_held_out boolean, _lang_pred string, _score double, _letters boolean", answer)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
