"""Clean texts are counted for the features of toxic ones alone, some at a time; the best features are those of a plain count of everything."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from krylake.llm import toxicity as tox


def plain_best(rows, chars, n0, n1, limit, contexts, ratio):
    known, sums, before = tox.Known(chars), defaultdict(lambda: [0, 0]), defaultdict(set)
    for t, label in rows:
        every = tox.tokens(t, chars)
        for f, n in Counter(f for x in every for f in known.told(x)).items():
            for k in range(1, min(n, 3) + 1):
                sums[f, k][label] += 1
        if label:
            ws = t.lower().split()
            row = [*ws, *sorted(every.difference(ws))]
            for last, x in zip(["", *row], row, strict=False):
                for f in known.told(x):
                    before[f].add(last)
    worth = [(-(b / n1 - ratio * a / n0), f, k) for (f, k), (a, b) in sums.items() if len(before[f]) >= contexts]
    return [(f, k) for w, f, k in sorted(worth)[:limit] if w < 0]


@pytest.mark.parametrize("able, limit", [(1 << 17, 4000), (7, 4000), (5, 8)])
def test_best_features_are_those_of_a_plain_count(spark, monkeypatch, able, limit):
    monkeypatch.setattr(tox, "ABLE", able)
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(3, 8))) for _ in range(40)]
    bad = ["scumbag", "vermin", "filthy", "l0ser", "loooser"]
    rows = [(" ".join([*rng.choice(words, 8), *(rng.choice(bad, 3) if i % 3 == 0 else rng.choice(bad, int(i % 40 == 1)))]), int(i % 3 == 0)) for i in range(600)]
    train = spark.createDataFrame(rows, "text string, toxic int").repartition(3).cache()
    chars, n1 = tox.char_model(train), sum(y for _, y in rows)
    got = tox.telling(train, chars, len(rows) - n1, n1, limit, 5, 5.0)
    assert got and got == plain_best(rows, chars, len(rows) - n1, n1, limit, 5, 5.0)


def test_grams_are_those_of_a_plain_count():
    words = Counter({"abba": 3, "é": 1, "𝒜x": 2, "ab": 70000})
    want: Counter = Counter()
    for w, n in words.items():
        s = f"^^{w}$"
        for i in range(2, len(s)):
            for k in range(3):
                want[s[i - k : i + 1]] += n
    grams, counts = tox.char_grams(words)
    assert dict(zip(grams, counts, strict=True)) == want and len(grams) == len(want)
    assert tox.char_grams(Counter()) == ([], [])


def test_words_of_letters_are_suspect_only_when_drawn_out():
    for x in ("loooser", "loser", "aab", "ﬀﬀﬀ", "ııı", "ß", "ªªª", "ǅǅǅ", "漢漢漢字"):
        assert x.isalpha() and bool(tox.DRAWN.search(x)) == bool(tox.SUSPECT.search(x))
