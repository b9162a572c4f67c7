"""The model of toxicity learns from every labelled text that isn't held out."""

from collections import Counter

import numpy as np

from krylake.llm import toxicity
from krylake.llm.langid import held_out


def test_counts_are_those_of_all_texts(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefg"), 5)) for _ in range(50)]
    rows = [(i, " ".join(rng.choice(words, 6)) + (" scum" if i % 2 else "")) for i in range(7000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(7000)], "doc_id long, toxic int")
    model = toxicity.learned(docs, labels)
    want = Counter(c for i, t in rows if not held_out(i) for w in t.split() for c in f"{w}$")
    assert dict(model["chars"].counts[0]) == want  # at most 1200 texts a class were counted before
    assert model["weights"]["=scum"] > 0
    assert toxicity.scorer(model)("aaa scum bbb") > 0.9 > 0.1 > toxicity.scorer(model)("aaa bbb")
