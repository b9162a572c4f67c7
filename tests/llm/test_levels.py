"""op1's filter keeps n-grams that occur once."""

import numpy as np

from krylake.llm import ngram_lm


def test_counts_of_one_have_an_entry():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 4000).astype(np.uint64))
    short = ((keys << np.uint64(4)) >> np.uint64(32)).astype(np.uint64)
    seen = np.arange(len(keys)) % 2 == 0
    parts = {}
    for b, s in ngram_lm.blocks(keys, 4):
        parts[b] = ngram_lm.bloom(short[s][seen[s]], np.ones(int(seen[s].sum()), np.int64))
    got = ngram_lm.Filters(parts, 4).levels(keys)
    assert (got[seen] >= 0).all() and (got[~seen] >= 0).mean() < 0.01
    _, model = ngram_lm.scored(np.array([1, 1]), np.array([2, 2]), np.array([0, -1]), 100, 50, 0.2)
    assert model[0] > model[1]
