"""What op1 shuffles: hashes as compressed gaps, counts in as few bytes as they need; nothing is lost by it."""

import numpy as np

from krylake.llm import ngram_lm as lm


def test_blocks_take_less_than_the_hashes():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 40_000, dtype=np.uint64) << np.uint64(1))
    counts = np.where(rng.random(len(keys)) < 0.1, rng.integers(2, 300, len(keys)), 1)
    for b, s in lm.blocks(keys, 3):
        short, more = lm.squeezed(keys[s], counts[s], 2, 3)
        assert len(short) + len(more) < 3.3 * len(keys[s])  # 4 bytes a hash and 8 a count over one before
        got = np.cumsum(lm.wide(short, "<u4"), dtype=np.uint64)
        assert (got == lm.below(keys[s], 3)).all()
        at, n = lm.wide(more, "<u4").reshape(2, -1)
        assert (np.cumsum(at) == np.flatnonzero(counts[s] > 1)).all() and (n == counts[s][counts[s] > 1]).all()
        words, c = lm.squeezed(keys[s], counts[s], 1, 3)
        assert (np.cumsum(lm.wide(words, "<u8"), dtype=np.uint64) == keys[s]).all() and (lm.counts_in(c) == counts[s]).all()


def test_counts_of_any_width():
    for most in (0, 1, 255, 256, (1 << 32) - 1, 1 << 32, 1 << 60):
        assert lm.counts_in(lm.counts_out(np.array([0, most], np.int64))).tolist() == [0, most]
    assert lm.counts_in(lm.counts_out(np.zeros(0, np.int64))).tolist() == []
