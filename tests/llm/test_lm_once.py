"""op1 sends each hash to its bucket once, to be counted and asked about; no filter passes through the driver."""

import numpy as np
import pyarrow as pa

from krylake.llm import ngram_lm as lm


def test_a_bucket_counts_and_answers_the_same_blocks(monkeypatch):
    rng, bits = np.random.default_rng(2), 2
    monkeypatch.setattr(lm, "PROBED", 500)
    for kind in (1, 2):
        every = np.unique(rng.integers(0, 1 << 62, 3000, dtype=np.uint64) & ~np.uint64((1 << 30) - 1))
        chunks = [np.sort(rng.choice(every, 700, replace=False)) for _ in range(5)]
        counts = [rng.choice([0, 0, 1, 1, 1, 2, 300], len(c)) for c in chunks]  # 0: in held-out texts alone
        rows = [(i, kind, 0, *lm.squeezed(c, n, kind, bits)) for i, (c, n) in enumerate(zip(chunks, counts, strict=True))]
        for (_, _, _, k, n), c, want in zip(rows, chunks, counts, strict=True):
            got = lm.loosed(kind, k, n)
            assert (got[0] == (c if kind == 1 else lm.below(c, bits))).all() and (got[1] == want).all()
        told = lm.answered(pa.Table.from_batches([lm.batch(lm.ASKED, *zip(*rows, strict=True))])).to_pylist()
        total = {k: sum(int(n[c == k].sum()) for c, n in zip(chunks, counts, strict=True)) for k in every.tolist()}
        assert (told[-1]["kinds"], told[-1]["total"]) == (sum(v > 0 for v in total.values()), sum(total.values()))
        for r, c in zip(told, chunks, strict=False):
            want = np.array([total[k] for k in c.tolist()])
            got = lm.counts_in(r["got"])
            if kind == 1:
                assert (got == want).all()
            else:  # levels + 1; the filter errs upwards, rarely
                level = np.where(want > 0, np.floor(np.log2(np.maximum(want, 1))) + 1, 0)
                assert (got >= level).all() and (got == level).mean() > 0.99


def test_no_filter_passes_through_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b w{i % 7} c d{i}") for i in range(300)], "doc_id long, text string").repartition(3).sortWithinPartitions("doc_id")
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *a: (_ for _ in ()).throw(AssertionError("broadcast")))
    assert lm.score_texts(docs).filter("score < 0").count() == 300
