"""The pipeline's stages against plain versions of their decisions, each on its own input; toxicity, a trained model, against its operator."""

import re

import corpus_pipeline as c
from krylake.llm import toxicity
from krylake.llm.common import written
from krylake.llm.queries import ORACLES, QUERIES
from tests.conftest import SF


def firsts(texts):
    """The smallest id of each group that links of a five-word similarity of 0.8 or more make, all pairs compared."""
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    group = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    while True:
        after = dict(group)
        for i, j in links:
            after[i] = after[j] = min(after[i], after[j])
        if after == group:
            return set(group.values())
        group = after


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = written(docs.unionByName(docs.limit(1)).unionByName(docs.limit(1).selectExpr("doc_id + 100000 AS doc_id", "cast(null AS string) AS text", "lang", "source", "n_chars")))
    columns, kept = docs.columns, []
    for name, stage in c.STAGES[:-1]:
        out = written(stage(spark, docs, SF))
        assert out.columns == columns
        before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (docs, out))
        if name == "language_id":
            want = {i for i, t in before.items() if re.search(r"[^\W\d_]", t or "")}
        elif name == "toxicity":
            want = {r["doc_id"] for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if not r["predicted"]}
        elif name == "exact_dedup":
            last = {}
            for i in sorted(before):
                last[before[i].encode().lower()] = i
            want = set(last.values())
            assert out.count() == len(want)
        else:
            want = firsts(before)
        assert set(after) == want
        kept.append(len(after))
        docs = out
    assert kept == sorted(kept, reverse=True)
    pieces = c.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == kept[-1]


def test_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
