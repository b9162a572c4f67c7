"""The audit of op8's beams over many shards: links other than with oneself, all shards of a label together."""

import numpy as np
from pyspark.sql import functions as F

from krylake.llm import embedding_dedup as e


def test_audit_sees_links_beyond_its_first_queries(spark, monkeypatch):
    """600 vectors in 20 shards, four linked pairs: the first queries see hardly any link, so all are drawn in the end."""
    monkeypatch.setattr(e, "AUDITED", 4)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 8))
    v[10:14] = v[:4] + 1e-3
    d = spark.createDataFrame([(i, x.tobytes(), 0, 64, i % 20, 20, 1) for i, x in enumerate(v)], "rep long, vec binary, label long, dim int, shard int, shards int, mult long").cache()
    built = e.written(e.graphs(d.select("label", "dim", "shard", "rep", "mult", "vec")))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = int((u @ u.T >= e.COSINE).sum()) - len(v)
    got = e.audit(d.withColumn("block", F.lit(0)), built).collect()
    assert [(r["truth"], r["recall"] >= e.RECALL) for r in got] == [(links, True)] and links >= 8
