"""The pipeline's stages on planted rows."""

import zlib

import numpy as np
import pytest

import corpus_pipeline as c
from krylake.llm import sharding, similarity
from krylake.llm.common import written

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def five(t):
    w = t.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def planted():
    """Texts with copies of 0.7 to 0.97, and the groups that similarities of 0.8 make."""
    rng, texts = np.random.default_rng(8), []
    vocabulary = [f"w{i}" for i in range(3000)]
    for k in range(60):
        base = rng.choice(vocabulary, int(rng.integers(40, 400))).tolist()
        texts.append(" ".join(base))
        for share in rng.choice([0.003, 0.01, 0.02, 0.03], 2):
            other = [x if rng.random() > share else "edit" + str(rng.integers(10**9)) for x in base]
            texts.append(" ".join(other))
    base = rng.choice(vocabulary, 120).tolist()  # one large group, and a passage that unlike texts share
    for i in range(90):
        own = base.copy()
        own[int(rng.integers(120))] = f"new{i}"
        texts.append(" ".join(own))
        texts.append(" ".join([*base[:30], *rng.choice(vocabulary, 60)]))
    texts += ["one two three", "One  two three", "one two four"]
    sets = [five(t) for t in texts]
    like = np.array([[len(a & b) / len(a | b) for b in sets] for a in sets])
    group = np.arange(len(texts))
    for _ in texts:
        after = np.array([group[row >= 0.8].min() for row in like])
        if (after == group).all():
            break
        group = after
    return texts, like, group


@pytest.mark.parametrize("small", [4, 64])
def test_near_stage_finds_every_copy(spark, small):
    texts, like, group = planted()
    upper = like[np.triu_indices(len(texts), 1)]
    assert ((upper >= 0.8) & (upper < 0.95)).sum() > 30
    docs = written(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DDL).repartition(3))
    kept = {r["doc_id"] for r in c.near_stage(spark, docs, "").collect()}
    assert kept == set(group.tolist())
    rows = written(docs.selectExpr("doc_id AS row", "text"))
    got = {r["node"]: r["component"] for r in similarity.near_copies(rows, small=small).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == group.tolist()
    alike = spark.range(1, len(texts)).selectExpr("0L AS a", "id AS b")  # pairs held for similar elsewhere: true ones and false ones
    got = {r["node"]: r["component"] for r in similarity.near_copies(rows, small=small, alike=alike).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == group.tolist()
    assert c.near_stage(spark, written(docs.limit(0)), "").count() == 0


def test_null_and_repeated_ids_lose_no_text(spark):
    rows = [(None, f"text number {i}") for i in range(6)] + [(5, "some words"), (5, "other words"), (7, "Some words"), (None, "text NUMBER 0"), (8, "12 34"), (9, None)]
    docs = written(spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], DDL))
    lettered = written(c.language_stage(spark, docs, ""))
    assert sorted(r["text"] for r in lettered.collect()) == sorted(t for _, t in rows if t and t != "12 34")
    got = sorted((r["text"].lower(), r["doc_id"] or 0) for r in c.exact_stage(spark, lettered, "").collect())
    assert got == sorted([(f"text number {i}", 0) for i in range(6)] + [("some words", 7), ("other words", 5)])


@pytest.mark.parametrize("nulls", [1, 2])
def test_sharding_keeps_rows_without_id(spark, nulls):
    rows = [(None if i < nulls else i, f"t{i}") for i in range(30)]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 30 and sum(r["doc_id"] is None for r in got) == nulls
    assert {r["text_crc32"] for r in got} == {zlib.crc32(t.encode()) for _, t in rows}


def test_stages_keep_columns_with_clashing_names(spark, tmp_path):
    """Every column comes out as it went in, whatever a stage calls its own; null and repeated ids, repeated rows, no rows."""
    ddl = DDL + ", row string, _score string, _held_out string, _predicted string, _lang_pred string, _letters string, member string, key string, in0 string, `a.b` string"
    words = ["the old house by the river has a red door", "la vieille maison au bord du fleuve est belle", "plain words of a document that says nothing else here"]
    rows = [(k if k % 4 else None, words[k % 3] + f" number {k // 2}", ["en", "fr", None][k % 3], "s", 3, *[f"{c}{k}" for c in "abcdefghij"]) for k in range(40)]
    rows += [(7, words[0] + " number 1", "en", "s", 3, *"ABCDEFGHIJ")] * 2
    d = spark.createDataFrame(rows, ddl)
    spark.createDataFrame([(k, 0) for k in range(1, 30, 3)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns, name
        kept = {tuple(r) for r in out.collect()}
        assert kept and kept <= {tuple(r) for r in d.collect()}, name
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0, name
    assert c.packing_stage(spark, d, str(tmp_path)).count() >= len(rows)


def test_learning_takes_a_bounded_sample(spark):
    """One id very often, with one text and with many: what comes to the driver stays small, and the other rows are still learned from."""
    from pyspark.sql import functions as F

    from krylake.llm import langid

    many = spark.range(200_000).select(F.lit(1).cast("long").alias("doc_id"), F.when(F.col("id") < 100_000, F.lit("same text")).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"), F.lit("en").alias("lang"))
    few = spark.range(300).select((F.col("id") * 4 + 5).alias("doc_id"), F.concat(F.lit("texte "), F.col("id")).alias("text"), F.lit("fr").alias("lang"))
    got = langid.sampled(many.unionByName(few), "lang", 100)
    assert sum(r["lang"] == "en" for r in got) == 100 and sum(r["lang"] == "fr" for r in got) == 100
    assert len(langid.sampled(many.filter("text = 'same text'"), "lang", 100)) == 1
