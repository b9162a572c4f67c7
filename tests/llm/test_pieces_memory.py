"""op6 cuts texts into runs a part of a chunk at a time; what it finds doesn't depend on the parts."""

import public_tokenizers

from krylake.llm import pieces


def test_texts_come_a_part_at_a_time():
    texts = ["a" * 400, None, "b" * 700, "", "c" * 5000, "d"]
    assert list(pieces.few(texts, 1000)) == [["a" * 400, None, "b" * 700], ["", "c" * 5000], ["d"]]
    assert list(pieces.few([], 1000)) == []


def test_texts_in_parts_of_chunks(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(i, [None, "", " ", "the cat sat on the mat " * (i % 7), f"Émile {i} 漢字 " * 30, "x" * 300][i % 6]) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).sortWithinPartitions("doc_id")
    sp = pieces.processor(path)
    got = {r["doc_id"]: r["ids"] for r in pieces.encode(docs, path).collect()}
    assert got == {i: sp.encode(t or "") for i, t in rows}
