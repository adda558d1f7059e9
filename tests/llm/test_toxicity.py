"""Trained dictionaries: held-out accuracy at two sizes, marks, and what a score may depend on."""

from __future__ import annotations

import zlib

import pytest

from cellstore.llm import toxicity


def area(pairs):
    good = [s for s, y in pairs if y]
    bad = [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize("sf, least", [("sf0.01", 0.85), ("sf0.1", 0.92)])
def test_held_out_area(spark, sf, least):
    at = f"/root/testdata/{sf}"
    labels = spark.read.parquet(f"{at}/labels.parquet")
    told = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.score_toxicity(spark.read.parquet(f"{at}/documents.parquet"), labels).collect()
    held = [(r.score, told[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in told]
    got = area([(s, y) for s, y, _ in held])
    print(sf, got, sum(p for _, y, p in held if y) / sum(y for _, y, _ in held), sum(1 - p for _, y, p in held if not y) / sum(1 - y for _, y, _ in held))
    assert got > least
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def test_dictionaries_are_trained(spark):
    texts = [(f"plain words {i} and others {i * 7} of that kind {i % 13}", 0) for i in range(400)] + [(f"some {i} dreadful{i % 3} words {i * 3}", 1) for i in range(200)]
    labelled = spark.createDataFrame(texts, "text string, toxic int")
    tables = toxicity.Tables(spark, "test")
    short, _ = toxicity.find_marks(labelled, tables)
    assert set(short) <= {"drea", "some"} and "drea" in short
    assert toxicity.passage("Some Dreadful1 words, dreadful1!", {"drea": 200}, {"dread": 200, "dreadf": 200, "dreadfu": 200, "dreadful": 200}) == b" dreadful dreadful "
    plain, toxic = toxicity.dictionaries(labelled, toxicity.Tables(spark, "test"))
    assert len(plain) == len(toxic) and b"dreadful" in toxic and b"dreadful" not in plain
    d = toxicity.distances("a dreadful thing of that kind and others", *map(toxicity.compressor, (plain, toxic)))
    assert d[0] > 0


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = [(i, ("awfulness " if i % 5 == 0 else "ordinary ") + f"text {i % 11} again") for i in range(300)]
    docs = spark.createDataFrame([*rows, (None, "ordinary"), (7, "ordinary text repeated under an id")], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    score = lambda flip: sorted(((r.doc_id, r.score) for r in toxicity.score_toxicity(docs, spark.createDataFrame([(i, int((i % 5 == 0) != (flip and held(i)))) for i, _ in rows], "doc_id long, toxic int")).collect()), key=str)
    assert score(False) == score(True) and len(score(False)) == 302


def test_one_label_only(spark):
    docs = spark.createDataFrame([(0, "x y"), (2, None)], "doc_id long, text string")
    assert {r.score for r in toxicity.score_toxicity(docs, spark.createDataFrame([(0, 1)], "doc_id long, toxic int")).collect()} == {1.0}
