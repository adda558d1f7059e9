"""The join and the mix against their SQL, on a given table and on small odd ones."""

from __future__ import annotations

import random

import duckdb
import pytest

from cellstore.llm import mixing, ngram_join

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string"


def equal(got, docs, sql):
    c = duckdb.connect()
    c.register("documents", docs.toArrow())
    want = c.sql(sql)
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def texts():
    """Blank texts, texts of under five words, copies, and texts on either side of the limit."""
    r = random.Random(5)
    long = [f"w{r.randrange(400)}" for _ in range(300)]
    out = [None, "", " \t\n", "one", "One", "one two three four", "a b c d e", "a b c d e f", " ".join(long), " ".join(long).upper(), "a a a a a a a a a"]
    for k in range(40):
        changed = list(long)
        for i in r.sample(range(300), k % 14):
            changed[i] = f"x{k}-{i}"
        out.append(" ".join(changed))
    return out


def test_join_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    equal(ngram_join.ngram_join(docs), docs, ngram_join.ORACLE)


def test_join_on_odd_texts(spark):
    docs = spark.createDataFrame([(i * 7 % 101, t, "s") for i, t in enumerate(texts())], SCHEMA)
    got = ngram_join.ngram_join(docs)
    equal(got, docs, ngram_join.ORACLE)
    assert len({r.component_id for r in got.collect()}) > 8


@pytest.mark.parametrize("case", ["documents", "tiny sources", "one source", "null ids and repeated rows", "no words"])
def test_mix(spark, case):
    if case == "documents":
        docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    elif case == "no words":
        docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], SCHEMA)
    else:
        rows = {
            "tiny sources": [(i - 20, "w " * (i % 9), "abcdef"[i % 6]) for i in range(60)] + [(100, "one", "tiny"), (101, None, "none"), (102, "x y", None)],
            "one source": [(i, "w " * (i % 5), None) for i in range(30)],
            "null ids and repeated rows": [(None, "a b c", "s"), (3, "d e", "s"), (3, "d e", "s"), (4, "f " * 50, "é"), (4, "f " * 50, "é")],
        }[case]
        docs = spark.createDataFrame(rows, SCHEMA)
    equal(mixing.mix_sources(docs), docs, mixing.ORACLE)
