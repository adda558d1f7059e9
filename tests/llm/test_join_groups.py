"""Links between members of one group, none of which is its least member, in the n-gram join."""

from __future__ import annotations

import numpy as np
import pytest

from cellstore.llm import ngram_join
from cellstore.llm.base import utf8


def shingles(text):
    import pyarrow as pa

    return next(iter(ngram_join.shingles(*utf8(pa.array([text])), 5)))


def row(name, k):
    return [f"{name}{i}" for i in range(k)]


def triple(n, common, shift=1):
    """Three texts of n words: the least shares only the first words with the others, which differ in the last."""
    a = row("a", n)
    return {1: [*a[:common], *row("b", n - common)], 2: a, 3: [*a[:-shift], *row("c", shift)]}


@pytest.mark.parametrize("case", ["no other group", "late shingles in another group"])
def test_members_of_one_group_link(spark, monkeypatch, case):
    if case == "no other group":
        texts, first, late = triple(11, 6), 2, []  # 7 shingles, a prefix of 2
    else:
        texts, first, late = triple(24, 10), 6, [5]  # 20 shingles, a prefix of 6; the last of these is in another text
        texts[4] = [*row("a", 24)[5:10], *row("d", 19)]
    texts = {i: " ".join(w) for i, w in texts.items()}
    # the order is forced: the first shingles of the triple come first, by place
    a = texts[2].split()
    counts = np.full(1 << ngram_join.SKETCH_BITS, 99, np.uint32)
    for k in range(first):
        counts[int(shingles(" ".join(a[k : k + 5]))[0]) & ((1 << ngram_join.SKETCH_BITS) - 1)] = k
    monkeypatch.setattr(ngram_join, "count_sketch", lambda docs, n: (counts, len(texts)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs).collect()}
    sets = {i: set(shingles(t).tolist()) for i, t in texts.items()}
    linked = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert linked == {(2, 3)}
    assert got == {i: 2 if i == 3 else i for i in texts}
