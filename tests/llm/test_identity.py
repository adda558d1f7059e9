"""Words and pieces are told apart whatever they hold: the Thue-Morse word and its complement agree under any polynomial hash modulo 2^64."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from cellstore.llm import bpe, katz, ngram_join
from cellstore.llm.base import Spans, utf8, words
from cellstore.llm.queries import tokenizer_path


def pair(n):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 65536])
def test_words(n):
    h, _, _ = words(*utf8(pa.array(pair(n))))
    assert len(h) == 2 and h[0] != h[1]


def test_spans_equal_brute_force():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    starts = rng.integers(0, 4900, 2000)
    ends = starts + rng.integers(1, 80, 2000)
    spans = Spans(data, starts, ends)
    names = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    h = spans.hashes().tolist()
    assert len(set(zip(names, h, strict=True))) == len(set(names)) == len(set(h))
    one, which = bpe.distinct_pieces(spans)
    assert [names[one[w]] for w in which] == names


def test_pieces_with_one_hash_for_all(monkeypatch):
    monkeypatch.setattr(Spans, "hashes", lambda self: np.zeros(len(self.sizes), np.uint64))
    known = bpe.merger(tokenizer_path())
    texts = ["alphabetical beginnings alphabetical", "x" * 40 + " " + "y" * 40, ""]
    got = bpe.encode_texts(texts, known)[0].tolist()
    monkeypatch.undo()
    assert got == bpe.encode_texts(texts, known)[0].tolist()


@pytest.mark.parametrize("n", [1024, 2048, 65536])
def test_operators(spark, n):
    import public_tokenizers
    import tiktoken

    a, b = pair(n)
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string").coalesce(1)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(tokenizer_path()), special_tokens={})
    ids = {r.doc_id: r.ids for r in bpe.encode(docs, tokenizer_path()).collect()}
    assert ids == {1: known.encode_ordinary(a), 2: known.encode_ordinary(b), 3: known.encode_ordinary(a)}
    if n == 1024:
        assert {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs).collect()} == {1: 1, 2: 2, 3: 1}
        own = [i for i in range(100) if __import__("zlib").crc32(str(i).encode()) % 5 == 1][0]
        got = {r.doc_id: r.n_known for r in katz.score_texts(spark.createDataFrame([(0, a), (own, b)], "doc_id long, text string")).collect()}
        assert got == {0: 2, own: 1}


def test_round_trip_of_a_column_named_ids(spark):
    docs = spark.createDataFrame([(7, "some text")], "ids long, text string")
    assert bpe.round_trip(docs, tokenizer_path(), "ids").first().ids == 7
