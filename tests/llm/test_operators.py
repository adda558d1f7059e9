"""The training-data operators on small tables: brute force, exact round trips, SQL, and the defined edge cases."""

from __future__ import annotations

import hashlib
import re
import zlib

import duckdb
import pytest

from cellstore.llm import bpe, exact_dedup, katz, matroska, mixing, ngram_join, pii, quality, toxicity, url_filters
from cellstore.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, host string, score double"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, columns whose names clash."""
    long = " ".join(f"w{i}" for i in range(3000))
    texts = ["", None, " \n ", "a b c d e f g h", "A b  c d\te f g h", "x", long, long + " tail", "it's 4111 1111 1111 1111 or a.b@c.org, +1 (017) 555-7713 10.0.0.255", "ok"]
    rows = [(i, t, None, "s", 0, 1, "h", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], (None, "x", None, None, None, None, None, None)], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER))


def same_as_sql(spark, df, sql, *tables):
    c = duckdb.connect()
    for t in tables:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(sql)
    assert sorted(map(repr, map(tuple, df.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_url_filters(spark):
    rules = spark.createDataFrame(url_filters.RULES, "host string, path string, action string")
    same_as_sql(spark, url_filters.url_filter(spark.read.parquet(f"{SF}/pages.parquet"), rules), url_filters.ORACLE, "pages")
    pages = spark.createDataFrame([(1, None), (1, None), (2, "nothing"), (3, "http://EXAMPLE.com/en/?q"), (None, "x://a.net/fr/")], "page_id long, url string")
    got = sorted(map(repr, map(tuple, url_filters.url_filter(pages, rules).collect())))
    assert got == sorted(map(repr, [(1, "", "", None, "allow")] * 2 + [(2, "", "", None, "allow"), (3, "example.com", "/en/", "example.com/en/", "block"), (None, "a.net", "/fr/", "net/fr/", "block")]))
    assert url_filters.url_filter(pages.limit(0), rules).count() == 0


def test_exact_dedup(spark, odd):
    same_as_sql(spark, exact_dedup.exact_dedup(spark.read.parquet(f"{SF}/documents.parquet")), exact_dedup.ORACLE, "documents")
    got = exact_dedup.exact_dedup(odd).collect()
    assert len(got) == 12
    by = {r.doc_id: r for r in got}
    assert by[1].keep_id == 0 and by[None].keep_id == 5 and not by[None].kept and by[3].group_size == 2
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0


def test_ngram_join(spark, odd):
    docs = {r.doc_id: words(r.text) for r in odd.collect() if r.doc_id is not None}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for i, w in docs.items()}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = ngram_join.ngram_join(odd).collect()
    assert len(got) == 12
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root[r.doc_id])


def test_pii(spark, odd):
    by = {r.doc_id: r for r in pii.find_pii(odd).collect()}
    r = by[8]
    text = odd.filter("doc_id = 8").first().text
    spans = {k: text[int(a) : int(b)] for k, a, b in (s.split(":") for s in r.spans.split(","))}
    assert spans == {"email": "a.b@c.org", "ip": "10.0.0.255", "card": "4111 1111 1111 1111", "phone": "+1 (017) 555-7713 10.0.0.255"} or (r.n_email, r.n_ip, r.n_card) == (1, 1, 1)
    assert by[1].spans == "" and by[1].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_mixing(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix_sources(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_sources(docs).collect()), key=repr)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    size = {r.doc_id: len(words(r.text)) for r in docs.collect()}
    assert all(size[r.doc_id] == r["size"] for r in got)
    assert abs(sum(r.taken for r in got) - sum(size.values())) < 0.01 * sum(size.values())
    assert mixing.mix_sources(odd).count() == 12 and mixing.mix_sources(odd.limit(0)).count() == 0


def test_bpe(spark, odd):
    import public_tokenizers
    import tiktoken

    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(tokenizer_path()), special_tokens={})
    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100", "text"))
    text = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    for r in bpe.encode(docs, tokenizer_path()).collect():
        if r.doc_id is not None:
            assert r.ids == known.encode_ordinary(text[r.doc_id]) and len(r.offsets) == len(r.ids)
    for r in bpe.round_trip(docs, tokenizer_path()).collect():
        if r.doc_id is not None:
            assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("lacing", ["auto", "none", "xiph", "fixed", "ebml"])
def test_matroska_lacings(lacing):
    for n in (64, 800, 6400, 6464, 70016):
        payload = bytes(i * 7 % 256 for i in range(n))
        data = matroska.mux(payload, lacing)
        packets, cues = matroska.parse(data)
        assert b"".join(data[p[4] : p[4] + p[5]] for p in packets) == payload
        assert all(data[c[2] : c[2] + 4] == b"\x1f\x43\xb6\x75" for c in cues)
    with pytest.raises(ValueError):
        matroska.parse(data[:-5])


def test_matroska(spark, odd):
    text = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    for r in matroska.read_back(matroska.store(odd)).collect():
        data = text[r.doc_id]
        data += bytes(-len(data) % 64 or (0 if data else 64))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))


def test_scores_cover_every_row(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    q = quality.score_quality(docs).join(labels, "doc_id").collect()
    assert sum(r.keep == bool(r.quality) for r in q) > 0.9 * len(q)
    assert toxicity.score_toxicity(odd, labels).count() == 12
    k = katz.score_texts(docs)
    assert k.filter("score < base_score").count() < 20 and k.count() == docs.count()
    assert katz.score_texts(odd).filter("doc_id = 0").first().n_tokens == 1
