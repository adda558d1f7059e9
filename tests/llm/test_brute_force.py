"""Operators and pipeline stages against plain Python versions, on small tables; and empty tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from cellstore.llm import bpe, exact_dedup, katz, matroska, mixing, ngram_join, pii, quality, toxicity, url_filters
from cellstore.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOWER))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    """The base rules of personal data, by Python's own engine."""
    out = {k: [] for k in ("email", "ip", "card", "phone")}
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out["email"].append(m)
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out["ip"].append(m)
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[\x20-]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m)
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out["phone"].append(m)
    return {k: [f"{k}:{m.start()}:{m.end()}" for m in v] for k, v in out.items()}


ODD_TEXTS = [
    None,
    "",
    "a@b.c_d@e.f a@b a@@b.c x%y+z@q-r.s.t. @b.c",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3.x 0255.0.0.01 1.2.3.4",
    "4111111111111111 4111-1111-1111-1111 5 4111 1111 1111 1111 4111  1111 41111111111111111111",
    "+1 (017) 555-7713 +12345 +1234567890123456 ++49.30.1234567- +1 2",
    "\U0001f600\U0001f600 a@b.co \U0001f600 10.0.0.1 é@é.é é.a@b.de",
    "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, not DE00 3704 0044 0532 0130 00",
    "9" * 5000 + " " + "a" * 5000 + "@x.y " + "1." * 3000,
]


def test_pii_base_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD_TEXTS)], "doc_id long, text string"))
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    got = pii.find_pii(docs).collect()
    assert len(got) == len(text)
    for r in got:
        want = base_spans(text[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(v) for v in want.values()], r.doc_id
        joined = ",".join(x for v in want.values() for x in v)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), r.doc_id
        assert [s for s in r.spans.split(",") if s and s.split(":")[0] in ("email", "ip", "card", "phone")] == (joined.split(",") if joined else [])
    ibans = next(r.spans for r in got if r.doc_id == 10**6 + 7)
    found = [text[10**6 + 7][int(a) : int(b)] for k, a, b in (s.split(":") for s in ibans.split(",")) if k == "iban"]
    assert found == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]


def discount_factors(counts):
    of = Counter(counts)
    common = 6 * of[6] / of[1] if of[1] else 1.0
    out = {}
    for r in range(1, 6):
        d = ((r + 1) * of[r + 1] / of[r] / r - common) / (1 - common) if of[r] and common < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def test_katz_equals_a_plain_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "Never-seen word never-seen")], "doc_id long, text string"))
    texts = {r.doc_id: [*words(r.text), None] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    one, two = Counter(), defaultdict(Counter)
    for i, ws in texts.items():
        if not held[i]:
            one.update(ws)
            for a, b in zip(["<s>", *[("w", w) for w in ws]], ws, strict=False):
                two[a][b] += 1
    total = sum(one.values())
    f1, f2 = discount_factors(one.values()), discount_factors([c for v in two.values() for c in v.values()])
    single = {w: c * f1.get(c, 1.0) / total for w, c in one.items()}
    unknown = 1 - sum(single.values())

    def spread(h):
        """(probabilities of followers, backoff weight)"""
        followers = two.get(h)
        if not followers:
            return {}, 1.0
        count = sum(followers.values())
        given = sum(c * f2.get(c, 1.0) for c in followers.values())
        below = count if count - given > 1e-9 else count + 1
        return {w: c * f2.get(c, 1.0) / below for w, c in followers.items()}, (1 - given / below) / (1 - sum(single[w] for w in followers))

    model = {h: spread(h) for h in two}
    for h in list(two)[:50]:
        p, weight = model[h]
        assert abs(sum(p.get(w, weight * s) for w, s in single.items()) + weight * unknown - 1) < 1e-9
    got = katz.score_texts(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        ws = texts[r.doc_id]
        score = base = 0.0
        for a, b in zip(["<s>", *[("w", w) for w in ws]], ws, strict=False):
            p, weight = model.get(a, ({}, 1.0))
            score += math.log10(p[b] if b in p else weight * single.get(b, unknown))
            base += math.log10((one[b] + 0.5) / (total + 0.5 * (len(one) + 1)))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(one[w] > 0 for w in ws), total)
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 1e-6, r.doc_id


def area(pairs):
    good = [s for s, y in pairs if y]
    bad = [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def test_toxicity_on_held_out_rows(spark):
    at = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{at}/labels.parquet")
    got = toxicity.score_toxicity(spark.read.parquet(f"{at}/documents.parquet"), labels)
    told = {r.doc_id: r.toxic for r in labels.collect()}
    rows = got.collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert area([(r.score, told[r.doc_id]) for r in rows if r.held_out and r.doc_id in told]) > 0.9


def linked_roots(texts):
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for i, w in ((i, words(t)) for i, t in texts.items())}
    by, root = defaultdict(list), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    for i, s in sets.items():
        for j in {j for x in s for j in by[x] if j < i}:
            if 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def test_ngram_join_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = linked_roots({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_join(docs).collect()} == want


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against a plain version on what the stage before kept."""
    import public_tokenizers
    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*[c.split()[0] for c in DOCS.split(", ")])
    docs = docs.union(spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0)], DOCS))
    quality_of = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, kept = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.collect()
        kept.append((before, after))
        assert k == 4 or docs.columns == columns, name
        assert k == 4 or {tuple(r) for r in after} <= {tuple(r) for r in before}, name

    before, after = kept[0]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone == {r.doc_id for r in quality.score_quality(spark.createDataFrame(before, DOCS)).collect() if not r.keep}
    judged = [i for i in gone if i in quality_of]
    assert sum(quality_of[i] == 0 for i in judged) >= 0.9 * len(judged)

    before, after = kept[1]
    least = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        least.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", r.text or ""), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(least.values())

    before, after = kept[2]
    assert sorted(r.doc_id for r in after) == sorted(i for i, root in linked_roots({r.doc_id: r.text for r in before}).items() if i == root)

    before, after = kept[3]
    keyed = corpus_pipeline._keyed(spark.createDataFrame(before, DOCS))
    taken = {r[corpus_pipeline.KEY].i: (r.taken, r["size"]) for r in mixing.mix_sources(keyed, id_column=corpus_pipeline.KEY).collect()}
    times = Counter(r.doc_id for r in after)
    assert times == {i: max(1, math.floor(t / n + 0.5)) for i, (t, n) in taken.items() if t > 0}
    assert max(times.values()) <= 3

    before, after = kept[4]
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(tokenizer_path()), special_tokens={})
    want = []
    for r in before:
        ids = known.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after) == sorted(want)


EMPTY = {
    "ngram_join": lambda d, _: ngram_join.ngram_join(d),
    "quality": lambda d, _: quality.score_quality(d),
    "exact_dedup": lambda d, _: exact_dedup.exact_dedup(d),
    "pii": lambda d, _: pii.find_pii(d),
    "toxicity": lambda d, labels: toxicity.score_toxicity(d, labels),
    "katz": lambda d, _: katz.score_texts(d),
    "mixing": lambda d, _: mixing.mix_sources(d),
    "bpe": lambda d, _: bpe.round_trip(d, tokenizer_path()),
    "matroska": lambda d, _: matroska.read_back(matroska.store(d)),
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty_and_blank_tables(spark, name):
    """No rows; and rows whose columns are all null, empty or repeated."""
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    nothing = spark.createDataFrame([], DOCS)
    assert EMPTY[name](nothing, labels).count() == 0
    blank = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "s", 0), (1, "", None, "s", 0), (2, None, "en", None, None)], DOCS)
    assert len(EMPTY[name](blank, labels).collect()) == 4


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_empty_tables(spark, k):
    assert corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame([], DOCS), SF).count() == 0


def test_url_rules_on_blank_rows(spark):
    rules = spark.createDataFrame(url_filters.RULES, "host string, path string, action string")
    pages = spark.createDataFrame([(None, None), (1, ""), (1, "")], "page_id long, url string")
    assert [(r.host, r.path, r.rule) for r in url_filters.url_filter(pages, rules).collect()] == [("", "", None)] * 3
