"""The quality classifier against a plain version: votes, posteriors of the estimation, and the scorer on hashed byte pairs and triples."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

from cellstore.llm import quality

SF = "/root/testdata/sf0.001"
LETTERS = {*range(65, 91), *range(97, 123), *range(128, 256)}
SPACES = {32, 9, 10, 11, 12, 13}
ODD = set(range(256)) - LETTERS - SPACES - set(range(48, 58)) - set(b".,;:'\"?-()")


def plain_votes(text):
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", data)
    if not words:
        return "2" * 8
    n, lower = len(words), [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    ends = sum(w[-1] in ODD for w in words)
    alone = sum(data[i] in ODD and data[i - 1] in SPACES and data[i + 1] in SPACES for i in range(1, len(data) - 1))
    upper = sum(65 <= c <= 90 for c in data)
    ascii_letters = upper + sum(97 <= c <= 122 for c in data)
    same = sum(a == b for a, b in zip(lower, lower[1:], strict=False))
    lines = [x for x in data.split(b"\n") if len(x) > 10]
    body, letters = max(1, sum(c not in SPACES for c in data)), sum(c in LETTERS for c in data)
    marks = sum(c in b".?!" for c in data)
    pairs = len(set(zip(lower, lower[1:], strict=False))) / max(1, n - 1)
    rules = [
        (ends > 0.2 * n, ends <= 0.03 * n),
        (ascii_letters >= 20 and upper > 0.4 * ascii_letters, upper <= 0.15 * max(1, ascii_letters)),
        (n >= 8 and alone > 0.15 * n, alone <= 0.02 * n),
        (n >= 8 and same > 0.2 * n, n >= 8 and same <= 0.02 * n),
        (len(lines) >= 4 and len(set(lines)) < 0.5 * len(lines), False),
        (letters < 0.75 * body, letters >= 0.9 * body),
        (n >= 8 and marks == 0, marks * 60 >= n),
        (n >= 8 and pairs < 0.5, n >= 8 and pairs > 0.8),
    ]
    return "".join("0" if junk else "1" if clean else "2" for junk, clean in rules)


def plain_em(votes):
    """votes: of all documents. Posterior of clean by pattern."""
    count = Counter(votes)
    post = {p: 0.1 if "0" in p else 0.95 if "1" in p else 0.9 for p in count}
    for _ in range(200):
        weight = {p: (count[p] * (1 - post[p]), count[p] * post[p]) for p in count}
        rate = {}
        for k in range(8):
            for c in (0, 1):
                given = [1 + sum(w[c] for p, w in weight.items() if p[k] == v) for v in "01"]
                rate[k, c] = [x / sum(given) for x in given]
        clean, junk = sum(w[1] for w in weight.values()), sum(w[0] for w in weight.values())
        share = (clean + 9) / (clean + junk + 10)
        new = {}
        for p in count:
            logs = [math.log(s) + sum(math.log(rate[k, c][int(v)]) for k, v in enumerate(p) if v != "2") for c, s in ((0, 1 - share), (1, share))]
            new[p] = 1 / (1 + math.exp(max(-500, min(500, logs[0] - logs[1]))))
        moved = max(abs(new[p] - post[p]) for p in new)
        post = new
        if moved < 1e-9:
            break
    return post


def plain_features(text):
    data, out, m = (text or "").encode(), [0.0] * quality.DIMENSIONS, 1 << 32
    pairs = [(a * 2654435761 + b * 40503) % m >> 7 for a, b in zip(data, data[1:], strict=False)]
    for x in pairs:
        out[x % quality.DIMENSIONS] += 1
    for x, c in zip(pairs, data[2:], strict=False):
        out[((x * 31 + c * 2246822519) % m >> 9) % quality.DIMENSIONS] += 1
    out = [math.sqrt(x) for x in out]
    size = math.sqrt(sum(x * x for x in out))
    return np.array([x / size for x in out] if size else out)


def test_against_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(10**6 + i, t) for i, t in enumerate([None, "", " \n ", "short", "### $$$ %%% ^^^ ### $$$ %%% ^^^ @@@ ###", "BUY NOW " * 2000, "na na na na na na na na na na", "line of text here\n" * 9])]
    rows += [rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    votes = [plain_votes(t) for _, t in rows]
    post = plain_em(votes)
    text = dict(rows)
    got = quality.score_quality(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.votes == plain_votes(text[r.doc_id]), r
        assert abs(r.posterior - post[r.votes]) < 1e-6, r
    # all documents on either side are in the sample, as there are under 2000; ids count once
    sample = sorted(i for i, t in text.items() if post[plain_votes(t)] > 0.9 or post[plain_votes(t)] < 0.1)
    told = np.array([post[plain_votes(text[i])] for i in sample])
    w, bias = quality.fit_linear(np.array([plain_features(text[i]) for i in sample]), told)
    for r in got:
        if not re.search(r"[^\x20\x09-\x0d]", text[r.doc_id] or ""):
            assert r.score == 1.0 and r.keep
            continue
        p = post[r.votes]
        odds = math.log(max(p, 1e-6) / max(1 - p, 1e-6))
        want = 1 / (1 + math.exp(-(float(plain_features(text[r.doc_id]) @ w) + bias + odds) / 2))
        assert abs(r.score - want) < 5e-3 and r.keep == (r.score >= 0.5), (r, want)


def test_scorer_finds_the_side():
    """On two clouds that a plane parts, the fit gives nearly all the right side."""
    r = np.random.default_rng(3)
    side = r.integers(0, 2, 600)
    x = r.normal(size=(600, 20)) / 5
    x[:, 3] += side - 0.5
    w, bias = quality.fit_linear(x, side.astype(float))
    assert np.argmax(np.abs(w)) == 3 and np.mean((x @ w + bias > 0) == (side == 1)) > 0.97
