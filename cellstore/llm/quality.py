"""Quality: overlapping heuristic labellers, EM for their accuracies, and a hashed linear scorer.

1. Labellers look at a whole text and vote junk (0), clean (1) or abstain (2): symbols at word ends, capitals, separators,
   repeated words, repeated lines, share of letters, sentence marks, distinct word pairs.
2. Votes are counted by pattern: at most 3^8 patterns, so what reaches the driver is bounded whatever the corpus. EM
   (two classes, each labeller with its own rates of either vote in either class; an abstention is no evidence) estimates accuracies from
   counts of all documents and gives each pattern its posterior.
3. The posterior labels train a linear scorer on hashed byte pairs and triples of whole texts (2^12 counts, square root, unit
   length), by logistic regression. It is fitted on a bounded sample: of each side, the `sample` documents with the least hash of the
   id; `sample` is the documented bound (2000). Everything else covers all documents.
4. A document's score is the mean of the scorer's probability and the posterior of its pattern in log odds; below `threshold` it is
   rejected.

Defined cases: a null or empty text has no votes but abstentions and scores by the prior alone; it is kept, as nothing speaks
against it. Repeated rows are scored alike; of rows that repeat an id with another text, one is in the sample. A row with a null id is scored, and counted
in the estimation, but never in the sample. If all documents look alike to EM (no labeller ever votes), all are kept.
An empty table gives an empty result; further columns are ignored. No label column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .base import Tables, pieces, utf8, with_column_free, words

LABELLERS = ("symbol_ends", "capitals", "separators", "repeated_words", "repeated_lines", "letters", "sentences", "distinct_pairs")
DIMENSIONS = 1 << 12
JUNK, CLEAN, ABSTAIN = 0, 1, 2

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_LETTER = _UPPER | _LOWER | (_BYTES >= 128)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = np.isin(_BYTES, [32, 9, 10, 11, 12, 13])
_MARK = np.isin(_BYTES, [ord(c) for c in ".,;:'\"?-()"])
_ODD = ~(_LETTER | _DIGIT | _SPACE | _MARK)


def votes(text: np.ndarray, hashes: np.ndarray) -> list[int]:
    """Of one text (bytes) with the hashes of its words."""
    n, w = len(text), len(hashes)
    if not w:
        return [ABSTAIN] * len(LABELLERS)
    counts = np.bincount(text, minlength=256)
    letters, upper, odd = counts[_LETTER].sum(), counts[_UPPER].sum(), counts[_ODD].sum()
    ascii_letters = upper + counts[_LOWER].sum()
    space = _SPACE[text]
    last = ~space
    last[:-1] &= space[1:]
    ends = int(np.count_nonzero(_ODD[text[last]]))
    single = int(np.count_nonzero(_ODD[text[1:-1]] & space[:-2] & space[2:])) if n > 2 else 0
    same = int(np.count_nonzero(hashes[1:] == hashes[:-1]))
    lines = text.tobytes().split(b"\n")
    long_lines = [x for x in lines if len(x) > 10]
    marks = int(counts[ord(".")] + counts[ord("?")] + counts[ord("!")])
    distinct = len(np.unique(hashes[1:] * np.uint64(0x9E3779B97F4A7C15) + hashes[:-1])) / max(1, w - 1)  # word pairs
    body = max(1, int(n - counts[_SPACE].sum()))

    def vote(junk: bool, clean: bool) -> int:
        return JUNK if junk else CLEAN if clean else ABSTAIN

    many = w >= 8
    return [
        vote(ends > 0.2 * w, ends <= 0.03 * w),
        vote(ascii_letters >= 20 and upper > 0.4 * ascii_letters, upper <= 0.15 * max(1, ascii_letters)),
        vote(many and single > 0.15 * w, single <= 0.02 * w),
        vote(many and same > 0.2 * w, many and same <= 0.02 * w),
        vote(len(long_lines) >= 4 and len(set(long_lines)) < 0.5 * len(long_lines), False),
        vote(letters < 0.75 * body, letters >= 0.9 * body),
        vote(many and marks == 0, marks * 60 >= w),
        vote(many and distinct < 0.5, many and distinct > 0.8),
    ]


def hashed(text: np.ndarray) -> np.ndarray:
    """Square roots of counts of hashed byte pairs and triples, of unit length."""
    out = np.zeros(DIMENSIONS)
    if len(text) > 1:
        t = text.astype(np.uint32)
        pair = (t[:-1] * np.uint32(2654435761) + t[1:] * np.uint32(40503)) >> np.uint32(7)
        out += np.bincount(pair & np.uint32(DIMENSIONS - 1), minlength=DIMENSIONS)
        if len(text) > 2:
            triple = (pair[:-1] * np.uint32(31) + t[2:] * np.uint32(2246822519)) >> np.uint32(9)
            out += np.bincount(triple & np.uint32(DIMENSIONS - 1), minlength=DIMENSIONS)
    out = np.sqrt(out)
    size = np.sqrt(out @ out)
    return out / size if size else out


def _vote_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = utf8(batch.column("text"))
            h, _, first = words(data, offsets)
            out = []
            for a, b, x, y in zip(offsets.tolist(), offsets[1:].tolist(), first.tolist(), first[1:].tolist(), strict=False):
                out.append("".join(map(str, votes(data[a:b], h[x:y]))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], ["id", "votes"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, votes string")


def em(patterns: list[str], counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of clean for each pattern, rates[labeller, class, vote], share of clean), from counts of all documents.

    The classes start from majority votes. Rates are smoothed by one vote of each kind.
    """
    v = np.array([[int(c) for c in p] for p in patterns], np.int64).reshape(len(patterns), len(LABELLERS))
    junk, clean = (v == JUNK).sum(1), (v == CLEAN).sum(1)
    post = np.where(junk > 0, 0.1, np.where(clean > 0, 0.95, 0.9))
    one = np.eye(3)[v]  # pattern, labeller, vote
    one[:, :, ABSTAIN] = 0  # no evidence: a short text mustn't be junk because few labellers can judge it
    for _ in range(rounds):
        w = np.stack([counts * (1 - post), counts * post])  # class, pattern
        rates = np.einsum("cp,plv->lcv", w, one) + [1.0, 1.0, 0.0]
        rates /= rates.sum(2, keepdims=True)
        share = (w[1].sum() + 9) / (w.sum() + 10)
        # the classes keep their names: clean is the class in which junk is voted less
        logs = np.einsum("plv,lcv->pc", one[:, :, :ABSTAIN], np.log(rates[:, :, :ABSTAIN])) + np.log([1 - share, share])
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            post = new
            break
        post = new
    return post, rates, float(share)


def fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 1e-4, rate: float = 8.0) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated full-batch descent; sides weigh the same. x isn't copied."""
    weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))
    w = np.zeros(x.shape[1] + 1)
    z, t = w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ z[:-1].astype(x.dtype) + z[-1])))
        off = weight * (p - y)
        g = np.r_[off.astype(x.dtype) @ x + ridge * z[:-1], off.sum()]
        new = z - rate * g / 2
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


def score_quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5, sample: int = 2000, carry: bool = False) -> DataFrame:
    """For each row: id, votes, posterior, score, keep; with `carry` also row, a struct of all columns of docs."""
    with_column_free(docs, id_column, text_column)
    spark = docs.sparkSession
    tables = Tables(spark, "quality")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    voted = tables.write(_vote_rows(rows), "votes")
    counted = voted.groupBy("votes").count().orderBy("votes").collect()  # 3^8 rows at most
    out = ["votes", "posterior", "score", *(["row"] if carry else [])]
    if not counted:
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        none = docs.select(F.col(id_column).alias("id"), F.lit("").alias("votes"), F.lit(1.0).alias("posterior"), F.lit(1.0).alias("score"), whole.alias("row"))
        return none.select(F.col("id").alias(id_column), *out, F.lit(True).alias("keep"))
    patterns = [r["votes"] for r in counted]
    post, _, share = em(patterns, np.array([r["count"] for r in counted], float))
    prior = dict(zip(patterns, post.tolist(), strict=True))
    model = _train(rows, voted, prior, sample)
    tables.drop("votes")
    packed = spark.sparkContext.broadcast((prior, model))

    # with carry, rows are sent as they are, in columns by place, so that a text is sent once
    sent = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]) if carry else rows.select(F.col("id").alias("c0"), F.col("text").alias("c1"))
    at_id, at_text = (docs.columns.index(id_column), docs.columns.index(text_column)) if carry else (0, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, fitted = packed.value
        for batch in pieces(batches, f"c{at_text}"):
            data, offsets = utf8(batch.column(at_text))
            h, _, first = words(data, offsets)
            names, posts, scores = [], [], []
            for a, b, x, y in zip(offsets.tolist(), offsets[1:].tolist(), first.tolist(), first[1:].tolist(), strict=False):
                name = "".join(map(str, votes(data[a:b], h[x:y])))
                p = known[name]
                score = p
                if fitted is not None and y > x:
                    odds = np.log(max(p, 1e-6) / max(1 - p, 1e-6))
                    score = float(1 / (1 + np.exp(-(hashed(data[a:b]) @ fitted[0] + fitted[1] + odds) / 2)))
                elif y == x:
                    score = 1.0
                names.append(name)
                posts.append(p)
                scores.append(score)
            back = batch if carry else batch.select(["c0"])
            yield pa.RecordBatch.from_arrays([*back.columns, pa.array(names, pa.string()), pa.array(posts, pa.float64()), pa.array(scores, pa.float64())], [*back.schema.names, "votes", "posterior", "score"])

    kinds = StructType([*(sent.schema.fields if carry else sent.schema.fields[:1]), StructField("votes", StringType()), StructField("posterior", DoubleType()), StructField("score", DoubleType())])
    scored = sent.mapInArrow(run, kinds)
    if carry:
        scored = scored.withColumn("row", F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]))
    return scored.select(F.col(f"c{at_id}").alias(id_column), *out, (F.col("score") >= threshold).alias("keep"))


def _train(rows: DataFrame, voted: DataFrame, prior: dict[str, float], sample: int) -> tuple[np.ndarray, float] | None:
    """The scorer; None if one side has no documents. Whole texts of the sample are hashed on the executors."""
    spark = rows.sparkSession
    named = spark.createDataFrame(sorted(prior.items()), "votes string, posterior double")
    known = voted.join(F.broadcast(named), "votes")
    sides = []
    for low, high in ((0.9, 1.01), (-1.0, 0.1)):
        side = known.filter((F.col("posterior") > low) & (F.col("posterior") < high)).filter("id IS NOT NULL")
        sides.append(side.orderBy(F.xxhash64("id"), "id").limit(sample))
    chosen = sides[0].unionByName(sides[1]).select("id").distinct()  # 2 * sample rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = utf8(batch.column("text"))
            h, _, first = words(data, offsets)
            told, vectors = [], []
            for a, b, x, y in zip(offsets.tolist(), offsets[1:].tolist(), first.tolist(), first[1:].tolist(), strict=False):
                told.append(prior["".join(map(str, votes(data[a:b], h[x:y])))])
                vectors.append(hashed(data[a:b]).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(told, pa.float64()), pa.array(vectors, pa.binary())], ["id", "posterior", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.join(F.broadcast(chosen), "id").select("id", "text").mapInArrow(run, f"id {kind}, posterior double, x binary")
    # one row for each id, should ids repeat
    found = found.groupBy("id").agg(F.min(F.struct("posterior", "x")).alias("p")).select("id", "p.*")
    x, y = np.zeros((2 * sample, DIMENSIONS), np.float32), []
    for r in found.orderBy("id").toLocalIterator():
        x[len(y)] = np.frombuffer(r["x"], np.float16)
        y.append(r["posterior"])
    if not y or min(y) > 0.5 or max(y) < 0.5:
        return None
    return fit_linear(x[: len(y)], np.array(y, np.float32))
