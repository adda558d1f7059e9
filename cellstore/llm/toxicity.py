"""Toxicity by compression distance: zstandard with a dictionary trained on ordinary text and with one trained on toxic text.

1. From labelled rows of the fitting folds (a bounded sample, `sample` rows of each label by hash of the id, whole texts) it is found what toxic
   text has that ordinary text lacks. Word beginnings of 4 to 10 characters are counted by their distinct contexts (the word before and after, so that
   copies don't count twice) in either label's texts. Marks are beginnings whose odds in toxic text are `odds` times those in ordinary text, with a
   log-likelihood ratio beyond what chance gives among so many beginnings; the `marks` strongest are kept (a parameter of the model's size, as
   the dictionaries' sizes are).
2. zstandard trains two dictionaries (COVER): one on windows of ordinary texts (`windows` of them, by hash), one on toxic passages, which for each toxic
   text are its marked words, cut to the part that most uses of their mark have in common. Compressors get their content: the ordinary one
   first, then the toxic one or, for the ordinary compressor, as many blanks. So lengths differ only where toxic content helps.
3. A text is cut into windows of four words, the last one shorter. Each window is compressed with both dictionaries; its
   distance is the difference of the two lengths in bytes.
4. A text's features (largest distance; shares and counts of windows over thresholds) are calibrated by logistic regression on the sample.
Whole texts are scored. Inputs of a score are the text alone.

Dictionaries trained on whole toxic texts hold ordinary syllables mostly, and told held-out texts apart barely better than chance (area 0.65): a toxic
text is ordinary but for a few words. Hence the choice of passages.

Defined cases: a null or empty text scores what the calibration gives for no distance at all. Rows that repeat an id are scored each; one of them is
learned from. A null id is scored and never learned from; its held_out is true. Labels that are null or have no document are ignored; several labels
of one id count by their greatest. If a label has no rows, every score is the share of toxic rows in the sample (0.5 without rows). Texts too few to
train a dictionary on are its content as they are. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import WORD, Tables, pieces, with_column_free
from .quality import fit_linear

WINDOW = 4
SAMPLE = 2000
MARKS = 1000
PLAIN_WINDOWS = 100_000
PLAIN_BYTES, TOXIC_BYTES = 12_000, 4_000
THRESHOLDS = (1, 2, 3, 4, 6)
SHORTEST, LONGEST = 4, 10
_EDGES = ".,;:!?\"'()[]{}|$%#*&-"


def fold(id_column: Column, folds: int) -> Column:
    return F.crc32(id_column.cast("string").cast("binary")) % folds


def words_of(text: str | None) -> list[str]:
    """Lower-cased words without marks at their ends."""
    return [w.strip(_EDGES) for w in (text or "").lower().split()]


def windows_of(text: str | None) -> list[bytes]:
    words = (text or "").encode().lower().split()
    return [b" %b " % b" ".join(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW)]


def _contexts(labelled: DataFrame) -> DataFrame:
    """w, toxic: a row for each distinct context of a word in the texts of a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                said = words_of(text)
                found = {c for c in zip(["", *said], said, [*said[1:], ""], strict=False) if len(c[1]) >= SHORTEST}
                keys = [int.from_bytes(blake2b("\n".join(c).encode(), digest_size=8).digest(), "little", signed=True) for c in found]
                yield pa.RecordBatch.from_arrays([pa.array([c[1] for c in found], pa.string()), pa.array([toxic] * len(found), pa.int32()), pa.array(keys, pa.int64())], ["w", "toxic", "context"])

    return labelled.mapInArrow(run, "w string, toxic int, context long").dropDuplicates(["context", "toxic"]).select("w", "toxic")


def find_marks(labelled: DataFrame, tables: Tables, odds: float = 20.0, marks: int = MARKS) -> tuple[dict[str, int], dict[str, int]]:
    """(marks with the number of their contexts in toxic texts, all their longer forms likewise)."""
    found = _contexts(labelled)
    starts = found.select(F.explode(F.expr(f"sequence({SHORTEST}, least(length(w), {LONGEST}))")).alias("k"), "w", "toxic").groupBy(F.expr("substring(w, 1, k)").alias("p"))
    starts = tables.write(starts.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")), "starts")
    whole = tables.write(found.groupBy("toxic").count(), "contexts").collect()
    n = {r["toxic"]: r["count"] for r in whole}
    n1, n0 = float(n.get(1, 0)), float(n.get(0, 0))
    if not n1 or not n0:
        return {}, {}
    limit = 2 * math.log(max(2, starts.count())) + 2
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    share = (a + b) / (n1 + n0)
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    ratio = 2 * (term(a, share * n1) + term(b, share * n0) + term(n1 - a, (1 - share) * n1) + term(n0 - b, (1 - share) * n0))
    strong = starts.withColumn("g", ratio).filter(((a + 0.5) / (n1 + 1) > odds * (b + 0.5) / (n0 + 1)) & (F.col("g") > limit))
    told = {r["p"]: r["a"] for r in strong.orderBy(F.desc("g"), "p").limit(marks).collect()}
    short: dict[str, int] = {}
    for p in sorted(told, key=lambda x: (len(x), x)):
        if not any(p.startswith(q) for q in short):
            short[p] = told[p]
    if not short:
        return {}, {}
    longer = starts.filter(F.substring("p", 1, SHORTEST).isin(sorted({p[:SHORTEST] for p in short}))).orderBy(F.desc("a"), "p").limit(20 * marks)
    return short, {r["p"]: r["a"] for r in longer.collect()}


def passage(text: str | None, short: dict[str, int], longer: dict[str, int]) -> bytes:
    """A toxic text's marked words, once each, cut to what most uses of their mark have in common."""
    out: dict[str, None] = {}
    for w in words_of(text):
        mark = next((w[:k] for k in range(SHORTEST, min(len(w), LONGEST) + 1) if w[:k] in short), None)
        if mark:
            k = len(mark)
            while k < min(len(w), LONGEST) and longer.get(w[: k + 1], 0) * 10 >= 6 * short[mark]:
                k += 1
            out[w[:k]] = None
    said = " ".join(out).encode()
    return b" %b %b " % (said, said) if said else b""


def train(samples: list[bytes], size: int) -> bytes:
    """The dictionary that zstandard trains; the samples themselves, up to that size, if they are too few for it."""
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(9, dict_size=len(content), source_size=32, min_match=3, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=how)


def distances(text: str | None, plain: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> np.ndarray:
    """Of each window: bytes that the toxic dictionary saves."""
    a, b, windows = plain.compress, toxic.compress, windows_of(text)
    return np.fromiter((len(a(w)) - len(b(w)) for w in windows), np.int64, len(windows))


def summary(d: np.ndarray) -> list[float]:
    """Features of a text."""
    if not len(d):
        return [0.0] * (1 + 2 * len(THRESHOLDS))
    over = [int((d >= k).sum()) for k in THRESHOLDS]
    return [float(np.clip(d.max(), 0, 12)) / 4, *(min(1.0, 5 * x / len(d)) for x in over), *(float(np.log1p(x)) for x in over)]


def dictionaries(labelled: DataFrame, tables: Tables, windows: int = PLAIN_WINDOWS) -> tuple[bytes, bytes] | None:
    """labelled: text, toxic. Contents for the ordinary and the toxic compressor; None if a label has no text with words."""
    short, longer = find_marks(labelled, tables)

    def extracts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [passage(t, short, longer) if short else b"".join(windows_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x in found if x], pa.binary())], ["x"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for t in batch.column("text").to_pylist():
                found = list(dict.fromkeys(windows_of(t)))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["x"])

    toxic = labelled.filter("toxic = 1").select("text").mapInArrow(extracts, "x binary").select(F.substring("x", 1, 4 * TOXIC_BYTES).alias("x"))
    toxic = [bytes(r["x"]) for r in toxic.orderBy(F.xxhash64("x"), "x").toLocalIterator()]  # a row for each toxic text of the sample at most
    plain = labelled.filter("toxic = 0").select("text").mapInArrow(cut, "x binary")
    plain = [bytes(r["x"]) for r in plain.orderBy(F.xxhash64("x"), "x").limit(windows).toLocalIterator()]
    if not toxic or not plain:
        return None
    a, b = train(plain, PLAIN_BYTES), train(toxic, TOXIC_BYTES)
    return a + b" " * len(b), a + b


def score_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.7, folds: int = 3, held_out: int = 1, sample: int = SAMPLE) -> DataFrame:
    """For each row: id, held_out, score, predicted, windows. labels: id, toxic."""
    with_column_free(docs, id_column, text_column)
    with_column_free(labels, id_column, "toxic")
    spark = docs.sparkSession
    tables = Tables(spark, "toxicity")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    told = labels.filter(F.col("toxic").isin(0, 1)).groupBy(F.col(id_column).alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    told = told.filter(fold(F.col("id"), folds) != held_out)
    chosen = [told.filter(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    # bounded by 2 * sample rows: one for each id, should ids repeat
    labelled = rows.filter("text IS NOT NULL").join(F.broadcast(chosen[0].union(chosen[1])), "id")
    labelled = labelled.groupBy("id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    labelled = tables.write(labelled.select("id", "text", "toxic"), "labelled")
    found = dictionaries(labelled, tables)
    model = None
    if found:
        packed = spark.sparkContext.broadcast(found)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            plain, toxic = map(compressor, packed.value)
            for batch in pieces(batches):
                out = [summary(distances(t, plain, toxic)) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

        points = labelled.mapInArrow(measure, "x array<double>, toxic int").collect()
        points.sort()
        x, y = np.array([p["x"] for p in points]), np.array([float(p["toxic"]) for p in points])
        model = fit_linear(x, y, rounds=2000, ridge=1e-4, rate=1.0)
    share = 0.5 if model else labelled.agg(F.coalesce(F.avg("toxic"), F.lit(0.5))).first()[0]
    tables.drop("labelled", "starts", "contexts")
    fitted = spark.sparkContext.broadcast((found, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents, line = fitted.value
        plain, toxic = map(compressor, contents)
        for batch in pieces(batches):
            scores, sizes = [], []
            for t in batch.column("text").to_pylist():
                d = distances(t, plain, toxic)
                z = float(np.dot(summary(d), line[0]) + line[1])
                scores.append(1 / (1 + np.exp(-np.clip(z, -50, 50))))
                sizes.append(len(d))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())], ["id", "score", "windows"])

    kind = rows.schema["id"].dataType.simpleString()
    if model is None:
        scored = rows.select("id", F.lit(float(share)).alias("score"), F.ceil(F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) / WINDOW).alias("windows"))
    else:
        scored = rows.mapInArrow(run, f"id {kind}, score double, windows long")
    held = F.coalesce(fold(F.col("id"), folds) == held_out, F.lit(True))
    return scored.select(F.col("id").alias(id_column), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "windows")
