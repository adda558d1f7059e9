"""Exact duplicates: counting quotient filters of fingerprints, then byte verification.

1. Each text is normalised (runs of ASCII white space become one space), fingerprinted (64 bits) and digested. The
   narrow columns go to a table in the shared folder.
2. Each partition builds a counting quotient filter of its fingerprints (module `quotient`) and gives it out in blocks, by the first bits of the
   quotient. Filters of one block merge losslessly, by sorted remainders. The number of blocks follows the number of rows, so a block stays bounded
   however large the corpus, and a fingerprint that stands for a third of all rows takes a few slots in each partition's filter.
3. Fingerprints with a count above one go to byte verification: rows with such a fingerprint are grouped by their
   fingerprint, digest and whole normalised text, so only identical bytes share a group. Equal texts are combined before
   the shuffle. The fingerprints are broadcast if they are few (counted). Otherwise a bitmap of fixed size (FILTER_BITS) takes their place in the scan: rows
   without a repeated fingerprint are left out before anything is dealt, but for those that the bitmap can't tell (under a hundredth up to
   about three million repeated fingerprints; the fuller it is, the more texts are dealt), and the join with the fingerprints follows.
4. Rows get their group by fingerprint and digest; groups with over a thousandth of all rows are joined by broadcast (there are
   fewer than 1000). Should two different texts share both hashes, that pair of hashes is resolved by whole texts.

Defined cases: null counts as the empty text. Of equal texts the smallest id stays; null ids come last, and in a group
with only null ids all rows stay. Rows that repeat an id and its text are one document: they count in group_size and are all
marked alike. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import BROADCAST_ROWS, SPACE, Tables, skew_left_join, with_column_free
from .quotient import QuotientFilter

#: Fingerprints that one block of quotients holds on average.
BLOCK_ROWS = 200_000
FILTER_BITS = 26


def build_filters(block_bits: int):
    """Arrow batches of fingerprints to the partition's counting quotient filter, a row for each block that has any."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, own = [], 0, QuotientFilter()
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += len(batch)
            if size > 500_000:
                own.insert(np.concatenate(held))
                held, size = [], 0
        if held:
            own.insert(np.concatenate(held))
        keys, _ = own.items()
        for name in np.unique(keys >> np.uint64(64 - block_bits)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([own.part(block_bits, name).to_bytes()], pa.binary())], ["block", "filter"])

    return build


def merge_filters(block_bits: int):
    """The filters of one block as one. Gives the fingerprints counted twice or more."""

    def merge(table: pa.Table) -> pa.Table:
        parts = [QuotientFilter.from_bytes(x.as_py()) for x in table.column("filter")]
        whole = parts[0]
        whole.merge(parts[1:])
        keys, counts = whole.items()
        many = counts > 1
        keys = keys[many] | np.uint64(table.column("block")[0].as_py() << 64 - block_bits)
        return pa.table({"fp": keys.view(np.int64), "n": counts[many]})

    return merge


def _bitmap(many: DataFrame, tables: Tables) -> DataFrame:
    """One row, bits: 2^FILTER_BITS bits as an array of longs, two bits set for each fingerprint."""
    places = many.select(F.explode(F.array(*_places(F.col("fp")))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(p & 63 AS INT)))").alias("x"))
    every = many.sparkSession.range(1 << FILTER_BITS - 6).select(F.col("id").alias("w")).join(words, "w", "left")
    return tables.write(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("x", F.lit(0).cast("long")).alias("x")))), lambda e: e["x"]).alias("bits")), "bitmap")


def _places(fp: Column) -> list[Column]:
    """Two places of a fingerprint in the bitmap."""
    return [F.shiftrightunsigned(fp, 64 - FILTER_BITS), fp.bitwiseAND((1 << FILTER_BITS) - 1)]


def _may_repeat(texts: DataFrame, many: DataFrame, tables: Tables) -> DataFrame:
    """The rows whose fingerprint the bitmap of repeated ones has."""
    bits = _bitmap(many, tables)
    for p in _places(F.col("fp")):
        word = F.get(bits.scalar(), F.shiftright(p, 6).cast("int"))
        texts = texts.filter(F.call_function("shiftrightunsigned", word, p.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1)
    return texts


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row: id, keep_id, group_size, kept, text_sha256."""
    with_column_free(docs, id_column, text_column)
    spark = docs.sparkSession
    tables = Tables(spark, "exact-dedup")
    normal = F.regexp_replace(F.coalesce(F.col(text_column), F.lit("")), SPACE, " ")
    texts = docs.select(F.col(id_column).alias("_id"), normal.alias("_text"))
    texts = texts.select("_id", "_text", F.xxhash64("_text").alias("fp"), F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("sha"))
    narrow = tables.write(texts.drop("_text"), "narrow")
    total = narrow.count()
    if not total:
        return narrow.select(F.col("_id").alias(id_column), F.col("_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))

    bits = max(4, math.ceil(math.log2(total / BLOCK_ROWS))) if total > BLOCK_ROWS else 4
    filters = narrow.select("fp").mapInArrow(build_filters(bits), "block long, filter binary")
    many = tables.write(filters.groupBy("block").applyInArrow(merge_filters(bits), "fp long, n long"), "many")
    n_many = many.count()

    keys = ["fp", "sha"]
    grouped = [F.min("_id").alias("keep_id"), F.count("*").alias("group_size")]
    if n_many <= BROADCAST_ROWS:
        bytes_equal = texts.join(F.broadcast(many.select("fp")), "fp", "left_semi").groupBy(*keys, "_text").agg(*grouped)
    else:
        bytes_equal = _may_repeat(texts, many, tables).groupBy(*keys, "_text").agg(*grouped).join(many.select("fp"), "fp", "left_semi")
    groups = bytes_equal.groupBy(*keys).agg(F.count("*").alias("n_texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    groups = tables.write(groups, "groups")
    tables.drop("many", "bitmap")
    clashes = groups.filter("n_texts > 1").count()

    out = skew_left_join(narrow, groups.filter("n_texts = 1").drop("n_texts"), keys, "group_size", total)
    if clashes:  # different texts with equal fingerprint and digest: whole texts decide
        odd = groups.filter("n_texts > 1").select(*keys)
        by_text = texts.groupBy(*keys, "_text").agg(*grouped).join(odd, keys, "left_semi")
        told = texts.join(odd, keys, "left_semi").join(by_text, [*keys, "_text"]).select("_id", *keys, "keep_id", "group_size")
        out = out.join(odd, keys, "left_anti").unionByName(told)
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("_id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("_id").alias(id_column),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


ORACLE = r"""
WITH a AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM a WINDOW w AS (PARTITION BY t)
"""
