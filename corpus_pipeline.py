"""A corpus pipeline of five stages, each of which calls one operator of `cellstore.llm`.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the
columns of `documents`. `run` writes each stage's result to the shared folder and reads it again.

Defined cases, of all stages: a null text counts as empty; a null id is an id like others, the last of all. A document is known by its id and text together
(KEY), so rows that repeat an id with another text are judged apart, and rows that repeat both are judged alike. Texts of any length are taken whole. Further columns
stay as they are, whatever their names (but for KEY's). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellstore.llm import bpe, exact_dedup, mixing, ngram_join, quality
from cellstore.llm.base import BROADCAST_ROWS, Tables
from cellstore.llm.queries import tokenizer_path

KEY = "_pipeline_key"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; documents without words stay. Rows are judged one by one, and carried along, so texts aren't dealt."""
    return quality.score_quality(docs, carry=True).filter("keep").select("row.*")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the least id stays; of rows that repeat an id and a text, one.

    Rows that go are told by an anti-join on keys; those rows that repeat a key are combined first.
    """
    tables = Tables(spark, "exact-stage")
    found = exact_dedup.exact_dedup(_keyed(docs), id_column=KEY).groupBy(KEY).agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    found = tables.write(found.filter("NOT kept OR rows > 1"), "found")
    repeated = found.filter("kept").select(KEY)
    rest = _without(docs, found.select(KEY))
    once = _keyed(docs).join(_few(repeated), KEY, "left_semi").groupBy(KEY).agg(F.first(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return rest.unionByName(once)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts the one with the least id stays; rows that repeat its id and text stay with it."""
    found = ngram_join.ngram_join(_keyed(docs), id_column=KEY)
    gone = Tables(spark, "near-stage").write(found.filter(F.col(KEY) != F.col("component_id")).select(KEY).distinct(), "gone")
    return _without(docs, gone)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix doesn't take go; one that it takes twice or thrice is there so often, in the order of the schedule within a partition.

    A document that a block's edge cuts counts by the nearest whole number of times, once at least. Of rows that repeat an id and a text, each is
    there as often as the one that is taken most.
    """
    taken = mixing.mix_sources(_keyed(docs), id_column=KEY).filter("taken > 0")
    times = taken.select(KEY, F.greatest(F.round(F.col("taken") / F.col("size")), F.lit(1)).cast("int").alias("_times"), F.coalesce("slot", F.lit(0.0)).alias("_slot"))
    times = times.groupBy(KEY).agg(F.max("_times").alias("_times"), F.min("_slot").alias("_slot"))
    kept = _keyed(docs).join(times, KEY).sortWithinPartitions("_slot", KEY)
    return kept.withColumn("_k", F.explode(F.expr("sequence(1, _times)"))).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of ids and of decoded bytes."""
    return bpe.round_trip(docs, tokenizer_path())


def _key() -> Column:
    """Ordered by id, null last; never null, so that it can be joined on."""
    return F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, _key())


def _few(keys: DataFrame) -> DataFrame:
    """A written table of keys, to be broadcast if it has few rows (counted)."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose key isn't among those that go."""
    return _keyed(docs).join(_few(gone), KEY, "left_anti").select(*docs.columns)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", near_dedup_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", encoding_stage),
]

#: The classifier, the hash shuffle of the mix and BPE aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = tables.write(stage(spark, docs, sf_dir), name)
    return docs
