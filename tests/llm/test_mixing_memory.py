"""Sizes of the mix: a text of very many words in little memory, and words as the pattern has them."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from cellstore.llm import base, mixing

N = 10_000_000
#: In a JVM of its own with 640 MB of heap.
ALONE = f"""
from pyspark.sql import SparkSession, functions as F
from cellstore.llm import mixing
spark = SparkSession.builder.master("local[1]").config("spark.driver.memory", "640m").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
docs = spark.range(1).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.expr("repeat('b ', {N})").alias("text"))
print("MIXED", [tuple(r) for r in mixing.mix_sources(docs).select("size", "taken").collect()])
"""


def test_a_text_of_very_many_words():
    said = subprocess.run([sys.executable, "-c", ALONE], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=240)
    assert f"MIXED [({N}, {N})]" in said.stdout, said.stderr[-2000:]


def test_words_are_those_of_the_pattern(spark):
    texts = [None, "", " ", "\t\n\x0b\x0c\r ", "a", " a", "a ", "\n\na\x0bb\r", "w w  w", "\x00\x1f \x0e", "   é́ \U0001f600", "\x1c\x85  ", "$1 \\ $", "a " * 5000, " " * 200_000 + "a" + " " * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    plain = docs.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(base.WORD)), F.lit(0)).cast("long").alias("n"), base.n_words(F.col("text")).alias("own"))
    want = {r.doc_id: r.n for r in plain.collect()}
    assert {r.doc_id: r.own for r in plain.collect()} == want == {r.doc_id: r["size"] for r in mixing.mix_sources(docs).collect()}
