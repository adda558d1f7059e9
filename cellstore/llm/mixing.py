"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: sources in code-point order (null last) weigh 5, 2, 1 and so on, and share all words by weight; a target stops
at `most` times its source's size and the excess is shared again by weight until none is above. That fixed point is found in
one pass: sorted by most * size / weight, the capped sources come first.

Schedule: slot k of 2^m has the van der Corput point bitreverse(k) / 2^m and the time k / 2^m. Cumulative targets cut [0, 1) into a
range for each source, so a source's slots are points from its range on: any stretch of the schedule is mixed in proportion. m is
16, or more for a source whose target would get under 256 slots, so that it gets as many: its blocks are smaller by that power
of two, of one word at least. Slots of a source are ranked in schedule order.

Blocks: a source's documents are shuffled by a hash, and their words, end to end, are cut into equal blocks (to the nearest word)
of about total / 2^m words. It gets as many slots as come nearest to its target, so the words taken miss the target by half a block
at most: half a word, or about 1 / 500 of the target (and a word, as edges are rounded). The slot of rank r takes block
r mod blocks, in epoch r / blocks; slots are `most` epochs at most, so no document is taken more than `most` times. Prefix sums are
found within hash buckets of a source and carried over the buckets, so a source with a third of all rows is still dealt to many tasks.

Each row gets its place in the schedule: the slot (time in [0, 1)) at which a word of it is taken first, with that slot's rank, block and epoch.
Reading rows by slot gives the mix in schedule order.

Slots are under 65,536 and 513 for each source; the schedule is broadcast up to 2^18 slots. Sources are taken to be few: their sizes and
targets are found in one task.

Defined cases: null or empty text has size 0 and is never taken (slot, rank, block and epoch null); a source of size 0 has target 0. Repeated rows are
rows of their own, ordered by id; a null id is an id like others, the last of all. Without words all targets are 0. An empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Tables, n_words, with_column_free

WEIGHTS = (5, 2, 1)
#: Hash buckets of a source, at least, and rows of all sources that one of their buckets may have on average.
BUCKETS, BUCKET_ROWS = 512, 500_000
SLOT_BITS = 16
#: Slots of the least target, if it has as many words.
LEAST_SLOTS = 256
#: Doubles are exact up to here.
MOST_BITS = 52


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """sizes: source, source_size. Adds weight, place (in source order) and target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sized = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sized = sized.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    sized = sized.withColumns({
        "_left": F.sum("source_size").over(all_) - F.coalesce(F.sum("_cap").over(before), F.lit(0)),
        "_weight_left": F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    # capped if an equal share of what is left would be above the cap; then all before it are capped as well
    sized = sized.withColumn("_capped", F.col("_left") * F.col("weight") > F.col("_cap") * F.col("_weight_left"))
    rest = F.struct(F.col("_weight_left").alias("w"), F.col("_left").alias("l"))
    sized = sized.withColumn("_end", F.max(F.when(~F.col("_capped"), rest)).over(all_))
    share = (F.col("weight") * F.col("_end.l")).cast("double") / F.col("_end.w")
    return sized.select("source", "source_size", "place", "weight", F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(share).alias("target"))


def cut_blocks(aims: DataFrame, total: int, most: int = 3) -> DataFrame:
    """aims, as `targets` gives, with each source's bits (its slots are points of 2^bits), blocks and slots."""
    bits = F.ceil(F.log2(F.lit(float(LEAST_SLOTS * total)) / F.col("target")))
    cut = aims.withColumn("bits", F.when(F.col("target") > 0, F.least(F.lit(MOST_BITS), F.greatest(F.lit(SLOT_BITS), bits.cast("int")))).otherwise(F.lit(SLOT_BITS)))
    blocks = F.floor(F.col("source_size") / F.lit(total) * F.pow(F.lit(2.0), "bits")).cast("long")
    cut = cut.withColumn("blocks", F.greatest(F.least(blocks, "source_size"), F.lit(1).cast("long")))
    slots = F.round(F.col("target") / F.greatest("source_size", F.lit(1)) * F.col("blocks")).cast("long")
    return cut.withColumn("slots", F.least(slots, F.lit(most) * F.col("blocks"), F.pow(F.lit(2.0), "bits").cast("long")))


def schedule(aims: DataFrame, total: int) -> DataFrame:
    """The slots in use: at (the slot's time, in [0, 1)), source, rank, block, epoch. aims: as `cut_blocks` gives."""
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    points = F.pow(F.lit(2.0), "bits").cast("long")
    start = F.round(F.coalesce(F.sum("target").over(before), F.lit(0.0)) / total * points).cast("long")
    ranged = aims.withColumn("_from", F.greatest(F.least(start, points - F.col("slots")), F.lit(0).cast("long")))
    dealt = ranged.filter("slots > 0").withColumn("_point", F.explode(F.expr("sequence(_from, _from + slots - 1)")))
    turned = F.conv(F.reverse(F.expr("lpad(bin(_point), bits, '0')")), 2, 10).cast("long")
    ranked = dealt.withColumn("at", turned / points).withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("at")) - 1)
    return ranked.select("at", "source", "rank", (F.col("rank") % F.col("blocks")).alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("epoch"))


def mix_sources(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 7, carry: tuple[str, ...] = ()) -> DataFrame:
    """For each row: id, size, source_size, target, taken, slot, rank, block, epoch; and the source if carry names it."""
    with_column_free(docs, id_column, text_column, source_column)
    tables = Tables(docs.sparkSession, "mixing")
    rows = docs.select(F.col(id_column).alias("_id"), F.col(source_column).alias("source"), n_words(F.col(text_column)).alias("size"))
    rows = tables.write(rows.withColumn("_hash", F.xxhash64(F.lit(seed), "_id")), "sizes")
    n_buckets = max(BUCKETS, -(-rows.count() // BUCKET_ROWS))
    rows = rows.withColumn("_bucket", F.pmod("_hash", F.lit(n_buckets)))
    place = ["slot", "rank", "block", "epoch"]
    out = [F.col("_id").alias(id_column), "size", "source_size", "target", "taken", *place, *(["source"] if "source" in carry else [])]

    buckets = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    buckets = tables.write(buckets, "buckets")
    sizes = buckets.groupBy("source").agg(F.sum("_words").alias("source_size"))
    total, n_sources = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    if not total:
        none = {"slot": F.lit(None).cast("double")} | {c: F.lit(None).cast("long") for c in place[1:]}
        return rows.withColumns({"source_size": F.lit(0).cast("long"), "target": F.lit(0.0), "taken": F.lit(0).cast("long"), **none}).select(*out)
    aims = tables.write(cut_blocks(targets(sizes, weights, most), total, most), "targets")

    so_far = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("_base", F.coalesce(F.sum("_words").over(so_far), F.lit(0))).drop("_words")
    offsets = offsets.join(aims.select("source", "source_size", "target", "blocks"), offsets["source"].eqNullSafe(aims["source"])).drop(aims["source"])
    offsets = offsets.withColumnRenamed("source", "_s").withColumnRenamed("_bucket", "_b")
    in_bucket = Window.partitionBy("source", "_bucket").orderBy("_hash", F.col("_id").asc_nulls_last(), "size")
    placed = rows.withColumn("_n", F.row_number().over(in_bucket)).withColumn("_to", F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)))
    if n_sources * n_buckets <= 1 << 18:
        offsets = F.broadcast(offsets)
    placed = placed.join(offsets, placed["source"].eqNullSafe(offsets["_s"]) & (placed["_bucket"] == offsets["_b"])).drop("_s", "_b")
    placed = placed.withColumn("_end", F.col("_base") + F.col("_to")).withColumn("_start", F.col("_end") - F.col("size"))

    # block b holds the words from ceil(b * source_size / blocks) on, in parts that don't overflow
    edge = lambda b: F.expr(f"{b} * (source_size div blocks) + ({b} * (source_size % blocks) + blocks - 1) div blocks")
    first, last = F.floor(F.col("_start") / F.col("source_size") * F.col("blocks")) - 1, F.floor((F.col("_end") - 1) / F.col("source_size") * F.col("blocks")) + 1
    cut = placed.withColumn("_block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.col("blocks") - 1)))))
    cut = cut.withColumn("_words", F.greatest(F.least("_end", edge("(_block + 1)")) - F.greatest("_start", edge("_block")), F.lit(0)))
    used = schedule(aims, total).groupBy(F.col("source").alias("_s"), F.col("block").alias("_b")).agg(F.count("*").alias("_times"), F.min(F.struct("at", "rank", "block", "epoch")).alias("_slot"))
    if (1 << SLOT_BITS) + (2 * LEAST_SLOTS + 1) * n_sources <= 1 << 18:
        used = F.broadcast(used)
    taken = cut.join(used, cut["source"].eqNullSafe(used["_s"]) & (cut["_block"] == used["_b"]), "left")
    words = F.coalesce(F.col("_words") * F.col("_times"), F.lit(0))
    summed = taken.groupBy("source", "_bucket", "_n", "_id", "size", "source_size", "target").agg(F.sum(words).cast("long").alias("taken"), F.min(F.when(words > 0, F.col("_slot"))).alias("_slot"))
    return summed.withColumns({"slot": F.col("_slot.at"), **{c: F.col(f"_slot.{c}") for c in place[1:]}}).select(*out)


#: Documents are shuffled by xxhash64 of the number 7 and the id: `seed` is the hash of 7, p1 to p5 are the hash's fixed primes.
ORACLE = r"""
WITH fixed AS (
  SELECT 18446744073709551616::UHUGEINT AS m, 2786828215451145335::UHUGEINT AS seed, 11400714785074694791::UHUGEINT AS p1, 14029467366897019727::UHUGEINT AS p2,
         1609587929392839161::UHUGEINT AS p3, 9650029242287828579::UHUGEINT AS p4, 2870177450012600261::UHUGEINT AS p5
), sized AS (
  SELECT row_number() OVER () AS row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), h1 AS (
  SELECT row, fixed.*, (CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616::HUGEINT ELSE doc_id::HUGEINT END)::UHUGEINT * p2 % m AS k FROM sized, fixed
), h2 AS (
  SELECT *, xor((seed + p5 + 8) % m, (k * 2147483648 % m + k // 8589934592) * p1 % m) AS h FROM h1
), h3 AS (
  SELECT *, ((h * 134217728 % m + h // 137438953472) * p1 % m + p4) % m AS i FROM h2
), h4 AS (
  SELECT *, xor(i, i // 8589934592) * p2 % m AS j FROM h3
), h5 AS (
  SELECT *, xor(j, j // 536870912) * p3 % m AS l FROM h4
), hashed AS (
  SELECT row, coalesce(xor(l, l // 4294967296), seed) AS u FROM h5
), signed AS (
  SELECT row, CASE WHEN u >= 9223372036854775808::UHUGEINT THEN u::HUGEINT - 18446744073709551616::HUGEINT ELSE u::HUGEINT END AS hash,
         greatest(512, ceil((SELECT count(*) FROM documents) / 500000)::BIGINT) AS n FROM hashed
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][place % 3 + 1] AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM sources
), bounds AS (  -- what is left for a unit of weight, if just the sources that reach their caps before this one are capped
  SELECT (SELECT any_value(total) FROM weighed) - coalesce((SELECT sum(cap) FROM weighed y WHERE y.cap * x.weight < x.cap * y.weight), 0) AS rest,
         (SELECT sum(weight) FROM weighed y WHERE y.cap * x.weight >= x.cap * y.weight) AS units
  FROM weighed x
), level AS (
  SELECT arg_max(rest, rest / units) AS rest, arg_max(units, rest / units) AS units FROM bounds
), aimed AS (
  SELECT weighed.*, CASE WHEN total = 0 THEN 0 WHEN rest * weight > cap * units THEN cap::DOUBLE ELSE (weight * rest)::DOUBLE / units END AS target FROM weighed, level
), blocked AS (
  SELECT *, CASE WHEN target > 0 THEN least(52, greatest(16, ceil(log2(256::DOUBLE * total / target))::INT)) ELSE 16 END AS bits FROM aimed WHERE total > 0
), slotted AS (
  SELECT *, pow(2, bits)::BIGINT AS points, greatest(least(floor(source_size::DOUBLE / total::DOUBLE * pow(2, bits))::BIGINT, source_size), 1) AS blocks,
         least(round(target / greatest(source_size, 1) * blocks)::BIGINT, 3 * blocks, points) AS slots,
         coalesce(sum(target) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM blocked
), ranged AS (
  SELECT *, greatest(least(round(upto / total * points)::BIGINT, points - slots), 0) AS start FROM slotted
), dealt AS (
  SELECT place, blocks, source_size, points, bits, unnest(range(start, start + slots)) AS point FROM ranged
), timed AS (
  SELECT *, reverse(lpad(bin(point), bits, '0'))::BIT::BIGINT::DOUBLE / points AS slot FROM dealt
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS rank FROM timed
), used AS (
  SELECT place, blocks, source_size, rank % blocks AS block, count(*) AS times, min(slot) AS slot, min(rank) AS rank FROM ranked GROUP BY ALL
), cut AS (
  SELECT *, block * (source_size // blocks) + (block * (source_size % blocks) + blocks - 1) // blocks AS lo,
         (block + 1) * (source_size // blocks) + ((block + 1) * (source_size % blocks) + blocks - 1) // blocks AS hi FROM used
), laid AS (
  SELECT s.row, doc_id, s.size, a.place, a.source_size, a.target,
         (sum(s.size) OVER (PARTITION BY a.place ORDER BY (g.hash % g.n + g.n) % g.n, g.hash, doc_id NULLS LAST, s.size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM sized s JOIN signed g ON g.row = s.row JOIN aimed a ON a.source IS NOT DISTINCT FROM s.source
), met AS (
  SELECT l.row, sum((least(c.hi, l.upto) - greatest(c.lo, l.upto - l.size)) * c.times)::BIGINT AS taken, min(c.slot) AS slot, arg_min(c.rank, c.slot) AS rank,
         arg_min(c.block, c.slot) AS block, arg_min(c.rank // c.blocks, c.slot) AS epoch
  FROM laid l JOIN cut c ON c.place = l.place AND c.lo < l.upto AND c.hi > l.upto - l.size WHERE l.size > 0 AND c.hi > c.lo GROUP BY l.row
)
SELECT doc_id, size, source_size, target::DOUBLE AS target, coalesce(taken, 0) AS taken, slot, rank, block, epoch FROM laid LEFT JOIN met ON met.row = laid.row
"""
