"""N-gram Jaccard join: a grouped prefix join on word shingles, exact, giving classes of linked documents.

Sets: A-Z are lower-cased; words are runs without ASCII white space; a document's set holds its distinct shingles of `n` words (the
whole sequence if there are fewer words; nothing without words), as 64-bit hashes. Two documents link when
100 * intersection >= percent * union.

1. A sketch counts in how many documents shingles occur, in 2^20 counters whatever the corpus. Shingles are ordered by (count,
   hash): one total order for all documents, in which passages that many documents share come last. The order steers
   cost only, never the result. Rows are numbered so that those with the commonest prefixes come first: of near copies, what they were copied
   from has the fewest shingles of its own, and makes the best pivot. Shingles whose counter stands for over a thousandth of all documents are marked as hot.
2. Each document gives its size, a digest of its whole set, a bitmap of its set (three to six bits a shingle), and its prefix: the first
   size - ceil(percent% of size) + 1 shingles of its set. Linked documents share a shingle of their prefixes.
3. Identical sets are collapsed into one member, and members with identical prefix and size into one group. Only groups meet.
4. Postings (shingle, group, size, place in the prefix) are dealt by shingle; those of hot shingles are summed before they are dealt, and joined
   with the sums. Within a shingle, every group is paired with one pivot (the least), never all with all; pairs of groups are
   filtered by size and by how many shingles their prefixes share. Pairs expand to members: a group's least member meets the other's, and
   the members of its own group.
5. Pairs pass a bound on the overlap that their bitmaps give (it never rules a link out), and are then verified on whole sets, which are made again
   from the texts of the documents that are left. Links give classes, by min-label propagation.
6. Exactness beyond the pivot: shingles whose members are still in more than one class are looked at again, and so are all prefixes of groups whose
   members are. First, members outside a shingle's largest class meet one more pivot of it; then all pairs of different classes that pass the
   tests of size and place meet, so that none is left untested. None is verified twice. In shingles with many members, bands of sizes in the join's
   key keep those that can't be linked from meeting.

Rows are the vertices: each has a number of its own, so ids may be of any type and may repeat, even with another text.

Defined cases: null or empty text, or one of white space only, has an empty set and is linked with nothing (its class is its own id).
A row with a null id is linked like others; its class is the least id that there is, or null. Rows that repeat an id and a text have one set, and so one
class; rows that repeat an id with another text have each their own. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import BROADCAST_ROWS, Tables, give_back, mix, pieces, skew_left_join, utf8, with_column_free, words

SKETCH_BITS = 20
SLICES = 64
#: Members of an open shingle from which on they meet by bands of sizes.
MANY = 32
_SALT = np.random.default_rng(31).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    hashes, _, first = words(data, offsets)
    rolled = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        rolled += hashes[k : k + len(rolled)] * _SALT[k % 64]
    rolled = mix(rolled)
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= n:
            yield np.unique(rolled[a : b - n + 1])
        elif b > a:
            yield mix((hashes[a:b] * _SALT[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def prefix_length(size: int, percent: int) -> int:
    return size - -(-size * percent // 100) + 1 if size else 0


def enough(size_a, size_b, shared, percent: int):
    """Can sets of these sizes link if their prefixes share so many shingles?

    Say a's prefix ends first in the order. What both sets share up to there is in both prefixes; beyond it a has no more than its size less
    its prefix. So the overlap is at most the shared shingles and that rest; the greater rest of the two is allowed for.
    """

    def rest(size):
        return size - (size - F.ceil(size * percent / 100) + 1)

    return (shared + F.greatest(rest(size_a), rest(size_b))) * (100 + percent) >= percent * (size_a + size_b)


def count_sketch(docs: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """(document counts of shingles by their hash's low bits, number of documents); 2^20 counters, summed over partitions in slices."""
    width = (1 << SKETCH_BITS) // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(1 << SKETCH_BITS, np.int64), 0
        for batch in pieces(batches):
            sets = list(shingles(*utf8(batch.column("text")), n))
            low = (np.concatenate(sets) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)
            counts += np.bincount(low, minlength=1 << SKETCH_BITS)
            rows += len(batch)
        parts = [counts[i * width : (i + 1) * width] for i in range(SLICES)] + [np.array([rows])]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES + 1)), pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True) for x in parts])], ["slice", "counts"])

    def add(table: pa.Table) -> pa.Table:
        size = 1 if table.column("slice")[0].as_py() == SLICES else width
        total = np.zeros(size, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(pa.decompress(x.as_py(), size * 8, "zstd", asbytes=True), np.int64)
        return pa.table({"slice": table.column("slice").slice(0, 1), "counts": pa.array([np.minimum(total, (1 << 63) - 1).tobytes()], pa.binary())})

    rows = docs.select("text").mapInArrow(run, "slice long, counts binary").groupBy("slice").applyInArrow(add, "slice long, counts binary")
    out, n_docs = np.zeros(1 << SKETCH_BITS, np.uint32), 0
    for x in rows.toLocalIterator():  # 64 rows of 128 KB and one of a number
        told = np.frombuffer(x["counts"], np.int64)
        if x["slice"] == SLICES:
            n_docs = int(told[0])
        else:
            out[x["slice"] * width : (x["slice"] + 1) * width] = np.minimum(told, (1 << 32) - 1)
    return out, n_docs


def bitmap(s: np.ndarray) -> bytes:
    """Parity of a set's shingles by their hash's high bits; 256 bits or more, a power of two."""
    bits = max(8, int(3 * len(s)).bit_length())
    return np.packbits((np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1).astype(np.uint8)).tobytes()


def most_overlap(x: bytes, y: bytes, size_x: int, size_y: int) -> int:
    """At most so many shingles are in both sets: each bit that differs needs one that is in one of them alone."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    if len(a) < len(b):  # a bit of the shorter map stands for adjacent bits of the longer one
        b = np.packbits(np.bitwise_xor.reduce(np.unpackbits(b).reshape(8 * len(a), -1), axis=1))
    return (size_x + size_y - int(np.bitwise_count(a ^ b).sum())) // 2


def features(docs: DataFrame, n: int, percent: int, sketch, hot_above: int) -> DataFrame:
    """id, size, set digest (two longs), group digest (two longs), bits, n_hot (so many shingles at the prefix's end are hot), rarity (0 to 63, by the mean
    count of the prefix's shingles), prefix as bytes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in pieces(batches):
            sizes, digests, groups, bits, hot, rarity, prefixes = [], [], [], [], [], [], []
            for s in shingles(*utf8(batch.column("text")), n):
                k = prefix_length(len(s), percent)
                count = counts[(s & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
                order = np.argsort(count, kind="stable")[:k]
                prefix = s[order].tobytes()
                sizes.append(len(s))
                digests.append(blake2b(s.tobytes(), digest_size=16).digest())
                groups.append(blake2b(prefix, digest_size=16, key=str(len(s)).encode()).digest())
                bits.append(bitmap(s) if len(s) else b"")
                hot.append(int(np.count_nonzero(count[order] > hot_above)))
                rarity.append(max(0, 63 - int(4 * np.log2(count[order].mean() + 1))) if k else 63)
                prefixes.append(prefix)
            a, b = (np.frombuffer(b"".join(x), np.int64).reshape(-1, 2) for x in (digests, groups))
            columns = [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(a[:, 0]), pa.array(a[:, 1]), pa.array(b[:, 0]), pa.array(b[:, 1]), pa.array(bits, pa.binary()), pa.array(hot, pa.int32()), pa.array(rarity, pa.int64()), pa.array(prefixes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "size", "set_a", "set_b", "group_a", "group_b", "bits", "n_hot", "rarity", "prefix"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, size long, set_a long, set_b long, group_a long, group_b long, bits binary, n_hot int, rarity long, prefix binary")


def posting_rows(rows: DataFrame) -> DataFrame:
    """rows: v, size, n_hot, prefix. A row for each shingle of a prefix: token, v, size, place, hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 2000):
                batch = whole.slice(i, 2000)
                prefixes = batch.column("prefix").to_pylist()
                lengths = np.array([len(p) // 8 for p in prefixes], np.int64)
                ends = np.cumsum(lengths)
                place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
                hot = place >= np.repeat(lengths - batch.column("n_hot").to_numpy(), lengths)
                columns = [np.frombuffer(b"".join(prefixes), np.int64), np.repeat(batch.column("v").to_numpy(), lengths), np.repeat(batch.column("size").to_numpy(), lengths).astype(np.int32), place.astype(np.int32), hot]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "v", "size", "place", "hot"])
        give_back()

    return rows.select("v", "size", "n_hot", "prefix").mapInArrow(run, "token long, v long, size int, place int, hot boolean")


def few(df: DataFrame) -> DataFrame:
    """The table, to be broadcast if its narrow rows are few (counted)."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def wanted_of(pairs: DataFrame) -> DataFrame:
    """v, left (does it stand on a pair's left?) for each vertex of the pairs."""
    both = pairs.select(F.col("a").alias("v"), F.lit(1).alias("_l")).union(pairs.select(F.col("b").alias("v"), F.lit(0).alias("_l")))
    return both.groupBy("v").agg((F.max("_l") == 1).alias("left"))


def bounded(pairs: DataFrame, feats: DataFrame, percent: int, tables: Tables, name: str) -> DataFrame:
    """The pairs (a, b) that their bitmaps allow to be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "n", "m")), strict=True):
                both = most_overlap(x, y, n, m)
                keep.append(100 * both >= percent * (n + m - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    wanted = tables.write(wanted_of(pairs), f"{name}-wanted")
    maps = tables.write(feats.select("v", "size", "bits").join(few(wanted), "v"), f"{name}-maps")
    rows = pairs.join(maps.select(F.col("v").alias("b"), F.col("bits").alias("y"), F.col("size").alias("m")), "b")
    rows = rows.join(maps.filter("left").select(F.col("v").alias("a"), F.col("bits").alias("x"), F.col("size").alias("n")), "a")
    out = tables.write(rows.select("a", "b", "x", "y", "n", "m").mapInArrow(run, "a long, b long"), f"{name}-bounded")
    tables.drop(f"{name}-maps", f"{name}-wanted")
    return out


def verified(pairs: DataFrame, docs: DataFrame, members: DataFrame, n: int, percent: int, tables: Tables, name: str) -> DataFrame:
    """Those of the pairs whose whole sets are alike enough; sets are made from texts, by the digests that members have."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [s.tobytes() for s in shingles(*utf8(batch.column("text")), n)]
            digests = np.frombuffer(b"".join(blake2b(s, digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(sets, pa.binary())], ["set_a", "set_b", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(y) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    wanted = members.select(F.col("member").alias("v"), F.col("any_id").alias("_id"), "set_a", "set_b").join(few(wanted_of(pairs)), "v")
    wanted = tables.write(wanted, f"{name}-wanted")
    known = few(wanted)
    ids = known.select("_id")
    texts = docs.join(F.broadcast(ids) if known is not wanted else ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    # a row whose id is wanted but whose text is another has another digest, and goes here
    sets = texts.mapInArrow(make, "set_a long, set_b long, shingles binary").join(known.drop("_id"), ["set_a", "set_b"]).select("v", "left", "shingles").dropDuplicates(["v"])
    sets = tables.write(sets, f"{name}-sets")
    rows = pairs.join(sets.select(F.col("v").alias("b"), F.col("shingles").alias("y")), "b")
    rows = rows.join(sets.filter("left").select(F.col("v").alias("a"), F.col("shingles").alias("x")), "a")
    out = tables.write(rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), f"{name}-links")
    tables.drop(f"{name}-sets", f"{name}-wanted")
    return out


def components(links: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(v, root) for each vertex of the links (a, b): root is the least vertex that can be reached.

    Each round points every vertex at its least neighbour, follows pointers once, and contracts the links to roots; the number of links
    that join different roots falls by at least half a star's depth each time, so rounds are logarithmic in a class's diameter.
    """
    edges = tables.write(links.select("a", "b").filter("a <> b").distinct(), f"{name}/edges")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = tables.write(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("root")), f"{name}/label-0")
    k = 0
    while True:
        k += 1
        roots = label.select(F.col("v").alias("root"), F.col("root").alias("up"))
        jumped = label.join(roots, "root", "left").select("v", F.least("root", F.coalesce("up", "root")).alias("root"))
        jumped = tables.write(jumped, f"{name}/jump-{k}")
        cross = edges.join(jumped.select(F.col("v").alias("a"), F.col("root").alias("x")), "a").join(jumped.select(F.col("v").alias("b"), F.col("root").alias("y")), "b").filter("x <> y").select("x", "y")
        hooks = cross.select(F.greatest("x", "y").alias("root"), F.least("x", "y").alias("low")).groupBy("root").agg(F.min("low").alias("low"))
        hooks = tables.write(hooks, f"{name}/hook-{k}")
        if hooks.isEmpty():
            again = jumped.join(jumped.select(F.col("v").alias("root"), F.col("root").alias("up")), "root", "left").filter("up <> root")
            if again.isEmpty():
                return jumped
            label = jumped
            continue
        label = tables.write(jumped.join(hooks, "root", "left").select("v", F.coalesce("low", "root").alias("root")), f"{name}/label-{k}")


def by_token(cold: DataFrame, hot: DataFrame, **aggregates: Column) -> DataFrame:
    """Rows with aggregates over each token's rows.

    Rows of tokens that aren't hot are dealt once, by token. Those of hot ones are aggregated before they are dealt, and joined with the
    aggregates, where Spark can split a token's rows.
    """
    cold = cold.withColumns({k: c.over(Window.partitionBy("token")) for k, c in aggregates.items()})
    hot = hot.join(hot.groupBy("token").agg(*[c.alias(k) for k, c in aggregates.items()]), "token")
    return cold.unionByName(hot.select(*cold.columns))


def classes(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """docs: id, text. For each row: id, size, component (the least id reachable by links, itself included), member (the least id with the same set)."""
    spark: SparkSession = docs.sparkSession
    tables = Tables(spark, "ngram-join")
    counts, n_docs = count_sketch(docs, n)
    sketch = spark.sparkContext.broadcast(counts)
    # a row's number: its rarity, then its place (of under 2^24 partitions)
    numbered = F.shiftleft("rarity", 57).bitwiseOR(F.monotonically_increasing_id())
    feats = tables.write(features(docs, n, percent, sketch, n_docs // 1000).withColumn("v", numbered).drop("rarity"), "features")

    # identical sets are one member (its least row); members of equal prefix and size are one group, named by its least member
    members = feats.filter("size > 0").groupBy("group_a", "group_b", "size", "set_a", "set_b").agg(F.min("v").alias("member"), F.min_by("id", "v").alias("any_id"), F.min("id").alias("least_id"), F.count("*").alias("copies"))
    members = tables.write(members, "members")
    grouped = tables.write(members.groupBy("group_a", "group_b", "size").agg(F.min("member").alias("gid"), F.count("*").alias("n_members")), "groups")
    # inside a group of several members, the least is the pivot
    inside = members.join(grouped.filter("n_members > 1").select("group_a", "group_b", "size", "gid"), ["group_a", "group_b", "size"])
    inside = tables.write(inside.select("gid", "member"), "inside")

    first = feats.select("v", "size", "n_hot", "prefix").join(grouped.select(F.col("gid").alias("v")), "v")
    cold, hot = posting_rows(first).filter("NOT hot"), posting_rows(first.filter("n_hot > 0")).filter("hot")
    # the pivot of a shingle is its least group; a shingle of one group is of no use here
    pivoted = by_token(cold, hot, _n=F.count("*"), pivot=F.min("v")).filter("_n > 1")
    posts = tables.write(pivoted.select("token", F.col("v").alias("gid"), "size", "place", "hot", "pivot"), "postings")

    size_of = grouped.select(F.col("gid").alias("a"), F.col("size").alias("p_size"))
    pairs = posts.filter("gid <> pivot").groupBy(F.col("pivot").alias("a"), F.col("gid").alias("b"), "size").agg(F.count("*").alias("shared"))
    pairs = pairs.join(size_of, "a").filter(_sizes_fit("size", "p_size", percent) & enough(F.col("size"), F.col("p_size"), F.col("shared"), percent)).select("a", "b")
    more = inside.filter("gid <> member").select(F.col("gid").alias("a"), F.col("member").alias("b"))
    tested = pairs = tables.write(pairs.union(more), "pairs-1")
    links, roots, rows = _linked(pairs, docs, feats, members, n, percent, tables, "round-1"), None, None
    for k in (2, 3):  # one more pivot; then all pairs that are left
        roots = components(links, tables, f"classes-{k}")
        near = few(roots)
        if rows is None:
            # groups whose members aren't in one class by now: their members meet under all shingles of their prefix, in other groups or not
            root = F.coalesce("root", "member")
            split = inside.join(near.select(F.col("v").alias("member"), "root"), "member", "left").groupBy("gid").agg(F.min(root).alias("_x"), F.max(root).alias("_y")).filter("_x <> _y")
            split = tables.write(inside.join(few(tables.write(split.select("gid"), "split")), "gid", "left_semi").select(F.col("member").alias("v")), "split-members")
            own = posting_rows(feats.select("v", "size", "n_hot", "prefix").join(few(split), "v", "left_semi")).withColumnRenamed("v", "m")
            wide = posts.select("token", "gid", "size", "place", "hot").join(inside, "gid", "left").select("token", F.coalesce("member", "gid").alias("m"), "size", "place", "hot")
            rows = wide.join(few(split.withColumnRenamed("v", "m")), "m", "left_anti").unionByName(own)
        rows = tables.write(_open(rows, near), f"open-{k}")
        tables.drop("postings" if k == 2 else "open-2")
        found = _pivot_pairs(rows, percent) if k == 2 else _all_pairs(rows, percent)
        done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = tables.write(found.join(done, ["a", "b"], "left_anti"), f"pairs-{k}")
        if not pairs.isEmpty():
            links = tables.write(links.union(_linked(pairs, docs, feats, members, n, percent, tables, f"round-{k}")), f"links-{k}")
            tested = tables.write(tested.union(pairs), f"tested-{k}") if k == 2 else tested
    roots = components(links, tables, "classes-4")
    tables.drop("open-3")

    # every document gets the class of its member
    linked = roots.join(members.select(F.col("member").alias("v"), "least_id"), "v")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component"))
    named = roots.join(few(tables.write(least, "least")), "root").select(F.col("v").alias("member"), "component")
    label = members.join(few(tables.write(named, "named")), "member", "left").select("set_a", "set_b", "copies", F.coalesce("component", "least_id").alias("component"), F.col("least_id").alias("member"))
    label = tables.write(label, "labels")
    narrow = tables.write(feats.select("id", "size", "set_a", "set_b"), "narrow")
    tables.drop("features", "members", "groups", "inside", "classes-4")
    # a set with over a thousandth of all rows: fewer than 1000 of them
    out = skew_left_join(narrow, label, ["set_a", "set_b"], "copies", max(n_docs, 1))
    alone = F.col("size") == 0
    return out.select("id", "size", F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component"), F.when(alone, F.col("id")).otherwise(F.col("member")).alias("member"))


def _linked(pairs: DataFrame, docs: DataFrame, feats: DataFrame, members: DataFrame, n: int, percent: int, tables: Tables, name: str) -> DataFrame:
    return verified(bounded(pairs, feats, percent, tables, name), docs, members, n, percent, tables, name)


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows (token, m, size, place, hot) of shingles whose members are in several classes, with the class (root), the shingle's number of members (n),
    its largest class (top), and a member of that (pivot, p_size)."""
    classed = rows.select("token", "m", "size", "place", "hot").join(roots.select(F.col("v").alias("m"), F.col("root").alias("_root")), "m", "left").withColumn("root", F.coalesce("_root", "m")).drop("_root")
    cold, hot = classed.filter("NOT hot"), classed.filter("hot")
    over, within = Window.partitionBy("token"), Window.partitionBy("token", "root")
    cold = cold.withColumns({"_x": F.min("root").over(over), "_y": F.max("root").over(over), "n": F.count("*").over(over)}).filter("_x <> _y").drop("_x", "_y")
    cold = cold.withColumn("_in", F.count("*").over(within)).withColumn("top", F.max(F.struct("_in", "root")).over(over)["root"]).drop("_in")
    tops = hot.groupBy("token", "root").agg(F.count("*").alias("_in")).groupBy("token").agg(F.max(F.struct("_in", "root"))["root"].alias("top"), F.sum("_in").alias("n"), F.count("*").alias("_classes"))
    hot = hot.join(tops.filter("_classes > 1").drop("_classes"), "token")
    chosen = F.min(F.when(F.col("root") == F.col("top"), F.struct(F.xxhash64("m").alias("h"), F.col("m").alias("m"), F.col("size").alias("s"))))
    cold, hot = cold.withColumn("_p", chosen.over(over)), hot.join(hot.groupBy("token").agg(chosen.alias("_p")), "token")
    found = cold.unionByName(hot.select(*cold.columns))
    return found.withColumns({"pivot": F.col("_p.m"), "p_size": F.col("_p.s")}).drop("_p")


def _pivot_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Of open rows: each member outside its shingle's largest class with the shingle's pivot, if sizes and shared shingles allow a link."""
    met = rows.filter((F.col("root") != F.col("top")) & _sizes_fit("size", "p_size", percent))
    met = met.groupBy(F.least("m", "pivot").alias("a"), F.greatest("m", "pivot").alias("b")).agg(F.count("*").alias("shared"), F.max("size").alias("sa"), F.max("p_size").alias("sb"))
    return met.filter(enough(F.col("sa"), F.col("sb"), F.col("shared"), percent)).select("a", "b")


def _all_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Of open rows: all pairs of members that share a shingle but no class, if sizes, places and shared shingles allow a link."""
    rows = rows.withColumn("few", F.col("top") != F.col("root"))
    small = rows.filter(F.col("n") < MANY).withColumns({"own": F.lit(-1).cast("long"), "partner": F.lit(-1).cast("long")})
    banded = _partner_bands(rows.filter(F.col("n") >= MANY), percent)
    left = small.unionByName(banded.select(*[F.col(c).cast("long") if c in ("own", "partner") else F.col(c) for c in small.columns]))
    a = left.filter("few").select("token", F.col("own").alias("ka"), F.col("partner").alias("kb"), F.col("m").alias("ma"), F.col("root").alias("ra"), F.col("size").alias("sa"), F.col("place").alias("pa"), "top")
    b = left.select("token", F.col("partner").alias("ka"), F.col("own").alias("kb"), F.col("m").alias("mb"), F.col("root").alias("rb"), F.col("size").alias("sb"), F.col("place").alias("pb"))
    # two members outside the largest class meet once, from the lesser one
    once = (F.col("rb") == F.col("top")) | (F.col("ma") < F.col("mb"))
    needed = F.expr(_needed("sa", "sb", percent))
    # no shingle further on in either set can be the first that linked sets share
    met = a.join(b, ["token", "ka", "kb"]).filter((F.col("ra") != F.col("rb")) & once & _sizes_fit("sa", "sb", percent) & (F.col("sa") - F.col("pa") >= needed) & (F.col("sb") - F.col("pb") >= needed))
    swap = F.col("ma") > F.col("mb")
    both = met.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b"), *[F.when(swap, F.col(y)).otherwise(F.col(x)).alias(n) for n, x, y in (("sa", "sa", "sb"), ("sb", "sb", "sa"), ("pa", "pa", "pb"), ("pb", "pb", "pa"))])
    both = both.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("sa").alias("sa"), F.max("sb").alias("sb"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    # all that both share up to the last shingle met has been counted; what is left of either must reach the overlap
    place_ok = F.col("shared") + F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb")) - 1 >= needed
    return both.filter(place_ok).select("a", "b")


def _needed(a: str, b: str, percent: int) -> str:
    """SQL for the least overlap of sets of these sizes, in whole numbers."""
    return f"({percent} * (CAST({a} AS BIGINT) + {b}) + {99 + percent}) DIV {100 + percent}"


def _band(size: str) -> str:
    """SQL for a size's band: four bands to each doubling, sizes under 8 one each."""
    return f"IF({size} < 4, {size}, (LENGTH(BIN({size})) - 3) * 4 + SHIFTRIGHT({size}, LENGTH(BIN({size})) - 3))"


def _partner_bands(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (token, size, place, ..) for each band of sizes (partner) with a size that allows a link through this shingle; own is the row's.

    A shingle at place p of a set of size s can be the first that it shares with a linked set of size t only if s - p reaches the least
    overlap of s and t, which grows with t: the later the shingle, the smaller its largest partner.
    """
    lowest = f"({percent} * CAST(size AS BIGINT) + 99) DIV 100"
    highest = f"LEAST(CAST(size AS BIGINT) * 100 DIV {percent}, (CAST(size AS BIGINT) - place) * {100 + percent} DIV {percent} - size)"
    ranged = rows.withColumns({"_low": F.expr(lowest), "_high": F.expr(highest), "own": F.expr(_band("CAST(size AS BIGINT)"))}).filter("_low <= _high")
    return ranged.withColumn("partner", F.explode(F.expr(f"SEQUENCE({_band('_low')}, {_band('_high')})"))).drop("_low", "_high")


def ngram_join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """For each row: id, n_shingles, component_id, member_id (the least id with an identical set)."""
    with_column_free(docs, id_column, text_column)
    if not 0 < percent <= 100 or not 0 < n <= 64:
        raise ValueError("percent must be in 1..100 and n in 1..64")
    found = classes(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), n, percent)
    return found.select(F.col("id").alias(id_column), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"), F.col("member").alias("member_id"))



ORACLE = r"""
WITH RECURSIVE told AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                      ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) END AS own FROM told
), single AS (
  SELECT doc_id, len(own) AS n, unnest(own) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM single a JOIN single b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(v, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.v, edges.b FROM reach JOIN edges ON edges.a = reach.r
), classed AS (
  SELECT v, min(r) AS component_id FROM reach GROUP BY v
)
SELECT doc_id, len(own)::BIGINT AS n_shingles, component_id, CASE WHEN len(own) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY own) END AS member_id
FROM sets JOIN classed ON v = doc_id
"""
