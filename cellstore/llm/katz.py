"""Language-model scoring: Katz backoff over words, bigrams to unigrams to one class of unknown words.

Good-Turing discounts hold for counts up to 5, from the corpus's own counts of counts; a count that they can't discount (too few
counts of counts) is lowered by a half instead. A history none of whose followers is discounted gets a count more, so that some mass is
always left. Backoff weights are exactly normalised: for each history, the discounted followers and the backed-off rest add up to one,
over the training vocabulary, the end and one class for all unknown words, which has the mass that unigram discounts leave.

Nothing moves word by word. Each task packs its documents into blocks: distinct word hashes, and the text as indexes into them.
1. A block asks the partition of each of its words for the word's count in training text, once, and brings its own counts along.
   Partitions (by hash range) hold the unigram table. They number training words, frequent ones first; the answer carries the number.
2. A block asks in the same way for its distinct bigrams of training words, as sorted differences of numbers, dealt by the history's number,
   or by the bigram's if the history stands for over a thousandth of all tokens (fewer than 1000 such histories). A partition adds counts up
   and, for each history, what its backoff weight needs. A bigram with a word that training text lacks has no count and isn't asked for,
   but for one bigram of each history that has no other in the block: every history of training text gets its weight, whatever the block.
3. Blocks meet their answers, and every token is evaluated: discounted bigram, or backoff weight times unigram.
So a frequent bigram is sent once a block, not once an occurrence. Words are 64-bit hashes. Tables and answers are written to the shared
folder, by partition.

Defined cases: null or empty text has one token, the end. Repeated rows are scored each (and each learned from, if in training). A null
id is held out. Without training rows every score is null. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Tables, mix, pieces, utf8, with_column_free, words
from .toxicity import fold

BLOCK_TOKENS = 1_500_000
PART_TOKENS = 1_000_000
#: Reduce tasks grow with the input up to here; beyond, a task takes several partitions or blocks, one after the other.
MOST_TASKS = 20_000
DISCOUNTED = 5
END = np.uint64(0xE0D0E0D0E0D0E0D1)
#: The number of what stands before a text; words of training text have greater numbers, other words 0.
START = np.uint64(1)
_K1, _K2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def pack(x: np.ndarray) -> bytes:
    """Byte by byte of the numbers, so that leading zeros and like bytes come together."""
    planes = np.ascontiguousarray(x).reshape(-1).view(np.uint8).reshape(-1, x.dtype.itemsize).T
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, kind, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def pack_runs(head: np.ndarray, then: np.ndarray) -> tuple[bytes, bytes]:
    """Pairs sorted by head, then: (heads and how many pairs each has, the rest), as differences."""
    first = np.flatnonzero(np.r_[True, head[1:] != head[:-1]])
    step = then.copy()
    step[1:] -= then[:-1]
    step[first] = then[first]
    return len(first).to_bytes(8, "little") + pack(np.r_[np.diff(head[first], prepend=np.uint64(0)), np.diff(np.r_[first, len(head)]).astype(np.uint64)]), pack(step)


def unpack_runs(heads: bytes, rest: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(each head once, head of each pair, the rest)."""
    k = int.from_bytes(heads[:8], "little")
    both = unpack(heads[8:], np.uint64, 2 * k)
    once, sizes = np.cumsum(both[:k], dtype=np.uint64), both[k:].astype(np.int64)
    step = unpack(rest, np.uint64, n)
    run = np.cumsum(step, dtype=np.uint64)
    first = np.cumsum(sizes) - sizes
    return once, np.repeat(once, sizes), run - np.repeat(run[first] - step[first], sizes)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _K1 + mix(b) * _K2)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """By range of the hash: sorted hashes give slices."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def make_blocks(docs: DataFrame) -> DataFrame:
    """docs: id, text, train. Blocks of whole documents."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = made = 0
        task = TaskContext.get().partitionId()

        def block() -> pa.RecordBatch:
            nonlocal held, size, made
            ids = pa.concat_arrays([h[0] for h in held])
            train = np.concatenate([h[1] for h in held])
            tokens, lengths = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
            uniq, index = np.unique(tokens, return_inverse=True)
            counts = np.bincount(index[np.repeat(train, lengths)], minlength=len(uniq))
            row = [[task << 24 | made], [len(ids)], [len(uniq)], [len(tokens)], [ids.to_pylist()], [pack(train)], [pack(lengths)], [uniq.tobytes()], [pack(index.astype(np.uint32))], [pack(counts.astype(np.uint32))]]
            held, size, made = [], 0, made + 1
            kinds = [pa.int64()] * 4 + [pa.list_(ids.type)] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["block", "n_docs", "n_words", "n_tokens", "ids", "train", "lengths", "words", "tokens", "counts"])

        for batch in pieces(batches):
            hashes, _, first = words(*utf8(batch.column("text")))
            lengths = np.diff(first) + 1
            ends = np.cumsum(lengths)
            tokens = np.full(int(ends[-1]), END, np.uint64)
            inner = np.ones(len(tokens), bool)
            inner[ends - 1] = False
            tokens[inner] = hashes
            held.append((batch.column("id"), batch.column("train").to_numpy(zero_copy_only=False).astype(bool), tokens, lengths))
            size += len(tokens)
            if size >= BLOCK_TOKENS:
                yield block()
        if held:
            yield block()

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"block long, n_docs long, n_words long, n_tokens long, ids array<{kind}>, train binary, lengths binary, words binary, tokens binary, counts binary")


_ASK = "part long, block long, n long, keys binary, more binary, counts binary"


def ask_words(blocks: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.frombuffer(row["words"], np.uint64)
                counts = unpack(row["counts"], np.uint32, len(keys))
                cut = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
                live = [p for p in range(parts) if cut[p] < cut[p + 1]]
                yield _rows(_ASK, [(p, row["block"], int(cut[p + 1] - cut[p]), keys[cut[p] : cut[p + 1]].tobytes(), b"", pack(counts[cut[p] : cut[p + 1]])) for p in live])

    return blocks.select("block", "words", "counts").mapInArrow(run, _ASK)


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "int": pa.int32()}
    named = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in named]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(columns, named, strict=True)], [n for n, _ in named])


#: block -1: the table itself (keys by number, counts); block -2: sums (tokens, distinct, counts of counts), for bigrams with the histories' statistics
_TABLE = "part long, block long, n long, keys binary, counts binary, sums binary"


def answer_words(table: pa.Table, parts: int) -> pa.Table:
    rows = table.to_pylist()
    keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
    counts = np.concatenate([unpack(r["counts"], np.uint32, r["n"]) for r in rows]).astype(np.int64)
    uniq, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(uniq), np.int64)
    np.add.at(total, at, counts)
    seen, part = total > 0, rows[0]["part"]
    order = np.argsort(-total, kind="stable")[: int(seen.sum())]
    ids = np.zeros(len(uniq), np.uint64)
    ids[order] = numbers(len(order), part, parts)
    told, named, k, out = total[at], ids[at], 0, []
    for r in rows:
        out.append((part, r["block"], r["n"], pack(named[k : k + r["n"]]), pack(told[k : k + r["n"]]), b""))
        k += r["n"]
    out.append((part, -1, len(order), uniq[order].tobytes(), pack(total[order]), b""))
    sums = np.r_[total.sum(), seen.sum(), [(total == r).sum() for r in range(1, DISCOUNTED + 2)]].astype(np.int64)
    out.append((part, -2, 0, b"", b"", sums.tobytes()))
    return pa.Table.from_batches([_rows(_TABLE, out)])


def numbers(n: int, part: int, parts: int) -> np.ndarray:
    """Of a partition's n training words: unique over all partitions."""
    return np.arange(n, dtype=np.uint64) * np.uint64(parts) + np.uint64(part + 2)


def discounts(of: np.ndarray) -> np.ndarray:
    """Factor by count 0..5 (of[r - 1] counts occur r times); 1 from 6 on isn't listed."""
    k, out = DISCOUNTED, np.ones(DISCOUNTED + 1)
    n = of.astype(float)
    common = (k + 1) * n[k] / n[0] if n[0] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common) if n[r - 1] and common < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def discounted(count: np.ndarray, factor: np.ndarray) -> np.ndarray:
    return count * np.where(count <= DISCOUNTED, factor[np.minimum(count, DISCOUNTED)], 1.0)


def block_words(answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(counts, numbers) of a block's words, in its own order: words are sorted by hash, and so are partitions."""
    answers = sorted(answers, key=lambda a: a["part"])
    return np.concatenate([unpack(a["counts"], np.int64, a["n"]) for a in answers]), np.concatenate([unpack(a["keys"], np.uint64, a["n"]) for a in answers])


def block_pairs(row: dict, names: np.ndarray, hot: np.ndarray, parts: int):
    """Distinct bigrams of a block (history index, the last at a start; word index; count in training), those to ask for, by part, history, word; ends of parts; each token's bigram; lengths."""
    n_words = row["n_words"]
    tokens = unpack(row["tokens"], np.uint32, row["n_tokens"]).astype(np.int64)
    lengths = unpack(row["lengths"], np.int64, row["n_docs"])
    train = unpack(row["train"], bool, row["n_docs"])
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(lengths) - lengths] = n_words  # the start
    uniq, which = np.unique(before * (n_words + 1) + tokens, return_inverse=True)
    counts = np.bincount(which[np.repeat(train, lengths)], minlength=len(uniq))
    left, right = uniq // (n_words + 1), uniq % (n_words + 1)
    asked = (names[left] > 0) & (names[right] > 0)
    # a history that stands here only before unknown words is asked for with one of them, so that its statistics come; hot ones come anyway
    bare = (names > 0) & ~np.isin(names, hot)
    bare[left[asked]] = False
    asked |= bare[left] & (np.diff(left, prepend=-1) > 0)
    asked = np.flatnonzero(asked)
    h, w = names[left[asked]], names[right[asked]]
    at = np.minimum(np.searchsorted(hot, h), max(len(hot) - 1, 0))
    is_hot = (hot[at] == h) if len(hot) else np.zeros(len(h), bool)
    part = part_of(np.where(is_hot, pair_key(h, w), mix(h)), parts)
    order = np.lexsort((w, h, part))
    return left, right, counts, asked[order], np.searchsorted(part[order], np.arange(parts + 1)), which, lengths


def dealt(rows: DataFrame, key: str, n: int):
    """Rows grouped by a key of n values, in as many tasks: what a task reads doesn't grow with the input, whatever the session's setting."""
    return rows.repartition(max(1, min(n, MOST_TASKS)), key).groupBy(key)


def meet(blocks: DataFrame, answers: DataFrame, n: int, run, schema: str) -> DataFrame:
    """Each of n blocks with its answers, one block at a time."""
    return dealt(blocks, "block", n).cogroup(dealt(answers, "block", n)).applyInArrow(run, schema)


def ask_pairs(blocks: DataFrame, answers: DataFrame, n: int, parts: int, hot: np.ndarray) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            row = left.to_pylist()[0]
            known, names = block_words(right.to_pylist())
            names = np.r_[names, START]
            a, b, counts, order, ends, *_ = block_pairs(row, names, hot, parts)
            for p in range(parts):
                own = order[ends[p] : ends[p + 1]]
                if len(own):
                    heads, rest = pack_runs(names[a[own]], names[b[own]])
                    c = counts[own]
                    out.append((p, row["block"], len(own), rest, heads, pack(np.r_[c, np.where(c > 0, known[b[own]], 0)].astype(np.uint64))))
        return pa.Table.from_batches([_rows(_ASK, out)])

    return meet(blocks, answers, n, run, _ASK)


def answer_pairs(table: pa.Table, factor: np.ndarray, train_tokens: int) -> pa.Table:
    """Counts for each block, and for each history that a block asked about here, in the order in which it asked: followers counted 1 to 5 times
    and the total of greater counts (in `keys`), and the unigram probability of all followers (in `sums`)."""
    rows = table.select(["part", "block", "n", "keys", "more", "counts"]).to_pylist()
    once, left, right, counts, known = [], [], [], [], []
    for r in rows:
        own, h, w = unpack_runs(r["more"], r["keys"], r["n"])
        once.append(own)
        left.append(h)
        right.append(w)
        both = unpack(r["counts"], np.uint64, 2 * r["n"]).astype(np.int64)
        counts.append(both[: r["n"]])
        known.append(both[r["n"] :])
    left, right, counts, known = map(np.concatenate, (left, right, counts, known))
    uniq, one, at = np.unique(pair_key(left, right), return_index=True, return_inverse=True)
    total, c2 = np.zeros(len(uniq), np.int64), np.zeros(len(uniq), np.int64)
    np.add.at(total, at, counts)
    np.maximum.at(c2, at, known)
    heads, place = np.unique(left[one], return_inverse=True)
    stats = np.zeros((len(heads), DISCOUNTED + 2))
    seen = total > 0
    for r in range(1, DISCOUNTED + 1):
        stats[:, r - 1] = np.bincount(place[seen & (total == r)], minlength=len(heads))
    stats[:, DISCOUNTED] = np.bincount(place, np.where(total > DISCOUNTED, total, 0), len(heads))
    stats[:, DISCOUNTED + 1] = np.bincount(place, np.where(seen, discounted(c2, factor) / train_tokens, 0), len(heads))
    told, k, out = total[at], 0, []
    for r, asked in zip(rows, once, strict=True):
        own = stats[np.searchsorted(heads, asked)].T
        out.append((r["part"], r["block"], r["n"], pack(own[:-1].astype(np.int64)), pack(told[k : k + r["n"]]), pack(own[-1])))
        k += r["n"]
    sums = np.r_[0, 0, [(total == r).sum() for r in range(1, DISCOUNTED + 2)]].astype(np.int64)
    out.append((rows[0]["part"], -2, len(heads), pack(heads), pack(stats), sums.tobytes()))
    return pa.Table.from_batches([_rows(_TABLE, out)])


def backoff(stats: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(denominators, backoff weights) of histories: the mass that discounts leave, over the unigram mass that followers leave."""
    r = np.arange(1, DISCOUNTED + 1)
    low = stats[:, :DISCOUNTED] * r
    count = low.sum(1) + stats[:, DISCOUNTED]
    given = (low * factor[1:]).sum(1) + stats[:, DISCOUNTED]
    denominator = np.where(count - given > 1e-9, count, count + 1)
    rest = np.maximum(1 - stats[:, DISCOUNTED + 1], 1e-12)
    return denominator, np.where(count > 0, (1 - given / np.maximum(denominator, 1)) / rest, 1.0)


def _sums(table: DataFrame) -> np.ndarray:
    total = np.zeros(DISCOUNTED + 3, np.int64)
    for r in table.filter("block = -2").select("sums").toLocalIterator():  # 64 bytes for each partition
        total += np.frombuffer(r["sums"], np.int64)
    return total


def score_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", folds: int = 5, held_out: int = 1) -> DataFrame:
    """For each row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    with_column_free(docs, id_column, text_column)
    spark = docs.sparkSession
    tables = Tables(spark, "katz")
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.coalesce(fold(F.col(id_column), folds) != held_out, F.lit(False)).alias("train"))
    blocks = tables.write(make_blocks(rows), "blocks")
    n_tokens, n_blocks = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    parts = max(1, -(-n_tokens // PART_TOKENS))
    word_table = tables.write(dealt(ask_words(blocks, parts), "part", parts).applyInArrow(lambda t: answer_words(t, parts), _TABLE), "words")
    sums = _sums(word_table)
    train_tokens, distinct = int(sums[0]), int(sums[1])
    factor = discounts(sums[2:])
    hot = np.zeros(0, np.uint64)
    if train_tokens:
        hot = _hot(word_table, train_tokens, parts)
    answers = word_table.filter("block >= 0").select("block", "part", "n", "counts", "keys")
    texts = blocks.select("block", "n_docs", "n_words", "n_tokens", "train", "lengths", "tokens")
    pair_table = dealt(ask_pairs(texts, answers, n_blocks, parts, hot), "part", parts).applyInArrow(lambda t: answer_pairs(t, factor, max(train_tokens, 1)), _TABLE)
    pair_table = tables.write(pair_table, "pairs")
    pair_factor = discounts(_sums(pair_table)[2:])
    hot_stats = _hot_stats(pair_table, hot)
    none = F.lit(None).cast("binary")
    both = answers.select("block", "part", "n", "counts", "keys", none.alias("sums")).union(pair_table.filter("block >= 0").select("block", "part", "n", "counts", "keys", "sums"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, told = left.to_pylist()[0], right.to_pylist()
        known, names = block_words([t for t in told if t["sums"] is None])
        told = [t for t in told if t["sums"] is not None]
        names = np.r_[names, START]
        a, b, _, order, ends, which, lengths = block_pairs(row, names, hot, parts)
        counts = np.zeros(len(a), np.int64)
        stats = np.zeros((len(names), DISCOUNTED + 2))
        for t in told:
            own = order[ends[t["part"]] : ends[t["part"] + 1]]
            counts[own] = unpack(t["counts"], np.int64, t["n"])
            own = a[own]
            own = own[np.r_[True, own[1:] != own[:-1]]]
            stats[own, :-1] = unpack(t["keys"], np.int64, (DISCOUNTED + 1) * len(own)).reshape(-1, len(own)).T
            stats[own, -1] = unpack(t["sums"], np.float64, len(own))
        if len(hot):
            at = np.minimum(np.searchsorted(hot, names), len(hot) - 1)
            is_hot = hot[at] == names
            stats[is_hot] = hot_stats[at[is_hot]]
        denominator, weight = backoff(stats, pair_factor)
        single = discounted(known, factor) / max(train_tokens, 1)
        unknown = max(1 - sums_mass, 1e-12)
        single = np.where(known > 0, single, unknown)
        with np.errstate(divide="ignore"):
            p = np.where(counts > 0, discounted(counts, pair_factor) / np.maximum(denominator[a], 1), weight[a] * single[b])
            log = np.log10(np.maximum(p, 1e-300))[which]
        index = unpack(row["tokens"], np.uint32, row["n_tokens"]).astype(np.int64)
        base = np.log10((known + 0.5) / (train_tokens + 0.5 * (distinct + 1)))[index]
        first = np.cumsum(lengths) - lengths
        n = len(lengths)
        add = lambda x: np.add.reduceat(x, first)
        return pa.table({"id": pa.array(row["ids"], left.schema.field("ids").type.value_type), "n_tokens": pa.array(lengths), "n_known": pa.array(add((known > 0)[index].astype(np.int64))), "train_tokens": pa.array(np.full(n, train_tokens, np.int64)), "base_score": pa.array(add(base)), "score": pa.array(add(log))})

    # unigram mass that is given away to seen words: by counts of counts, so it needs no table
    low = sums[2 : 2 + DISCOUNTED] * np.arange(1, DISCOUNTED + 1)
    sums_mass = 1 - float((low * (1 - factor[1:])).sum()) / max(train_tokens, 1)
    out = meet(blocks.drop("words", "counts"), both, n_blocks, run, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    score = F.col("score") if train_tokens else F.lit(None).cast("double")
    held = F.coalesce(fold(F.col("id"), folds) == held_out, F.lit(True))
    return out.select(F.col("id").alias(id_column), held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", score.alias("score"))


def _hot(word_table: DataFrame, train_tokens: int, parts: int) -> np.ndarray:
    """Numbers of histories that stand for over a thousandth of training tokens: fewer than 1000; and the start, which stands before every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                named = numbers(r["n"], r["part"], parts)
                yield pa.RecordBatch.from_arrays([pa.array(named[unpack(r["counts"], np.int64, r["n"]) * 1000 > train_tokens].view(np.int64))], ["h"])

    found = word_table.filter("block = -1").select("part", "n", "counts").mapInArrow(run, "h long").collect()
    return np.unique(np.array([int(START), *[r["h"] for r in found]], np.int64).view(np.uint64))


def _hot_stats(pair_table: DataFrame, hot: np.ndarray) -> np.ndarray:
    """Statistics of hot histories, summed over partitions: 1000 rows at most."""
    width = DISCOUNTED + 2
    out = np.zeros((len(hot), width))
    if not len(hot):
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                heads, stats = unpack(r["keys"], np.uint64, r["n"]), unpack(r["counts"], np.float64, r["n"] * width).reshape(-1, width)
                own = np.isin(heads, hot)
                yield pa.RecordBatch.from_arrays([pa.array(heads[own].view(np.int64)), *[pa.array(x) for x in stats[own].T]], ["h", *[f"s{i}" for i in range(width)]])

    columns = [f"s{i}" for i in range(width)]
    rows = pair_table.filter("block = -2").select("n", "keys", "counts").mapInArrow(run, ", ".join(["h long", *[f"{c} double" for c in columns]]))
    for r in rows.groupBy("h").agg(*[F.sum(c).alias(c) for c in columns]).collect():
        out[np.searchsorted(hot, np.uint64(r["h"]))] = [r[c] for c in columns]
    return out
