"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

Pre-tokenisation finds the same pieces as the expression
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
without a regular expression. Code points become classes; an automaton of six states says what stands before each one (free,
bound to a run of symbols or a space, an apostrophe that starts a piece, the letters that may end a contraction). The text is
cut into lanes; each lane's transition function is found for all states at once, functions of lanes are composed by an
associative scan, and a second pass with known entry states gives the state at each code point. Boundaries follow from
state, class and the next two classes.

Each distinct piece is merged once per task (pairs of lowest rank first) and cached; the cache is emptied when it is full and at a task's end.
Ids keep the code-point offset at which their piece starts, so that decoded spans can be told. Ranks come from a file whose path is
a parameter; each worker reads it once.

Defined cases: null counts as the empty text: no ids, no bytes. Special tokens don't exist: their strings are ordinary
text. Repeated rows are encoded each; a null id stays null. An unknown id raises in decoding. An empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import SHORT, Spans, give_back, pieces, with_column_free

CACHE_PIECES = 150_000
#: Bytes of text that are encoded at once.
SLICE = 1 << 19
LANE = 128
#: Classes of code points.
EDGE, LETTER, SINGLE, EL, VR, EE, DIGIT, SYMBOL, APOS, BLANK, SPACE = range(11)
#: States: what stands before a code point.
FREE, BOUND, OPEN, OPEN_L, OPEN_VR, ENDED = range(6)


@cache
def classes() -> np.ndarray:
    """Class of every code point, in the Unicode version of the library whose results are to be met.

    Its encoder drops what a pattern doesn't match; with single bytes as its vocabulary, what it returns for all code points is
    the members of a class.
    """
    table = np.full(0x110001, SYMBOL, np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = ["".join(map(chr, points[i : i + 50_000])) for i in range(0, len(points), 50_000)]  # a slice at a time needs less memory
    single = {bytes([i]): i for i in range(256)}
    for kind, known in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (SPACE, r"\s")):
        one = tiktoken.Encoding("class", pat_str=known, mergeable_ranks=single, special_tokens={})
        for some in every:
            table[[ord(c) for c in bytes(one.encode_ordinary(some)).decode()]] = kind
    for letters, kind in (("sdmt", SINGLE), ("l", EL), ("vr", VR), ("e", EE), ("'", APOS), (" ", BLANK)):
        for c in letters:
            table[ord(c)] = kind
    table[0x110000] = EDGE
    return table


def transitions() -> np.ndarray:
    """Next state by class and state."""
    t = np.full((11, 6), FREE, np.uint8)
    t[[SYMBOL, BLANK]] = BOUND
    t[APOS] = OPEN
    t[APOS, [BOUND, OPEN]] = BOUND
    t[SINGLE, OPEN] = ENDED
    t[EL, OPEN], t[EL, OPEN_L] = OPEN_L, ENDED
    t[VR, OPEN] = OPEN_VR
    t[EE, OPEN_VR] = ENDED
    return t


_NEXT = transitions()


def states(kinds: np.ndarray) -> np.ndarray:
    """The state before each code point, by a scan over lanes."""
    n = len(kinds)
    lanes = -(-n // LANE)
    padded = np.full(lanes * LANE, EDGE, np.uint8)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(lanes, LANE).T)
    flat, width = _NEXT.ravel(), np.uint8(6)
    maps = np.broadcast_to(np.arange(6, dtype=np.uint8), (lanes, 6)).copy()
    for column in columns:  # each lane's function of all entry states
        maps = flat[(column * width)[:, None] + maps]
    step = 1
    while step < lanes:  # associative: maps[i] becomes the composition of all lanes up to i
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        step *= 2
    now = np.empty(lanes, np.uint8)
    now[0], now[1:] = FREE, maps[:-1, FREE]
    out = np.empty((LANE, lanes), np.uint8)
    for i, column in enumerate(columns):
        out[i] = now
        now = flat[column * width + now]
    return out.T.ravel()[:n]


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where pieces start. points: code points, with 0x110000 after each text (it is a piece of its own)."""
    kinds = classes()[points]
    state = states(kinds)
    n = len(kinds)
    before = np.empty(n, np.uint8)
    before[0], before[1:] = EDGE, kinds[:-1]
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = EDGE, kinds[1:]
    letter = (kinds >= LETTER) & (kinds <= EE)
    letter_before = (before >= LETTER) & (before <= EE)
    symbol, symbol_before = (kinds == SYMBOL) | (kinds == APOS), (before == SYMBOL) | (before == APOS)
    blank_before, white, white_before = before == BLANK, kinds >= BLANK, before >= BLANK
    white_after = (after >= BLANK) | (after == EDGE)
    contracted = (state == OPEN) & ((kinds == SINGLE) | ((kinds == EL) & (after == EL)) | ((kinds == VR) & (after == EE)))
    joined = letter & ((letter_before & (state != ENDED)) | contracted)
    joined |= (kinds == DIGIT) & (before == DIGIT)
    joined |= symbol & symbol_before
    joined |= (letter | (kinds == DIGIT) | symbol) & blank_before
    joined |= white & white_before & white_after
    return np.flatnonzero(~joined)


class Merger:
    """Merges pieces, pairs of lowest rank first, many at once; keeps what it has merged."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = np.fromiter((x for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks for x in (ranks[t[:i]] << 32 | ranks[t[i:]], r)), np.int64).reshape(-1, 2)
        self.keys, self.values = pairs[np.argsort(pairs[:, 0])].T.copy()
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}  # piece: place in the arena << 8 | ids
        self.arena, self.used = np.zeros(1 << 20, np.int32), 0

    def cost(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes; _NEVER if none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NEVER)

    def merge_all(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, how many each has). Each round merges the leftmost cheapest pair of every piece that has one."""
        lengths = np.array([len(x) for x in parts], np.int64)
        symbol = self.bytes[np.frombuffer(b"".join(parts), np.uint8)]
        piece = np.repeat(np.arange(len(parts)), lengths)
        cost = np.full(len(symbol), _NEVER, np.int64)
        cost[:-1] = np.where(piece[1:] == piece[:-1], self.cost(symbol[:-1], symbol[1:]), _NEVER)
        done = []
        while len(symbol):
            first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            best = np.repeat(np.minimum.reduceat(cost, first), np.diff(np.r_[first, len(symbol)]))
            over = best == _NEVER
            if over.any():
                done.append((piece[over], symbol[over]))
                live = ~over
                symbol, piece, cost, best = symbol[live], piece[live], cost[live], best[live]
                if not len(symbol):
                    break
            hit = np.flatnonzero(cost == best)
            hit = hit[np.r_[True, piece[hit[1:]] != piece[hit[:-1]]]]
            symbol[hit] = best[hit]
            stay = np.ones(len(symbol), bool)
            stay[hit + 1] = False
            symbol, piece, cost = symbol[stay], piece[stay], cost[stay]
            hit -= np.arange(len(hit))
            for at in (hit, hit[hit > 0] - 1):
                after = np.minimum(at + 1, len(symbol) - 1)
                cost[at] = np.where((after > at) & (piece[after] == piece[at]), self.cost(symbol[at], symbol[after]), _NEVER)
        piece, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(piece, kind="stable")
        return symbol[order].astype(np.int32), np.bincount(piece, minlength=len(parts))

    def merge_long(self, data: bytes) -> np.ndarray:
        """One piece, with a heap and links: n log n steps."""
        ranks, n = self.ranks, len(data)
        end, prev, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def rank(i: int) -> int | None:
            j = end[i]
            return ranks.get(data[i : end[j]]) if j < n else None

        heap = [(r, i, end[i], end[end[i]]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapify(heap)
        while heap:
            _, i, middle, stop = heappop(heap)
            if not live[i] or end[i] != middle or end[middle] != stop:
                continue
            live[middle], end[i] = False, stop
            if stop < n:
                prev[stop] = i
            for k in (i, prev[i]):
                if k >= 0 and (r := rank(k)) is not None:
                    heappush(heap, (r, k, end[k], end[end[k]]))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return np.array(out, np.int32)

    def keep(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros(len(self.arena), np.int32)])
        at = self.used
        self.arena[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def places(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Place in the arena and number of ids of each piece."""
        if len(self.known) > CACHE_PIECES or self.used > 8 * CACHE_PIECES:
            self.clear()
        codes = list(map(self.known.get, distinct))
        new, long = [], []
        for i, c in enumerate(codes):
            if c is None:
                data = distinct[i].encode()
                (new if len(data) <= LONG else long).append((i, data))
        at, count = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        if new:
            ids, counts = self.merge_all([d for _, d in new])
            place = self.keep(ids)
            for (i, _), n in zip(new, counts.tolist(), strict=True):
                codes[i] = self.known[distinct[i]] = place << 8 | n
                place += n
        for i, _ in long:
            codes[i] = 0
        told = np.array(codes, np.int64)
        at, count = told >> 8, told & 255
        for i, data in long:
            ids = self.merge_long(data)
            at[i], count[i] = self.keep(ids), len(ids)
        return at, count


_NEVER = 1 << 60
#: Bytes; a longer piece is merged on its own and not kept.
LONG = 200
_LOADED: dict[str, Merger] = {}
_BYTES: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def merger(path: str) -> Merger:
    """Read once by each worker."""
    if path not in _LOADED:
        _LOADED[path] = Merger(load_ranks(path))
        classes()
        give_back()
    return _LOADED[path]


def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(number of each id's bytes, 0 if there is no such id; all ids' bytes). Read once by each worker."""
    if path not in _BYTES:
        ranks = load_ranks(path)
        back = [b""] * (max(ranks.values()) + 1)
        for data, i in ranks.items():
            back[i] = data
        _BYTES[path] = np.array([len(x) for x in back], np.int64), np.frombuffer(b"".join(back), np.uint8)
    return _BYTES[path]


def distinct_pieces(spans: Spans) -> tuple[np.ndarray, np.ndarray]:
    """(index of one span of each content, which content each span has), told by the bytes themselves.

    Spans of up to seven bytes are their own keys; longer ones are keyed by hash and compared with the one that stands for their key. Should two
    contents share a key, all are told apart by a dictionary instead.
    """
    sizes = spans.sizes
    short = sizes < 8
    keys = spans.hashes() | np.uint64(1 << 63)
    keys[short] = spans.load(0, short) | sizes[short].astype(np.uint64) << np.uint64(56)
    _, one, which = np.unique(keys, return_index=True, return_inverse=True)
    own = np.flatnonzero(~short)
    other = one[which[own]]
    same = sizes[own] == sizes[other]
    for k in range(SHORT // 8):
        at = np.flatnonzero(same & (sizes[own] > 8 * k))
        same[at] = spans.load(k, own[at]) == spans.load(k, other[at])
    for i in np.flatnonzero(same & (sizes[own] > SHORT) & (own != other)).tolist():
        same[i] = spans.bytes_of(own[i]) == spans.bytes_of(other[i])
    if same.all():
        return one, which
    seen: dict[bytes, int] = {}
    which = np.array([seen.setdefault(spans.bytes_of(i), len(seen)) for i in range(len(sizes))], np.int64)
    return np.unique(which, return_index=True)[1], which


def encode_texts(texts: list[str], merge: Merger) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts, code-point offset in its text of each id's piece, where each text's ids end).

    Python handles each distinct piece of a batch once.
    """
    joined = "\x00".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint32)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64)) - 1
    widths = np.ones(len(points), np.int64)
    for least in (0x80, 0x800, 0x10000):
        widths += points >= least
    byte = np.r_[0, np.cumsum(widths)]
    points[ends] = 0x110000
    starts = boundaries(points)
    stops = np.r_[starts[1:], len(points)]
    real = points[starts] != 0x110000
    starts, stops = starts[real], stops[real]
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    one, which = distinct_pieces(Spans(np.frombuffer(joined.encode(), np.uint8), byte[starts], byte[stops]))
    at, count = merge.places([joined[a:b] for a, b in zip(starts[one].tolist(), stops[one].tolist(), strict=True)])
    counts = count[which]
    upto = np.cumsum(counts)
    ids = merge.arena[np.repeat(at[which] - (upto - counts), counts) + np.arange(upto[-1])]
    text = np.searchsorted(ends, starts, "right")
    offsets = np.repeat(starts - np.r_[0, ends + 1][text], counts).astype(np.int32)
    return ids, offsets, np.r_[0, upto][np.searchsorted(starts, ends)]


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row: id, ids array<int>, offsets array<int>."""
    with_column_free(docs, id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge = merger(path)
        for batch in pieces(batches, limit=SLICE):
            ids, offsets, ends = encode_texts([x or "" for x in batch.column("text").to_pylist()], merge)
            bounds = pa.array(np.r_[0, ends].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (ids, offsets)]], ["id", "ids", "offsets"])
        merge.clear()  # a worker goes on to other stages
        give_back()

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, offsets array<int>").withColumnRenamed("id", id_column)


def spell(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, np.ndarray]:
    """(what the table has for the ids, end to end; where each id's part ends). An id that the table lacks raises."""
    sizes, pool = table
    if len(ids) and (ids.min() < 0 or ids.max() >= len(sizes) or not sizes[ids].all()):
        raise ValueError("an id has no bytes in this vocabulary")
    ends = np.cumsum(sizes[ids])
    start = np.repeat((np.cumsum(sizes) - sizes)[ids] - (ends - sizes[ids]), sizes[ids])
    return pool[start + np.arange(len(start))].tobytes(), ends


def decode(tokens: DataFrame, path: str, ids_column: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for; null for null ids."""
    with_column_free(tokens, ids_column)
    names = tokens.columns
    place = names.index(ids_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(path)
        for whole in batches:
            for a in range(0, len(whole), 500):
                batch = whole.slice(a, 500)
                column = batch.column(place)
                data, ends = spell(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), table)
                counts = np.array([len(x) if x is not None else 0 for x in column], np.int64)
                bounds = np.r_[0, ends][np.cumsum(np.r_[0, counts])]
                out = [data[x:y] if ok else None for x, y, ok in zip(bounds, bounds[1:], column.is_valid().to_pylist(), strict=False)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, to])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema), f"`{to}` binary"])
    return tokens.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Digests of ids and of decoded bytes: id, n_tokens, ids_sha256, decoded_sha256.

    Encodes and decodes as `encode` and `decode` do, in one pass, so that ids needn't leave the worker.
    """
    with_column_free(docs, id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge, table = merger(path), vocabulary(path)
        known = [f"{i},".encode() for i in range(len(table[0]))]
        digits = np.array([len(x) for x in known], np.int64), np.frombuffer(b"".join(known), np.uint8)
        for batch in pieces(batches, limit=SLICE):
            ids, _, ends = encode_texts([x or "" for x in batch.column("text").to_pylist()], merge)
            ids, bounds, told = ids.astype(np.int64), np.r_[0, ends], []
            for part, cut in ((digits, 1), (table, 0)):
                data, at = spell(ids, part)
                at = np.r_[0, at][bounds].tolist()
                told.append([sha256(data[x : max(x, y - cut)]).hexdigest() for x, y in zip(at, at[1:], strict=False)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(bounds), pa.int64()), *[pa.array(x, pa.string()) for x in told]], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        merge.clear()
        give_back()

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_column)
