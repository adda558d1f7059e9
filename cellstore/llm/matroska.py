"""Media columns: Matroska files in a binary column, their packets as a table.

The writer stores 8-bit PCM samples losslessly: EBML header, Segment, Info, Tracks (one audio track), Clusters of
SimpleBlocks, Cues. Blocks hold up to eight packets; the lacing of a block is fixed-size if its packets are equally long, EBML
lacing otherwise (Xiph lacing can be asked for). The reader takes any such file: element ids and sizes of variable
length, unknown-size Segments and Clusters, SimpleBlocks and BlockGroups, the three lacings and none, and Cues. It gives one row for
each packet with track, time stamp, cluster, byte range, key flag and lacing.

Reading goes in steps: `packet_column` adds each file's packet table (and its cues) as a column, `packet_table` makes rows of it, and `read_back` takes the
payload by the byte ranges of those packets. `seek` uses the cues: it parses the Cluster that a cue names, and those behind it, up to a time.

A time stamp is in ticks of the file's scale (one millisecond here); packets after the first of a laced block go on by
the track's default duration. A broken file raises ValueError, or, with strict=False, gives the packets up to the break.

Defined cases: null counts as the empty text; a payload is padded with bytes 0 to a positive multiple of 64, so an empty text gives
64 bytes. Equal texts give equal files. Repeated rows are stored each; a null id stays null. A null file has no
packets. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import pieces, utf8, with_column_free

# Element ids of the EBML and Matroska specifications (RFC 8794, RFC 9559).
EBML, DOC_TYPE, DOC_VERSION, DOC_READ = 0x1A45DFA3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUX_APP, WRITE_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK, NUMBER, UID, TYPE, CODEC, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
LACING, AUDIO, RATE, CHANNELS, DEPTH = 0x9C, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
PARENTS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}

SAMPLE_RATE, PACKET, PER_BLOCK, BLOCKS_PER_CLUSTER = 8000, 800, 8, 10
LACINGS = {0: "none", 1: "xiph", 2: "fixed", 3: "ebml"}
PACKET_FIELDS = "packet int, track int, timestamp long, cluster int, start long, size long, keyframe boolean, lacing string"


# writing


def vint(value: int, width: int = 0) -> bytes:
    """An EBML variable-length integer; of all ones would mean an unknown size, so such a value takes a byte more."""
    width = max(width, 1)
    while value >= (1 << 7 * width) - 1:
        width += 1
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced(packets: list[bytes], kind: int) -> bytes:
    """The body of a block after its header, with a lace of this kind."""
    if kind == 0:
        return packets[0]
    sizes = [len(p) for p in packets]
    head = bytes([len(packets) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 3:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = 1
            while abs(b - a) >= (1 << 7 * width - 1) - 1:
                width += 1
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(packets)


_HEAD = element(EBML, element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ, 2))


def mux(payload: bytes, lacing: str = "auto", packet: int = PACKET) -> bytes:
    """A Matroska file with one 8-bit audio track that holds the payload."""
    ticks = packet * 1000 // SAMPLE_RATE
    audio = element(RATE, struct.pack(">d", SAMPLE_RATE)) + number(CHANNELS, 1) + number(DEPTH, 8)
    track = number(NUMBER, 1) + number(UID, 1) + number(TYPE, 2) + number(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, ticks * 1_000_000) + element(AUDIO, audio)
    info = number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / SAMPLE_RATE)) + element(MUX_APP, b"cellstore") + element(WRITE_APP, b"cellstore")
    parts = [element(INFO, info), element(TRACKS, element(TRACK, track))]
    at, cues = sum(map(len, parts)), []
    step = packet * PER_BLOCK
    for c in range(0, max(1, len(payload)), step * BLOCKS_PER_CLUSTER):
        time = c // packet * ticks
        body = [number(TIME, time)]
        for b in range(c, min(len(payload), c + step * BLOCKS_PER_CLUSTER), step):
            group = [payload[i : min(i + packet, b + step)] for i in range(b, min(len(payload), b + step), packet)]
            kind = {"none": 0, "xiph": 1, "fixed": 2, "ebml": 3}.get(lacing)
            if kind is None or kind == 2 and len(group[-1]) != len(group[0]):
                kind = 2 if len(group[-1]) == len(group[0]) else 3
            if len(group) == 1 or kind == 0:
                kind, group = 0, [b"".join(group)]
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", (b - c) // packet * ticks, 0x80 | kind << 1) + laced(group, kind)))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, number(CUE_TIME, time) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at) + number(CUE_RELATIVE, len(body[0])))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(parts))


# reading


def read_vint(data: bytes, at: int, end: int, keep_marker: bool = False) -> tuple[int, int, int]:
    """(value, width, where the next byte is); an unknown size is -1."""
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"a variable-length integer is cut off at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if not keep_marker:
        value &= (1 << 7 * width) - 1
        if value == (1 << 7 * width) - 1:
            value = -1
    return value, width, at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements between two bytes; one of unknown size reaches to the end or to the next Cluster or Cues."""
    while at < end:
        ident, _, at = read_vint(data, at, end, True)
        size, _, at = read_vint(data, at, end)
        if size < 0:
            stop = end
            if ident == CLUSTER:
                stop = at
                for child, _, b in elements(data, at, end):
                    if child in (CLUSTER, CUES):
                        break
                    stop = b
        else:
            stop = at + size
            if stop > end:
                raise ValueError(f"element {ident:x} at byte {at} reaches past its parent")
        yield ident, at, stop
        at = stop


def unlace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(start, size) of the packets in a block's body."""
    if kind == 0:
        return [(at, end - at)]
    if at >= end:
        raise ValueError("a lace has no count")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(count - 1):
            n = 0
            while at < end and data[at] == 255:
                n, at = n + 255, at + 1
            if at >= end:
                raise ValueError("a Xiph lace is cut off")
            sizes.append(n + data[at])
            at += 1
    elif kind == 3 and count > 1:
        n, _, at = read_vint(data, at, end)
        sizes.append(n)
        for _ in range(count - 2):
            raw, width, at = read_vint(data, at, end, True)
            n += (raw & (1 << 7 * width) - 1) - ((1 << 7 * width - 1) - 1)
            sizes.append(n)
    elif kind == 2:
        if (end - at) % count:
            raise ValueError("a fixed-size lace doesn't divide its block")
        sizes = [(end - at) // count] * (count - 1)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError("a lace is longer than its block")
    out = []
    for n in [*sizes, last]:
        out.append((at, n))
        at += n
    return out


class Layout:
    """Where the parts of a file are, from the heads of its top elements: bodies of Clusters aren't read."""

    def __init__(self, data: bytes, strict: bool = True):
        self.data, self.scale, self.durations = data, 1_000_000, {}
        self.clusters: list[tuple[int, int, int]] = []  # where the element starts, its body's start and end
        self.cues: list[tuple[int, int, int]] = []  # time, track, byte of the cluster
        try:
            for ident, a, b in elements(data, 0, len(data)):
                if ident == SEGMENT:
                    self._segment(a, b)
        except ValueError:
            if strict:
                raise

    def _number(self, a: int, b: int) -> int:
        return int.from_bytes(self.data[a:b], "big")

    def _segment(self, a: int, b: int) -> None:
        data, at = self.data, a
        for top, c, d in elements(data, a, b):
            if top == INFO:
                self.scale = next((self._number(x, y) for i, x, y in elements(data, c, d) if i == SCALE), self.scale)
            elif top == TRACKS:
                for i, x, y in elements(data, c, d):
                    if i == TRACK:
                        own = {j: self._number(p, q) for j, p, q in elements(data, x, y) if j in (NUMBER, DEFAULT_DURATION)}
                        self.durations[own.get(NUMBER, 0)] = own.get(DEFAULT_DURATION, 0)
            elif top == CLUSTER:
                self.clusters.append((at, c, d))
            elif top == CUES:
                for i, x, y in elements(data, c, d):
                    if i == CUE_POINT:
                        point = list(elements(data, x, y))
                        when = next((self._number(p, q) for j, p, q in point if j == CUE_TIME), 0)
                        for j, p, q in point:
                            if j == CUE_POSITIONS:
                                own = {k: self._number(r, s) for k, r, s in elements(data, p, q)}
                                self.cues.append((when, own.get(CUE_TRACK, 0), a + own.get(CUE_CLUSTER, 0)))
            at = d

    def packets_of(self, cluster: int, packets: list[tuple], strict: bool = True) -> bool:
        """Adds a Cluster's packets, as PACKET_FIELDS; false at a break, if that isn't an error."""
        data, time = self.data, 0
        _, c, d = self.clusters[cluster]

        def block(a: int, b: int, simple: bool) -> None:
            track, _, a = read_vint(data, a, b)
            if a + 3 > b:
                raise ValueError(f"a block is cut off at byte {a}")
            relative, flags = struct.unpack_from(">hB", data, a)
            kind = flags >> 1 & 3
            for k, (start, size) in enumerate(unlace(data, a + 3, b, kind)):
                packets.append((len(packets), track, time + relative + k * (self.durations.get(track, 0) // self.scale), cluster, start, size, bool(flags & 0x80) or not simple, LACINGS[kind]))

        try:
            for i, x, y in elements(data, c, d):
                if i == TIME:
                    time = self._number(x, y)
                elif i == SIMPLE_BLOCK:
                    block(x, y, True)
                elif i == BLOCK_GROUP:
                    for j, p, q in elements(data, x, y):
                        if j == BLOCK:
                            block(p, q, False)
        except ValueError:
            if strict:
                raise
            return False
        return True


def parse(data: bytes, strict: bool = True) -> tuple[list[tuple], list[tuple[int, int, int]]]:
    """(packets, cues) of a file; packets as PACKET_FIELDS, cues as (time, track, byte of the cluster)."""
    layout, packets = Layout(data, strict), []
    for k in range(len(layout.clusters)):
        if not layout.packets_of(k, packets, strict):
            break
    return packets, layout.cues


def seek(data: bytes, start: int, end: int) -> list[tuple]:
    """The packets with start <= time stamp < end, numbered from the first Cluster that is read: the one that the last cue up to start names (the
    first one without such a cue). Clusters from there on are parsed until one starts at the end or later; times don't go back from Cluster to Cluster."""
    layout, packets = Layout(data), []
    at = max((p for t, _, p in layout.cues if t <= start), default=-1)
    first = next((k for k, c in enumerate(layout.clusters) if c[0] == at), 0)
    for k in range(first, len(layout.clusters)):
        before = len(packets)
        layout.packets_of(k, packets)
        if len(packets) > before and packets[before][2] >= end:
            break
    return [p for p in packets if start <= p[2] < end]


def features(data: bytes, packets: list[tuple], n_cues: int, payload: bytes) -> str:
    """Of the file and its samples, in integers only: the same wherever it runs. `sought` is the checksum of the packets of the second half, by `seek`."""
    samples = np.frombuffer(payload, np.uint8)
    n = len(samples)
    total = int(samples.sum(dtype=np.int64))
    crossings = int(np.count_nonzero((samples[1:] >= 128) != (samples[:-1] >= 128)))
    clusters = packets[-1][3] + 1 if packets else 0
    last = packets[-1][2] if packets else 0
    sought = zlib.crc32(b"".join([data[p[4] : p[4] + p[5]] for p in seek(data, (last + 1) // 2, last + 1)])) if packets else 0
    return f"packets={len(packets)};clusters={clusters};cues={n_cues};last_ts={last};mean_milli={total * 1000 // max(1, n)};min={int(samples.min()) if n else 0};max={int(samples.max()) if n else 0};crossings={crossings};sought={sought}"


# operators


def store(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lacing: str = "auto") -> DataFrame:
    """For each row: id, n_bytes (of the text), media (the file)."""
    with_column_free(docs, id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = utf8(batch.column("text"))
            data, n = data.tobytes(), np.diff(offsets)
            files = [mux(data[a:b] + bytes(-(b - a) % 64 or (64 if a == b else 0)), lacing) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(files, pa.binary())], ["id", "n_bytes", "media"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_column)


_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
_NAMES = [f.split()[0] for f in PACKET_FIELDS.split(", ")]
_PACKETS = f"packets array<struct<{', '.join(':'.join(f.split()) for f in PACKET_FIELDS.split(', '))}>>, n_cues int"


def packet_column(media: DataFrame, id_column: str = "doc_id", media_column: str = "media", strict: bool = True) -> DataFrame:
    """For each file: id, n_bytes if media has that column, media, packets (an array of PACKET_FIELDS), n_cues."""
    with_column_free(media, id_column, media_column)
    kept = ["n_bytes"] if "n_bytes" in media.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 200):
                batch = whole.slice(i, 200)
                found = [parse(x, strict) if x is not None else ([], []) for x in batch.column("media").to_pylist()]
                flat = list(zip(*[p for x, _ in found for p in x], strict=True)) or [[] for _ in _NAMES]
                items = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(flat, _TYPES, strict=True)], _NAMES)
                bounds = pa.array(np.cumsum([0, *[len(x) for x, _ in found]]), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(bounds, items), pa.array([len(c) for _, c in found], pa.int32())], [*batch.schema.names, "packets", "n_cues"])

    rows = media.select(F.col(id_column).alias("id"), *kept, F.col(media_column).alias("media"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, {_PACKETS}").withColumnRenamed("id", id_column)


def packet_table(media: DataFrame, id_column: str = "doc_id", media_column: str = "media", strict: bool = True) -> DataFrame:
    """A row for each packet: id and PACKET_FIELDS; start and size are bytes of the file."""
    return packet_column(media, id_column, media_column, strict).select(F.col(id_column).alias("id"), F.explode("packets").alias("p")).select(F.col("id").alias(id_column), "p.*")


def read_back(media: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """For each file: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; by its packet table."""
    with_column_free(media, id_column, media_column, "n_bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for whole in batches:
            for i in range(0, len(whole), 200):
                batch, out = whole.slice(i, 200), []
                for data, told, n_cues in zip(batch.column("media").to_pylist(), batch.column("packets"), batch.column("n_cues").to_pylist(), strict=True):
                    data, items = data or b"", told.values
                    packets = list(zip(*[items.field(k).to_pylist() for k in range(len(_NAMES))], strict=True))
                    payload = b"".join([data[p[4] : p[4] + p[5]] for p in packets])
                    out.append((len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), sha256(data).hexdigest(), features(data, packets, n_cues, payload)))
                columns = list(zip(*out, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *[pa.array(v, k) for v, k in zip(columns, kinds, strict=True)]], ["id", "n_bytes", *names])

    rows = packet_column(media, id_column, media_column).withColumnRenamed(id_column, "id")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)
