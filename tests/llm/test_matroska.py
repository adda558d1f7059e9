"""Files against a small writer and reader of the format made here; packet rows, seeking, and long payloads."""

from __future__ import annotations

import hashlib
import struct
import zlib

import pytest

from cellstore.llm import matroska

SF = "/root/testdata/sf0.001"


def walk(data, at, end):
    """(id as hex, start, end) of elements, by the first byte's leading zeros."""
    while at < end:
        n = 9 - data[at].bit_length()
        name, at = data[at : at + n].hex(), at + n
        n = 9 - data[at].bit_length()
        size, at = int.from_bytes(data[at : at + n], "big") & (1 << 7 * n) - 1, at + n
        yield name, at, at + size
        at += size


def plain(data):
    """(packet slices, cluster and cue counts, last time) of a file that this library writes."""
    packets, clusters, cues, last = [], 0, 0, 0
    (_, a, b) = next(x for x in walk(data, 0, len(data)) if x[0] == "18538067")
    for name, c, d in walk(data, a, b):
        if name == "1c53bb6b":
            cues = sum(1 for _ in walk(data, c, d))
        if name != "1f43b675":
            continue
        clusters += 1
        time = 0
        for inner, x, y in walk(data, c, d):
            if inner == "e7":
                time = int.from_bytes(data[x:y], "big")
            elif inner == "a3":
                relative, flags = struct.unpack(">hB", data[x + 1 : x + 4])
                x += 4
                sizes = []
                if flags & 6:
                    count, x = data[x] + 1, x + 1
                    if flags & 6 == 4:
                        sizes = [(y - x) // count] * (count - 1)
                    else:
                        for k in range(count - 1):
                            n = 9 - data[x].bit_length()
                            raw, x = int.from_bytes(data[x : x + n], "big") & (1 << 7 * n) - 1, x + n
                            sizes.append(raw if not k else sizes[-1] + raw - (1 << 7 * n - 1) + 1)
                sizes.append(y - x - sum(sizes))
                for k, n in enumerate(sizes):
                    packets.append(data[x : x + n])
                    x += n
                    last = time + relative + 100 * k
    return packets, clusters, cues, last


def test_read_back_against_a_plain_reader(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10**6, None), (10**6 + 1, "x" * 200_001), (10**6 + 2, "ä" * 3200)], "doc_id long, text string"))
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    media = matroska.store(docs)
    files = {r.doc_id: bytes(r.media) for r in media.collect()}
    rows = matroska.read_back(media).collect()
    assert len(rows) == len(text)
    for r in rows:
        want = text[r.doc_id] + bytes(-len(text[r.doc_id]) % 64 or (0 if text[r.doc_id] else 64))
        data = files[r.doc_id]
        packets, clusters, cues, last = plain(data)
        half = sum(100 * k < (last + 1) // 2 for k in range(len(packets)))
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(want, want[1:], strict=False))
        feature = f"packets={len(packets)};clusters={clusters};cues={cues};last_ts={last};mean_milli={sum(want) * 1000 // len(want)};min={min(want)};max={max(want)};crossings={crossings};sought={zlib.crc32(b''.join(packets[half:]))}"
        assert b"".join(packets) == want and r.n_bytes == len(text[r.doc_id])
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(data), hashlib.sha256(data).hexdigest(), feature)
    told = {}
    for p in matroska.packet_table(media).collect():
        told.setdefault(p.doc_id, []).append((p.packet, p.start, p.size, p.timestamp))
    for i, data in files.items():
        assert [data[s : s + n] for _, s, n, _ in sorted(told[i])] == plain(data)[0]
        assert [t for *_, t in sorted(told[i])] == [100 * k for k in range(len(told[i]))]


def test_seek_reads_from_the_cue_on():
    payload = bytes(i * 31 % 256 for i in range(700_032))
    data = matroska.mux(payload)
    packets, cues = matroska.parse(data)
    assert len(cues) > 5
    for a, b in ((0, 100), (100, 900), (cues[3][0], cues[3][0] + 1), (cues[4][0] - 100, cues[4][0] + 100), (0, 10**9), (50, 60), (packets[-1][2], 10**9)):
        assert [p[1:3] + p[4:] for p in matroska.seek(data, a, b)] == [p[1:3] + p[4:] for p in packets if a <= p[2] < b]
    # bytes before the cue's cluster aren't read: breaking a block there doesn't matter
    broken = bytearray(data)
    broken[packets[0][4] - 4] = 0
    late = [p for p in packets if p[2] >= cues[5][0]]
    assert [p[4:6] for p in matroska.seek(bytes(broken), cues[5][0], 10**9)] == [p[4:6] for p in late]


def test_broken_files(spark):
    data = matroska.mux(b"\1" * 200_000)
    for cut in (10, 100, 70_000, len(data) - 3):
        with pytest.raises(ValueError):
            matroska.parse(data[:cut])
        packets, _ = matroska.parse(data[:cut], strict=False)
        assert all(p[4] + p[5] <= cut for p in packets)
    media = spark.createDataFrame([(1, None), (2, data[:-3]), (3, data)], "doc_id long, media binary")
    got = {r.doc_id: r["count"] for r in matroska.packet_table(media, strict=False).groupBy("doc_id").count().collect()}
    assert got == {3: 250}
