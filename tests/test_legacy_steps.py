"""Record files of any length are written and read in steps, with the same records."""

from __future__ import annotations

import io
import tracemalloc

import pyarrow as pa
import pytest

from cellstore.sources import legacy


def test_steps_give_what_decode_gives():
    records = [(f"r{i}" * (i % 5), "ü" * (i % 3), i - 3, i % 4 == 0, None if i % 4 == 0 else b"v" * (i * 37 % 200)) for i in range(60)] + [("long", "", 1, False, bytes(5000)), ("last", "c", 2, True, None)]
    data = legacy.encode(records)
    for chunk in (1, 7, 64, 1000, 1 << 20):
        assert [r for rows in legacy.decode_steps(io.BytesIO(data), chunk) for r in rows] == records
    for cut in range(len(data) - 5040, len(data)):
        assert [r for rows in legacy.decode_steps(io.BytesIO(data[:cut]), 512) for r in rows] == list(legacy.decode(data[:cut]))
    assert list(legacy.decode_steps(io.BytesIO(b""))) == []


def test_memory_of_a_worker_does_not_grow_with_the_file(tmp_path):
    kinds = {"row_key": pa.string(), "column_key": pa.string(), "ts": pa.int64(), "deleted": pa.bool_(), "value": pa.binary()}
    given = lambda: (pa.RecordBatch.from_pydict({"row_key": [f"{k}-{i}" for i in range(1000)], "column_key": ["c"] * 1000, "ts": range(1000), "deleted": [False] * 1000, "value": [bytes(400)] * 1000}, pa.schema(kinds)) for k in range(60))
    tracemalloc.start()
    (told,) = legacy._encoded(given(), str(tmp_path), "part-0.sst")
    written, n = tracemalloc.get_traced_memory()[1], 0
    tracemalloc.reset_peak()
    for batch in legacy._decoded(iter([pa.RecordBatch.from_pydict({"path": [f"file:{tmp_path}/part-0.sst"]})])):
        assert batch.column("seq")[0].as_py() == n
        n += batch.num_rows
    seen = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_000 == told.column("records")[0].as_py() and told.column("bytes")[0].as_py() > 25_000_000
    assert written < 8_000_000 and seen < 8_000_000
    assert [p.name for p in tmp_path.iterdir()] == ["part-0.sst"]


def test_a_write_that_fails_leaves_no_file(tmp_path):
    batch = pa.RecordBatch.from_pydict({"row_key": ["k" * 70_000], "column_key": ["c"], "ts": [1], "deleted": [True], "value": pa.array([None], pa.binary())})
    with pytest.raises(ValueError):
        list(legacy._encoded(iter([batch]), str(tmp_path), "part-0.sst"))
    assert list(tmp_path.iterdir()) == []


@pytest.mark.parametrize("by_arrow", [True, False])
def test_files_of_spark_and_of_arrow_are_read_alike(spark, tmp_path, monkeypatch, by_arrow):
    at = tmp_path / "of records"
    at.mkdir()
    for k in range(3):
        (at / f"part-{k}.gz").write_bytes(legacy.encode([(f"{k}", "c", i, i % 2 == 1, None if i % 2 else b"v") for i in range(k * 10)]) + b"\0")
    if not by_arrow:
        monkeypatch.setattr(legacy, "_opens", lambda path: False)
    got = legacy.read(spark, str(at)).collect()
    assert sorted((r.row_key, r.seq, r.ts, r.entry_type) for r in got) == sorted((f"{k}", i, i, "DELETE" if i % 2 else "PUT") for k in range(3) for i in range(k * 10))
