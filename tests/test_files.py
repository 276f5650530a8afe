"""Image stack files: frame ranges, pushed filters, streams; ordered files with a commit."""

import json
import os
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from spectralake.sources import files, stacks

ROWS = [(shot, frame, y, [float(shot * 100 + frame * 10 + y + x) for x in range(4)])
        for shot, n in ((7, 5), (8, 1)) for frame in range(n) for y in range(3)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stacks"))
    stacks.write_stacks(spark.createDataFrame(ROWS, "shot long, frame long, y long, row array<double>"), path, frames=2)
    return path


def reader(path, *filters, **options):
    made = stacks.StackReader({"path": path, **options})
    assert list(made.pushFilters(list(filters))) == list(filters)
    return made


def test_scan_gives_what_was_written(spark, folder):
    assert sorted(os.listdir(folder)) == ["7_000000.stk", "7_000001.stk", "7_000002.stk", "8_000000.stk"]
    for frames in (1, 2, 64):
        got = stacks.scan_stacks(spark, folder, frames=frames)
        assert sorted(map(tuple, got.collect())) == sorted(ROWS)


def test_filters_drop_files_and_ranges(spark, folder):
    ranges = lambda *f, **o: [(p.shot, p.first, p.last) for p in reader(folder, *f, **o).partitions()]
    assert ranges() == [(7, 0, 1), (7, 2, 3), (7, 4, 4), (8, 0, 0)]
    assert ranges(frames=1) == [(7, f, f) for f in range(5)] + [(8, 0, 0)]
    assert ranges(EqualTo(("shot",), 8)) == [(8, 0, 0)]
    assert ranges(In(("shot",), (7, 9)), GreaterThan(("frame",), 2)) == [(7, 3, 3), (7, 4, 4)]
    assert ranges(LessThanOrEqual(("frame",), 0), EqualTo(("y",), 1)) == [(7, 0, 0), (8, 0, 0)]
    some = stacks.scan_stacks(spark, folder).where("shot = 7 and frame between 2 and 3 and y = 1")
    assert some.rdd.getNumPartitions() == 1
    assert sorted(map(tuple, some.collect())) == [r for r in ROWS if r[0] == 7 and r[1] in (2, 3) and r[2] == 1]
    assert stacks.scan_stacks(spark, folder).where("shot = 99").collect() == []


def test_newest_copy_counts_and_other_files_are_left(spark, tmp_path):
    def write(name, frames, value):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(stacks.RawStack.head(0, frames, 1, 2, "uint8") + bytes([value] * 2 * frames))
        return path

    old, new = write("a/5_x.stk", 3, 1), write("b/5_y.stk", 2, 9)
    os.utime(old, (time.time() - 100,) * 2)
    os.utime(new, (time.time(),) * 2)
    write("calib.stk", 1, 4)
    (tmp_path / "notes.txt").write_text("no stack")
    got = sorted(map(tuple, stacks.scan_stacks(spark, str(tmp_path), glob="*.stk").collect()))
    assert got == [(5, 0, 0, [9.0, 9.0]), (5, 1, 0, [9.0, 9.0])]


def test_large_files_stream(tmp_path):
    """Frames at the end of a file of 6 GB, a frame at a time: memory is that of a block."""
    head = stacks.RawStack.head(0, 300, 2160, 4800, "uint16")
    with open(tmp_path / "3_big.stk", "wb") as f:
        f.write(head)
        f.truncate(len(head) + 300 * 2160 * 4800 * 2)
    made = reader(str(tmp_path), GreaterThan(("frame",), 297))
    parts = made.partitions()
    assert [(p.first, p.last) for p in parts] == [(298, 299)]
    tracemalloc.start()
    rows = sum(batch.num_rows for batch in made.read(parts[0]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2 * 2160 and peak < 12 * stacks.BLOCK_BYTES


class Reversed(stacks.RawStack):
    """A caller's codec: rows from the right."""

    @staticmethod
    def rows(stream, header, first, last):
        for frame, y, block in stacks.RawStack.rows(stream, header, first, last):
            yield frame, y, block[:, ::-1]


def test_codec_of_the_caller(folder):
    codec = stacks.codec_of("spectralake.sources.stacks:RawStack")
    assert codec is stacks.RawStack
    made = reader(folder, EqualTo(("shot",), 8), codec=f"{__name__}:Reversed")
    rows = [r for p in made.partitions() for b in made.read(p) for r in b.to_pylist()]
    assert [(r["y"], r["row"]) for r in rows] == [(y, row[::-1]) for s, _, y, row in ROWS if s == 8]


def test_ordered_files(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(f"{k}.txt", i, f"{k}-{i}\n".encode()) for k in range(5) for i in range(50)]
    files.write_files(spark.createDataFrame(rows[::-1], "file string, part int, data binary").repartition(7), path)
    assert sorted(os.listdir(path)) == [f"{k}.txt" for k in range(5)]
    assert (tmp_path / "out" / "3.txt").read_text() == "".join(f"3-{i}\n" for i in range(50))
    files.write_files(spark.createDataFrame([], "file string, part int, data binary"), path)
    assert len(os.listdir(path)) == 5


def test_lost_attempts_leave_nothing(tmp_path):
    made = files._Writer(str(tmp_path / "out"))
    batch = pa.RecordBatch.from_pydict({"file": ["a", "a", "b"], "data": [b"1", b"2", b"3"]})
    made.write([batch])                      # an attempt whose message is lost
    kept = made.write([batch])
    assert not (tmp_path / "out" / "a").exists()
    made.commit([kept, None])
    assert sorted(os.listdir(tmp_path / "out")) == ["a", "b"] and (tmp_path / "out" / "a").read_bytes() == b"12"
    again = files._Writer(str(tmp_path / "out"))
    again.abort([again.write([batch])])
    assert sorted(os.listdir(tmp_path / "out")) == ["a", "b"]
    with pytest.raises(ValueError):
        files._Writer(str(tmp_path / "out")).write([pa.RecordBatch.from_pydict({"file": ["a", "b", "a"], "data": [b"1", b"2", b"3"]})])


def test_header_may_be_long():
    import io

    extra = json.dumps({"frames": 1, "height": 1, "width": 2, "dtype": "uint8", "note": "x" * 9000}).encode() + b"\n"
    stream = io.BytesIO(extra + bytes([1, 2]))
    head = stacks.RawStack.header(stream)
    assert head["at"] == len(extra) and [b.tolist() for *_, b in stacks.RawStack.rows(stream, head, 0, 0)] == [[[1, 2]]]
    assert np.dtype(head["dtype"]) == np.uint8


def test_frames_with_missing_and_repeated_rows(spark, tmp_path):
    """Lost rows and frames, a last frame that is cut short, rows that come twice and rows without pixels."""
    lost = {(0, 0), (0, 2), (1, 1), (4, 1), (4, 2)}
    rows = [(6, f, y, [float(f * 10 + y), 1.0]) for f in (0, 1, 2, 4) for y in range(3) if (f, y) not in lost]
    rows += [(6, 2, 1, [7.0, 8.0]), (9, 0, 0, [1.0, 2.0])]
    path = str(tmp_path / "ragged")
    given = spark.createDataFrame([*rows, (6, 0, 2, None)], "shot long, frame long, y long, row array<double>")
    stacks.write_stacks(given, path, frames=3)
    assert sorted(os.listdir(path)) == ["6_000000.stk", "6_000001.stk", "9_000000.stk"]
    for frames in (1, 2, 64):
        assert sorted(map(tuple, stacks.scan_stacks(spark, path, frames=frames).collect())) == sorted(rows)
    some = stacks.scan_stacks(spark, path, frames=2).where("shot = 6 and frame between 1 and 2").collect()
    assert sorted(map(tuple, some)) == sorted(r for r in rows if r[0] == 6 and r[1] in (1, 2))
