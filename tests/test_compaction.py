"""Byte-level joining: real files, and frames that lie in several small files."""

import io
import json
import os
import zlib
from datetime import datetime, timedelta

import pytest
import zstandard
from hypothesis import given
from hypothesis import strategies as st

from framemill.operators.bytejoin import BrokenPart, FrameJoin, TextJoin, check_part, frame_ends, read_back
from framemill.operators.compaction import compact_frames, concat_files


@given(st.lists(st.binary(max_size=200)))
def test_frames_are_found_where_they_end(parts):
    packer = zstandard.ZstdCompressor(level=1, write_checksum=True)
    frames = [packer.compress(p) for p in parts]
    data = b"".join(frames)
    ends = frame_ends(data)
    assert [b - a for a, b in zip([0, *ends], ends)] == [len(f) for f in frames]
    for cut in range(1, min(4, len(data))):
        with pytest.raises(BrokenPart):
            frame_ends(data[:-cut])


def test_skippable_frames_pass_and_other_bytes_do_not():
    skippable = (0x184D2A51).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc"
    assert frame_ends(skippable) == [11]
    with pytest.raises(BrokenPart):
        frame_ends(b"plain text")


def test_text_boundaries():
    out = io.BytesIO()
    join = TextJoin(out)
    for part in (b"a\nb", b"", b"\xef\xbb\xbfc\n", b"\xef\xbb\xbf", b"d"):
        join.add(part)
    assert out.getvalue() == b"a\nb\nc\nd\n"
    assert (join.size, join.lines, join.crc) == (8, 4, zlib.crc32(out.getvalue()))


def test_headers_are_kept_once_and_must_agree():
    out = io.BytesIO()
    join = TextJoin(out, header=True)
    for part in (b"x,y\n1,2", b"x,y\r\n3,4\n", b"x,y"):
        join.add(part)
    assert out.getvalue() == b"x,y\n1,2\n3,4\n"
    with pytest.raises(BrokenPart):
        join.add(b"y,x\n1,2\n", "odd")


def test_catalogue_is_checked():
    check_part(b"abc", 3, zlib.crc32(b"abc"))
    check_part(b"abc", None, None)
    for size, crc in ((2, None), (None, 1)):
        with pytest.raises(BrokenPart):
            check_part(b"abc", size, crc)


def _files(folder, contents):
    rows = []
    for i, data in enumerate(contents):
        path = folder / f"f{i:04d}"
        path.write_bytes(data)
        rows.append((f"file://{path}", len(data), zlib.crc32(data)))
    return rows


def test_text_files(spark, tmp_path):
    contents = [b"%d\n%d" % (i, i + 1) if i % 2 else b"%d\n" % i for i in range(50)] + [b""]
    rows = _files(tmp_path, contents)
    parts = spark.createDataFrame([*rows, rows[3], (None, 1, 1)], "path string, size_bytes bigint, crc bigint")
    out = tmp_path / "out"
    made = concat_files(parts, f"file://{out}", target_bytes=60).collect()
    lines = [x for r in made for x in open(r["path"][7:]).read().splitlines()]
    assert sorted(lines) == sorted(x for c in contents for x in c.decode().splitlines())
    assert sum(r["n_parts"] for r in made) == 51 and len(made) < 10
    assert all(os.path.getsize(r["path"][7:]) == r["n_bytes"] for r in made)
    assert not [f for f in os.listdir(out) if f.endswith(".tmp")]


def test_zstd_files(spark, tmp_path):
    packer = zstandard.ZstdCompressor()
    rows = _files(tmp_path, [packer.compress(b"line %d\n" % i) for i in range(20)])
    made = concat_files(spark.createDataFrame(rows, "path string, size_bytes bigint, crc bigint"), f"file://{tmp_path}/z", 10_000, "zstd").collect()
    assert len(made) == 1
    with open(made[0]["path"][7:], "rb") as f:
        assert read_back(f)[1] == 20


def test_a_wrong_checksum_fails(spark, tmp_path):
    rows = [(p, n, c + 1) for p, n, c in _files(tmp_path, [b"x\n"])]
    with pytest.raises(Exception, match="checksum"):
        concat_files(spark.createDataFrame(rows, "path string, size_bytes bigint, crc bigint"), f"file://{tmp_path}/bad").collect()


def test_no_files(spark, tmp_path):
    empty = spark.createDataFrame([], "path string, size_bytes bigint, crc bigint")
    assert concat_files(empty, f"file://{tmp_path}/none").collect() == []


def test_joined_zstd_frames():
    out = io.BytesIO()
    join = FrameJoin(out)
    join.add(zstandard.ZstdCompressor().compress(b"a\n"))
    with pytest.raises(BrokenPart, match="torn"):
        join.add(b"\x28\xb5\x2f\xfd\x20", "torn")
    assert join.frames == 1


FRAMES = "episode_index bigint, frame_index bigint, timestamp_s double, chunk_index bigint, file_index bigint, ingested_at timestamp, ep string, rec string, row int, `fr` double, `a b` array<float>"
EPISODES = "episode_index bigint, fps double, ep string"
T0 = datetime(2025, 1, 1)


def _row(e, i, t, c, f, at=0, note="n"):
    return (e, i, t, c, f, T0 + timedelta(seconds=at), note, "x\ny", 7, float("nan"), [1.0, None])


def _compacted(spark, rows, tmp_path, **kw):
    frames = spark.createDataFrame(rows, FRAMES)
    eps = spark.createDataFrame([(1, 10.0, "x"), (2, 20.0, None), (3, None, "y")], EPISODES)
    made = compact_frames(frames, eps, f"file://{tmp_path}/c", **kw).collect()
    lines = []
    for r in made:
        if r["kind"] == "file":
            with open(r["path"][7:], "rb") as f, zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True) as s:
                lines += [json.loads(x) for x in s.read().decode().splitlines()]
    return made, lines


def test_each_frame_once(spark, tmp_path):
    rows = [
        _row(1, 0, 0.0, 0, 0, note="first"),
        _row(1, 0, 0.0, 0, 1, at=5, note="late copy"),
        _row(1, None, 0.3, 0, 1, note="by time"),
        _row(1, 3, None, 0, 2, at=9, note="by number"),
        _row(2, 1, 0.05, 1, 0, note="same file"),
        _row(2, 1, 0.05, 1, 0, note="same file"),
        _row(3, None, 0.5, 1, 1, note="no rate"),
        _row(3, None, 0.5, 1, 1, note="no rate"),
        _row(None, 4, 0.1, 1, 1, note="no episode"),
        _row(2, None, float("nan"), 1, 2, note="no number"),
        _row(2, 9, 0.45, None, None, note="no file"),
    ]
    made, lines = _compacted(spark, rows, tmp_path)
    dropped = sorted((r["ep"], r["fr"]) for r in made if r["kind"] == "dropped")
    assert dropped == [(1, 0), (1, 3), (2, 1)]
    assert sorted(x["ep"] for x in lines) == sorted(["first", "by time", "same file", "no rate", "no rate", "no episode", "no number", "no file"])
    assert lines[0]["a b"] == [1.0, None] and lines[0]["rec"] == "x\ny"
    assert {x["ingested_at"] for x in lines} == {"2025-01-01 00:00:00.000000"}


def test_a_hot_frame(spark, tmp_path):
    rows = [_row(1, 5, 0.5, 0, k % 300, at=k) for k in range(900)] + [_row(2, k, k / 20, 1, k // 7) for k in range(400)]
    made, lines = _compacted(spark, rows, tmp_path, target_bytes=20_000)
    assert len(lines) == 401
    assert sum(r["kind"] == "dropped" for r in made) == 899
    files = [r for r in made if r["kind"] == "file"]
    assert len(files) > 2 and sum(r["n_lines"] for r in files) == 401


def test_no_frames(spark, tmp_path):
    assert _compacted(spark, [], tmp_path) == ([], [])
