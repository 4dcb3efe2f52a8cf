"""Consolidating very many small files into few well-sized ones.

``concat_files`` joins real files listed in a manifest. ``compact_frames`` does the same for
frames whose small file is named by two columns, and keeps each frame once. Both work on
bytes (see ``bytejoin``): only the catalogue (paths, sizes, checksums, keys) is shuffled
apart from the one exchange that brings the lines of an output file together.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framemill.operators.bytejoin import BrokenPart, FrameJoin, TextJoin, check_part, read_back
from framemill.operators.frames import frame_rows
from framemill.operators.ordering import running_sum
from framemill.session import shared_dir, stored

MANIFEST = "bin bigint, path string, n_parts bigint, n_bytes bigint, n_lines bigint, crc bigint, source_bytes bigint"


def plan_bins(parts: DataFrame, target_bytes: int) -> DataFrame:
    """Add ``bin`` to parts (path, size_bytes, ...): consecutive paths whose sizes add up to about ``target_bytes``.

    The running sum is exact and distributed; a bin ends with the part that crosses the target,
    so it exceeds it by less than one part. Null sizes count as 0.
    """
    before = running_sum(parts, "size_bytes", [F.col("path")], "_before", "bins")
    return before.withColumn("bin", F.expr(f"_before div {int(target_bytes)}")).drop("_before")


def concat_files(parts: DataFrame, out_dir: str, target_bytes: int = 128 << 20, kind: str = "text", header: bool = False) -> DataFrame:
    """Join the files of ``parts`` (path string, size_bytes bigint, crc bigint) into files of about ``target_bytes``.

    ``kind`` is "text" (newline-delimited; ``header`` keeps a common first line once) or "zstd"
    (complete frames). Only the manifest is shuffled: each task streams its files from storage
    to storage. Repeated manifest rows of one path are read once; a null path is left out; files
    without bytes add nothing; a length or checksum that differs from a given one, a torn frame
    or a differing header fails the job with the file's name. An empty manifest gives an empty
    result. Returns one row per file written (see MANIFEST); output names carry the attempt, so
    a repeated task leaves no half-written file in the result.
    """
    clean = parts.where("path is not null").groupBy("path").agg(F.max("size_bytes").alias("size_bytes"), F.max("crc").alias("crc"))
    planned = plan_bins(clean, target_bytes).select("bin", "path", "size_bytes", "crc")
    run = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, joiner, out, name, n, source = None, None, None, "", 0, 0

        def close():
            out.close()
            store, base = fs.FileSystem.from_uri(out_dir)
            store.move(f"{base}/{name}.tmp", f"{base}/{name}")
            with store.open_input_stream(f"{base}/{name}", compression=None) as back:
                size, crc = 0, 0
                while chunk := back.read(1 << 20):
                    size, crc = size + len(chunk), zlib.crc32(chunk, crc)
            if (size, crc) != (joiner.size, joiner.crc):
                raise BrokenPart(f"{name}: what was written reads back differently")
            lines = joiner.lines if kind == "text" else None
            return [current, f"{out_dir}/{name}", n, joiner.size, lines, joiner.crc, source]

        rows = []
        for batch in batches:
            for bin_no, path, size, crc in zip(*(c.to_pylist() for c in batch.columns)):
                if bin_no != current:
                    if current is not None:
                        rows.append(close())
                    store, base = fs.FileSystem.from_uri(out_dir)
                    store.create_dir(base, recursive=True)
                    current, n, source = bin_no, 0, 0
                    name = f"part-{bin_no:08d}-{uuid.uuid4().hex}" + (".zst" if kind == "zstd" else "")
                    out = store.open_output_stream(f"{base}/{name}.tmp", compression=None)
                    joiner = TextJoin(out, header) if kind == "text" else FrameJoin(out)
                store_in, at = fs.FileSystem.from_uri(path)
                with store_in.open_input_stream(at, compression=None) as f:
                    data = f.read()
                check_part(data, size, crc, path)
                joiner.add(data, path)
                n, source = n + 1, source + len(data)
        if current is not None:
            rows.append(close())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[f.split()[0] for f in MANIFEST.split(", ")]).cast(_arrow(MANIFEST))

    tasks = planned.repartition("bin").sortWithinPartitions("bin", "path")
    return stored(tasks.mapInArrow(write, MANIFEST), f"manifest-{run}")


#: First line of the small text files that carry one.
HEADER = "# frames"


def write_small_files(frames: DataFrame, out_dir: str, kind: str = "text", header: bool = False) -> DataFrame:
    """Write each (chunk_index, file_index) of ``frames`` as a file of JSON lines: (path, size_bytes, crc), stored.

    ``kind`` is "text" (``header`` puts HEADER first) or "zstd" (a complete frame a file). Rows without a chunk or file share one. The layout that
    compaction finds: as many files as there are pairs, written by the tasks that hold them. Files carry the attempt in their name.
    """
    columns = [F.col(f"`{c}`") for c in frames.columns]
    rows = frames.select(F.coalesce("chunk_index", F.lit(-1)).alias("c"), F.coalesce("file_index", F.lit(-1)).alias("f"), F.concat(F.to_json(F.struct(*columns), _JSON), F.lit("\n")).alias("line"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(out_dir)
        pack = zstandard.ZstdCompressor(level=3, write_checksum=True).compress if kind == "zstd" else bytes
        made, current, held = [], None, []

        def close():
            data = pack(b"".join([f"{HEADER}\n".encode()] * header + held))
            name = f"{current[0]}/{current[1]}-{uuid.uuid4().hex}"
            store.create_dir(f"{base}/{current[0]}", recursive=True)
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(data)
            made.append((f"{out_dir}/{name}", len(data), zlib.crc32(data)))

        for batch in batches:
            for c, f, line in zip(*(x.to_pylist() for x in batch.columns)):
                if (c, f) != current:
                    if current is not None:
                        close()
                    current, held = (c, f), []
                held.append(line.encode("utf-8", "surrogatepass"))
        if current is not None:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], names=["path", "size_bytes", "crc"])

    sorted_rows = rows.repartition("c", "f").sortWithinPartitions("c", "f")
    return stored(sorted_rows.mapInArrow(write, "path string, size_bytes bigint, crc bigint"), "small")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])


RESULT = "kind string, path string, ep bigint, fr bigint, n_lines bigint, n_bytes bigint, n_stored bigint, crc bigint"

#: Nulls are written, and times to the microsecond, so that a line holds all of its row.
_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}

#: Bytes of text compressed into one zstandard frame of an output file.
_FRAME_BYTES = 4 << 20


def compact_frames(frames: DataFrame, episodes: DataFrame, out_dir: str | None = None, target_bytes: int = 64 << 20) -> DataFrame:
    """Rewrite the small files of ``frames`` into few files that hold each frame once.

    A small file is a (chunk_index, file_index); its lines are the JSON texts of its rows, in the
    order of their keys. Output files take consecutive small files, about ``target_bytes`` of text
    each, as complete zstandard frames. Which copy of a frame stays is decided on keys alone: the
    one with the fewest null columns, then the earliest ingested, then the lowest file. Where a
    file holds a copy that goes, its remaining line ranges are joined; a file without one is
    joined whole. Written files are read back and compared by length, line count and CRC-32.

    Returns rows of two kinds: 'file' (path, lines, bytes of text, size stored, checksum) and
    'dropped' (ep, fr of a line that another copy replaces). Rows without an identity (null
    episode, or no frame number) are kept as they are. Rows in no file (null chunk or file) sort
    first. Ties between equal copies keep one of them. Extra columns are carried along in the
    lines. An empty table gives no file and no rows.
    """
    spark = frames.sparkSession
    out_dir = out_dir or f"{shared_dir(spark)}/framemill-frames-{uuid.uuid4().hex}"
    columns = [F.col(f"`{c}`") for c in frames.columns]
    holes = reduce(lambda a, b: a + b, [c.isNull().cast("int") for c in columns])
    place = {"chunk": F.col("chunk_index"), "file": F.col("file_index"), "at": F.col("ingested_at"), "holes": holes}

    keys = frame_rows(frames, episodes, place).where("ep is not null and fr is not null")
    best = F.min(F.struct("holes", "at", "chunk", "file"))
    copied = keys.groupBy("ep", "fr").agg(F.count(F.lit(1)).alias("n"), best.alias("best")).where("n > 1")
    copied = copied.select("ep", "fr", F.col("best.chunk").alias("c"), F.col("best.file").alias("f"))
    # files that hold a frame without being the one that keeps it
    losers = keys.select("ep", "fr", "chunk", "file").join(copied, ["ep", "fr"]).where("not (chunk <=> c and file <=> f)")
    losers = stored(losers.select("chunk", "file", "ep", "fr").distinct(), "losers")

    n_rows, width = frames.count(), _line_width(frames, columns)
    n_files = max(1, -(-n_rows * width // target_bytes))
    # keys are read out of the record after the exchange, so that it moves each value once
    whole = frame_rows(frames, episodes, {"rec": F.struct(*columns), "holes": holes, "row": F.lit(1)})
    kinds = whole.schema["rec"].dataType
    known = {"episode_index": F.col("ep"), "chunk_index": F.col("chunk"), "file_index": F.col("file")}
    mark = F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])
    marks = losers.select("ep", "fr", mark.alias("rec"), F.lit(0).alias("holes"), F.lit(0).alias("row"))
    lines = whole.select("fr", "holes", "row", "rec").unionByName(marks.drop("ep"))
    chunk, file, ep = F.col("rec.chunk_index"), F.col("rec.file_index"), F.col("rec.episode_index")
    lines = lines.repartitionByRange(n_files, chunk, file).sortWithinPartitions(chunk, file, ep, "fr", "row", "holes", F.col("rec.ingested_at"))
    line = F.when(F.col("row") == 1, F.concat(F.to_json("rec", _JSON), F.lit("\n"))).otherwise("")
    lines = lines.select(chunk.alias("chunk"), file.alias("file"), ep.alias("ep"), "fr", "row", line.alias("line"))
    return lines.mapInArrow(_LineWriter(out_dir), RESULT)


def _line_width(frames: DataFrame, columns: list) -> int:
    """Average text bytes of a row, from at most 1,000 rows; it only sizes the output files."""
    few = frames.limit(1000).select(F.avg(F.length(F.to_json(F.struct(*columns)))).alias("w")).first()
    return int(few["w"] or 1) + 1


class _FrameSink:
    """Writes what it gets as complete zstandard frames of about _FRAME_BYTES of text."""

    def __init__(self, out):
        self.out, self.pending, self.held = out, [], 0
        self.packer = zstandard.ZstdCompressor(level=6, write_checksum=True, write_content_size=True)

    def write(self, data: bytes) -> None:
        self.pending.append(data)
        self.held += len(data)
        if self.held >= _FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.out.write(self.packer.compress(b"".join(self.pending)))
            self.pending, self.held = [], 0


class _LineWriter:
    """mapInArrow function: joins the small files of one partition into one file of zstandard frames."""

    def __init__(self, out_dir: str):
        self.out_dir = out_dir

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = join = None
        last: tuple | None = None  # key of the last row
        for batch in batches:
            if not batch.num_rows:
                continue
            keep, last, gone = _keep(batch, last)
            if n := len(gone[0]):
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(["dropped"] * n), pa.nulls(n, pa.string()), gone[0], gone[1], none, none, none, none], schema=_arrow(RESULT))
            if not keep.any():
                continue
            if out is None:
                store, base = fs.FileSystem.from_uri(self.out_dir)
                store.create_dir(base, recursive=True)
                name = f"{base}/frames-{uuid.uuid4().hex}.jsonl.zst"
                out = store.open_output_stream(name + ".tmp", compression=None)
                sink = _FrameSink(out)
                join = TextJoin(sink)
            for part in _parts(batch, keep):
                join.add(part)
        if out is not None:
            sink.flush()
            out.close()
            with store.open_input_stream(name + ".tmp", compression=None) as back:
                found = read_back(back)
            if found != (join.size, join.lines, join.crc):
                raise BrokenPart(f"{name}: {found} was read back, {(join.size, join.lines, join.crc)} was written")
            store.move(name + ".tmp", name)
            path = self.out_dir.rstrip("/") + name[len(base) :]
            row = ["file", path, None, None, join.lines, join.size, store.get_file_info(name).size, join.crc]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _arrow(RESULT))], schema=_arrow(RESULT))


def _parts(batch: pa.RecordBatch, keep: np.ndarray) -> Iterator[bytes]:
    """The bytes of each small file in a batch: one range of the text where all its lines stay, else the ranges that do."""
    text = batch.column(5) if keep.all() else batch.column(5).filter(pa.array(keep))
    chunk, file = (np.asarray(batch.column(i).fill_null(-(1 << 62)))[keep] for i in (0, 1))
    cuts = np.flatnonzero((chunk[1:] != chunk[:-1]) | (file[1:] != file[:-1])) + 1
    wide = pa.types.is_large_string(text.type)
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1]
    data = memoryview(text.buffers()[2])
    ends = offsets[[0, *cuts.tolist(), len(text)]].tolist()
    for lo, hi in zip(ends, ends[1:]):
        yield bytes(data[lo:hi])


def _keep(batch: pa.RecordBatch, last: tuple | None):
    """Which rows of a sorted batch stay: the first line of each key of each file, unless a mark precedes it."""
    known = batch.column(2).is_valid().to_numpy(zero_copy_only=False) & batch.column(3).is_valid().to_numpy(zero_copy_only=False)
    cols = [np.asarray(batch.column(i).fill_null(-(1 << 62))) for i in range(4)]
    is_line = np.asarray(batch.column(4)) == 1
    n = len(is_line)
    fresh = np.ones(n, bool)
    fresh[1:] = cols[0][1:] != cols[0][:-1]
    for c in cols[1:]:
        fresh[1:] |= c[1:] != c[:-1]
    key = tuple(int(c[0]) for c in cols)
    if last is not None and last == key:
        fresh[0] = False
    keep = is_line & (fresh | ~known)
    drop = is_line & ~keep
    gone = (batch.column(2).filter(pa.array(drop)), batch.column(3).filter(pa.array(drop)))
    return keep, tuple(int(c[-1]) for c in cols), gone
