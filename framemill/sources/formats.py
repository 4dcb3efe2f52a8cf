"""Readers and writers by file name."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_READERS: dict[str, Callable[[SparkSession, str, dict], DataFrame]] = {}
_WRITERS: dict[str, Callable[[DataFrame, str, dict], None]] = {}
_PACKINGS = (".gz", ".bz2", ".zst", ".zstd", ".lz4", ".snappy", ".deflate")


def register(*suffixes: str, read=None, write=None) -> None:
    """Add or replace the reader and writer of file suffixes."""
    for s in suffixes:
        if read:
            _READERS[s] = read
        if write:
            _WRITERS[s] = write


def _by(fmt: str, **fixed):
    def read(spark: SparkSession, path: str, options: dict) -> DataFrame:
        schema = options.pop("schema", None)
        reader = spark.read.format(fmt).options(**{**fixed, **options})
        return (reader.schema(schema) if schema is not None else reader).load(path)

    return read


def _to(fmt: str, **fixed):
    def write(df: DataFrame, path: str, options: dict) -> None:
        mode = options.pop("mode", "errorifexists")
        df.write.format(fmt).mode(mode).options(**{**fixed, **options}).save(path)

    return write


register(".parquet", ".pq", read=_by("parquet"), write=_to("parquet", compression="zstd"))
register(".jsonl", ".ndjson", read=_by("json"), write=_to("json"))
register(".json", read=_by("json", multiLine="true"), write=_to("json"))
register(".csv", read=_by("csv", header="true", mode="PERMISSIVE"), write=_to("csv", header="true"))
register(".tsv", read=_by("csv", header="true", sep="\t"), write=_to("csv", header="true", sep="\t"))
register(".orc", read=_by("orc"), write=_to("orc"))
register(".txt", ".log", ".yaml", ".yml", read=_by("text"), write=_to("text"))
register(".jpg", ".jpeg", ".png", ".mp4", ".npy", ".npz", ".pkl", ".tar", ".bin", read=_by("binaryFile"))


def suffix_of(path: str) -> str:
    """The suffix that names the format, compression suffixes left aside."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for p in _PACKINGS:
        if name.endswith(p):
            name = name[: -len(p)]
            break
    return "." + name.rsplit(".", 1)[-1] if "." in name else ""


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read a path by its suffix; any scheme that the cluster's file systems know will do."""
    suffix = suffix_of(path)
    if suffix not in _READERS:
        raise ValueError(f"no reader for {path!r}")
    return _READERS[suffix](spark, path, dict(options))


def dump(df: DataFrame, path: str, **options) -> None:
    suffix = suffix_of(path)
    if suffix not in _WRITERS:
        raise ValueError(f"no writer for {path!r}")
    _WRITERS[suffix](df, path, dict(options))


def with_retries(action: Callable, transient: tuple[type[BaseException], ...], retries: int = 5, delay: float = 0.5):
    """Run a driver-side action again on transient errors, found anywhere in the chain of causes, with doubling pauses. Tasks are retried by the cluster."""
    for k in range(retries + 1):
        try:
            return action()
        except Exception as e:
            cause: BaseException | None = e
            while cause is not None and not isinstance(cause, transient):
                cause = cause.__cause__ or cause.__context__
            if cause is None or k == retries:
                raise
            time.sleep(delay * 2**k)


class Progress:
    """A file of what is done, replaced as a whole, so that a job that was stopped goes on where it was."""

    def __init__(self, path: str):
        self.path = path

    def load(self) -> dict:
        """The last saved state; an empty one where there is none."""
        store, at = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(at).type == fs.FileType.NotFound:
            return {}
        with store.open_input_stream(at) as f:
            return json.loads(f.read())

    def save(self, state: dict) -> None:
        store, at = fs.FileSystem.from_uri(self.path)
        with store.open_output_stream(f"{at}.tmp") as f:
            f.write(json.dumps(state).encode())
        store.move(f"{at}.tmp", at)
