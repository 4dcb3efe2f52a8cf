"""An episodic data set on storage: Parquet tables of frames, episodes and tasks, and a JSON record.

Layout: ``data/chunk=C/*.parquet`` (frames), ``meta/episodes``, ``meta/tasks``, ``meta/info.json``,
``meta/stats``. Frames are written sorted by episode and frame, so that row-group statistics prune
windows and episode subsets.
"""

from __future__ import annotations

import json
from functools import reduce

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framemill.operators.editing import union_common
from framemill.operators.episodic import numbered
from framemill.operators.ordering import running_sum
from framemill.operators.statistics import channels, merged_moments, moments
from framemill.session import broadcast_if_small

INFO = "meta/info.json"


def exists(path: str) -> bool:
    store, at = fs.FileSystem.from_uri(path)
    return store.get_file_info(at).type != fs.FileType.NotFound


def discover(paths: list[str]) -> list[str]:
    """Data-set roots under the paths: folders with a meta/info.json, not searched further, each once, sorted."""
    found: set[str] = set()
    for path in paths:
        store, base = fs.FileSystem.from_uri(path)
        scheme = path[: len(path) - len(base)] if path.endswith(base) else ""
        todo = [base.rstrip("/")]
        while todo:
            at = todo.pop()
            if store.get_file_info(f"{at}/{INFO}").type == fs.FileType.File:
                found.add(scheme + at)
                continue
            todo += [i.path for i in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if i.type == fs.FileType.Directory]
    return sorted(found)


class Episodes:
    """A lazy reader of one data set."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        store, at = fs.FileSystem.from_uri(f"{self.root}/{INFO}")
        with store.open_input_stream(at) as f:
            self.info = json.loads(f.read())

    def folders(self, what: str) -> list[str]:
        """The folders that hold the committed 'data', 'episodes' or 'tasks'."""
        return self.info.get(what) or ["data" if what == "data" else f"meta/{what}"]

    def _read(self, what: str) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), [self.spark.read.parquet(f"{self.root}/{f}") for f in self.folders(what)])

    def frames(self, columns: list[str] | None = None, episodes: list[int] | DataFrame | None = None) -> DataFrame:
        """Frames with the declared columns; a list of episodes is pushed into the scan, a DataFrame of them becomes a semi join."""
        df = self._read("data").drop("chunk")
        if isinstance(episodes, DataFrame):
            df = df.join(broadcast_if_small(episodes.select("episode_index").distinct(), 48), "episode_index", "left_semi")
        elif episodes is not None:
            df = df.where(F.col("episode_index").isin([int(e) for e in episodes]))
        return df.select(*columns) if columns else df

    def window(self, episode: int, start: int, stop: int, columns: list[str]) -> DataFrame:
        """Frames [start, stop) of one episode; the bounds are checked against the episode's length."""
        row = self.episodes().where(F.col("episode_index") == episode).select("length").first()
        if row is None or not 0 <= start < stop <= row["length"]:
            raise ValueError(f"[{start}, {stop}) is not within episode {episode}")
        df = self._read("data").where((F.col("episode_index") == episode) & F.col("frame_index").between(start, stop - 1))
        return df.orderBy("frame_index").select(*columns)

    def episodes(self, with_stats: bool = False) -> DataFrame:
        df = self._read("episodes")
        return df if with_stats else df.drop(*[c for c in df.columns if c.startswith("stats/")])

    def tasks(self) -> DataFrame:
        return self._read("tasks")

    def stats(self) -> DataFrame | None:
        at = f"{self.root}/{self.info.get('stats', 'meta/stats')}"
        return self.spark.read.parquet(at) if exists(at) else None


def open_all(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Frames of several data sets with the columns they share and ``dataset_index``."""
    return union_common([Episodes(spark, r).frames() for r in roots])


REQUIRED = ("episode_index", "frame_index", "timestamp", "index", "task_index")


def create(frames: DataFrame, root: str, fps: float, order: list[Column], vectors: list[str] = (), rows_per_file: int = 1_000_000, episodes_per_chunk: int = 1000, drop: list[str] = ()) -> None:
    """Write a data set from rows with episode_index and task: numbers, timestamps (number / fps), dense global index, task dimension, episode table and statistics.

    Existing data are never overwritten. Columns of ``drop`` only order the rows. Null episodes are refused, as are names that hold a slash.
    """
    bad = [c for c in frames.columns if "/" in c]
    if bad:
        raise ValueError(f"names may not hold a slash: {bad}")
    if not frames.where("episode_index is null").isEmpty():
        raise ValueError("rows without an episode")
    spark = frames.sparkSession
    rows = numbered(frames, ["episode_index"], order, "frame_index").drop(*drop)
    dim = numbered(rows.select("task").where("task is not null").distinct().withColumn("_g", F.lit(0)), ["_g"], [F.col("task")], "task_index").drop("_g")
    dim.write.parquet(f"{root}/meta/tasks")
    dim = spark.read.parquet(f"{root}/meta/tasks")
    eps = rows.groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"), F.array_sort(F.collect_set("task")).alias("tasks"))
    eps = running_sum(eps, "length", [F.col("episode_index")], "dataset_from_index", "create").withColumn("dataset_to_index", F.col("dataset_from_index") + F.col("length"))
    eps = eps.withColumn("chunk", F.expr(f"episode_index div {episodes_per_chunk}"))
    eps.write.parquet(f"{root}/meta/episodes")
    eps = spark.read.parquet(f"{root}/meta/episodes")
    out = rows.join(broadcast_if_small(dim, 200), "task", "left").join(broadcast_if_small(eps.select("episode_index", "dataset_from_index", "chunk"), 64), "episode_index")
    out = out.withColumn("index", F.col("dataset_from_index") + F.col("frame_index")).withColumn("timestamp", F.col("frame_index") / F.lit(float(fps))).drop("dataset_from_index", "task")
    sorted_out = out.repartitionByRange("episode_index", "frame_index").sortWithinPartitions("episode_index", "frame_index")
    sorted_out.write.option("maxRecordsPerFile", rows_per_file).partitionBy("chunk").parquet(f"{root}/data")
    if vectors:
        parts = [moments(channels(out, ["episode_index"], v), ["episode_index", "dim"]).withColumn("feature", F.lit(v)) for v in vectors]
        whole = merged_moments(reduce(lambda a, b: a.unionByName(b), parts), ["feature", "dim"])
        whole.write.parquet(f"{root}/meta/stats")
    totals = eps.agg(F.count(F.lit(1)).alias("e"), F.sum("length").alias("n")).first()
    info = {"fps": fps, "total_episodes": totals["e"], "total_frames": totals["n"] or 0, "features": [c for c in out.columns if c != "chunk"], "version": 1}
    store, at = fs.FileSystem.from_uri(f"{root}/{INFO}")
    with store.open_output_stream(at) as f:
        f.write(json.dumps(info).encode())


def open_labelled(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """Frames of several roots with the columns they share and the label of the root they come from."""
    names = list(roots)
    df = open_all(spark, [roots[n] for n in names])
    return df.withColumn("source", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("dataset_index") + 1))


def make(spark: SparkSession, root: str, streaming: bool = False, files_per_trigger: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Frames of a data set, as a batch or as a stream of its files."""
    if not streaming:
        return Episodes(spark, root).frames(columns)
    reader = spark.readStream.schema(spark.read.parquet(f"{root}/data").schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.parquet(f"{root}/data").drop("chunk")
    return df.select(*columns) if columns else df


def samples(df: DataFrame, prefetch: bool = True):
    """Rows as dicts, a partition at a time: the driver holds one partition, not the result."""
    for row in df.toLocalIterator(prefetchPartitions=prefetch):
        yield row.asDict(recursive=True)


def migrate(spark: SparkSession, old: str, new: str, fps: float | None = None) -> None:
    """Bring a data set of the earlier layout (one Parquet file per episode, JSON lines of tasks) into this one.

    ``old`` holds data/**/*.parquet with episode_index, frame_index and task_index, meta/tasks.jsonl with
    task_index and task, and meta/info.json with fps. Frame numbers, timestamps and the global index are made anew.
    """
    store, at = fs.FileSystem.from_uri(f"{old}/{INFO}")
    with store.open_input_stream(at) as f:
        info = json.loads(f.read())
    frames = spark.read.option("recursiveFileLookup", True).parquet(f"{old}/data")
    tasks = spark.read.schema("task_index bigint, task string").json(f"{old}/meta/tasks.jsonl")
    named = frames.withColumnRenamed("frame_index", "_order").join(broadcast_if_small(tasks, 200), "task_index", "left")
    create(named.drop("task_index", "index", "timestamp"), new, fps or float(info["fps"]), [F.col("_order")])
