"""Editing data sets on storage: append, merge, delete and split as real rewrites of frames, episodes, tasks and statistics.

A data set's ``meta/info.json`` names the folders it consists of. An edit writes new folders first and that file last,
so a reader sees the data set before the edit or after it, and a failed edit leaves it as it was.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framemill.operators.editing import dense_episodes, new_tasks
from framemill.operators.episodic import numbered
from framemill.operators.ordering import running_sum
from framemill.operators.statistics import channels, merged_moments, moments
from framemill.session import broadcast_if_small, stored
from framemill.sources.store import INFO, Episodes, create


def _plain(ds: Episodes) -> DataFrame:
    """The frames of a data set with their task as text, without what a rewrite makes anew."""
    return ds.frames().join(broadcast_if_small(ds.tasks(), 200), "task_index", "left").drop("task_index", "index", "timestamp")


def _commit(root: str, info: dict) -> None:
    store, at = fs.FileSystem.from_uri(f"{root}/{INFO}")
    name = f"{at}.{uuid.uuid4().hex}"
    with store.open_output_stream(name) as f:
        f.write(json.dumps(info).encode())
    store.move(name, at)


def append(frames: DataFrame, root: str, order: list[Column], vectors: list[str] = (), rows_per_file: int = 1_000_000, episodes_per_chunk: int = 1000) -> None:
    """Commit episodes behind those of a data set: ``frames`` has episode_index, task and the data set's own columns.

    The new episodes are numbered on from the last one, in the order of the numbers they come with; frame numbers, times,
    the global index and the episode table go on, tasks not known yet get the next numbers, and the statistics of ``vectors`` are merged with the old
    ones. Old files stay as they are; new ones begin where ``rows_per_file`` or a chunk of episodes is full.
    Null episodes are refused; no rows change nothing.
    """
    if not frames.where("episode_index is null").isEmpty():
        raise ValueError("rows without an episode")
    if frames.isEmpty():
        return
    spark = frames.sparkSession
    ds = Episodes(spark, root)
    tag = uuid.uuid4().hex
    last = ds.episodes().agg(F.max("episode_index").alias("e"), F.max("dataset_to_index").alias("n")).first()
    dense = dense_episodes(frames, "episode_index", "_new").withColumn("_new", F.col("_new") + (last["e"] if last["e"] is not None else -1) + 1)
    rows = frames.join(broadcast_if_small(dense, 48), "episode_index").drop("episode_index").withColumnRenamed("_new", "episode_index")
    rows = numbered(rows, ["episode_index"], order, "frame_index")
    fresh = stored(new_tasks(ds.tasks(), rows, "task", "task_index"), "tasks")
    dim = ds.tasks().select("task", "task_index").unionByName(fresh.select("task", "task_index"))
    eps = rows.groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"), F.array_sort(F.collect_set("task")).alias("tasks"))
    eps = running_sum(eps, "length", [F.col("episode_index")], "_before", "append").withColumn("dataset_from_index", F.col("_before") + (last["n"] or 0)).drop("_before")
    eps = eps.withColumn("dataset_to_index", F.col("dataset_from_index") + F.col("length")).withColumn("chunk", F.expr(f"episode_index div {episodes_per_chunk}"))
    eps = stored(eps, "episodes")
    out = rows.join(broadcast_if_small(dim, 200), "task", "left").join(broadcast_if_small(eps.select("episode_index", "dataset_from_index", "chunk"), 64), "episode_index")
    out = out.withColumn("index", F.col("dataset_from_index") + F.col("frame_index")).withColumn("timestamp", F.col("frame_index") / F.lit(float(ds.info["fps"]))).drop("dataset_from_index", "task")
    out.repartitionByRange("episode_index", "frame_index").sortWithinPartitions("episode_index", "frame_index").write.option("maxRecordsPerFile", rows_per_file).partitionBy("chunk").parquet(f"{root}/data-{tag}")
    eps.write.parquet(f"{root}/meta/episodes-{tag}")
    fresh.write.parquet(f"{root}/meta/tasks-{tag}")
    info = dict(ds.info)
    if vectors:
        added = reduce(lambda a, b: a.unionByName(b), [moments(channels(out, ["episode_index"], v), ["dim"]).withColumn("feature", F.lit(v)) for v in vectors])
        known = ds.stats()
        both = added if known is None else known.select(*added.columns).unionByName(added)
        merged_moments(both, ["feature", "dim"]).write.parquet(f"{root}/meta/stats-{tag}")
        info["stats"] = f"meta/stats-{tag}"
    totals = eps.agg(F.count(F.lit(1)).alias("e"), F.sum("length").alias("n")).first()
    for what, folder in (("data", f"data-{tag}"), ("episodes", f"meta/episodes-{tag}"), ("tasks", f"meta/tasks-{tag}")):
        info[what] = [*ds.folders(what), folder]
    _commit(root, info | {"total_episodes": info["total_episodes"] + totals["e"], "total_frames": info["total_frames"] + totals["n"]})


def merge(spark: SparkSession, roots: list[str], out: str, vectors: list[str] = (), **kw) -> None:
    """Write the episodes of several data sets, one behind the other, as a new one with the columns they share.

    All must have one frame rate. Episodes are numbered densely in the order of data set and number; tasks of one text are one.
    """
    sets = [Episodes(spark, r) for r in roots]
    rates = {ds.info["fps"] for ds in sets}
    if len(rates) != 1:
        raise ValueError(f"the data sets have different rates: {sorted(rates)}")
    parts = [_plain(ds) for ds in sets]
    common = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
    rows, base = None, 0
    for part in parts:
        n = dense_episodes(part, "episode_index", "_new").withColumn("_new", F.col("_new") + base)
        n = stored(n, "merged")
        moved = part.select(*common).join(broadcast_if_small(n, 48), "episode_index").drop("episode_index").withColumnRenamed("_new", "episode_index")
        rows = moved if rows is None else rows.unionByName(moved)
        base += n.count()
    create(rows.withColumnRenamed("frame_index", "_order"), out, rates.pop(), [F.col("_order")], vectors, drop=["_order"], **kw)


def keep(ds: Episodes, episodes: DataFrame, out: str, vectors: list[str] = (), **kw) -> None:
    """Write the named episodes of a data set as a new one, numbered densely in their order."""
    chosen = stored(dense_episodes(ds.episodes().join(episodes.select("episode_index").distinct(), "episode_index", "left_semi"), "episode_index", "_new"), "kept")
    rows = _plain(ds).join(broadcast_if_small(chosen, 48), "episode_index").drop("episode_index").withColumnRenamed("_new", "episode_index")
    create(rows.withColumnRenamed("frame_index", "_order"), out, float(ds.info["fps"]), [F.col("_order")], vectors, drop=["_order"], **kw)


def delete(ds: Episodes, gone: DataFrame, out: str, vectors: list[str] = (), **kw) -> None:
    """Write a data set without some episodes; the others move up. Deleting all of them is refused."""
    left = stored(ds.episodes().join(gone.select("episode_index").distinct(), "episode_index", "left_anti").select("episode_index"), "left")
    if left.isEmpty():
        raise ValueError("no episode would be left")
    keep(ds, left, out, vectors, **kw)


def split(ds: Episodes, parts: dict[str, DataFrame], out: str, vectors: list[str] = (), **kw) -> dict[str, str]:
    """Write each named part as a data set of its own under ``out``: name to root. An episode in two parts is refused."""
    named = reduce(lambda a, b: a.unionByName(b), [p.select("episode_index").distinct() for p in parts.values()])
    if not named.groupBy("episode_index").count().where("count > 1").isEmpty():
        raise ValueError("an episode is in several parts")
    roots = {name: f"{out}/{name}" for name in parts}
    for name, root in roots.items():
        keep(ds, parts[name], root, vectors, **kw)
    return roots
