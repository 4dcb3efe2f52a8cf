"""Editing data sets of episodes: merge, delete, split, relabel and renumber."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framemill.operators.sampling import positions
from framemill.session import broadcast_if_small


def common_columns(parts: list[DataFrame]) -> list[str]:
    """Columns that all parts have, in the order of the first."""
    return [c for c in parts[0].columns if all(c in p.columns for p in parts[1:])]


def union_common(parts: list[DataFrame], tag: str = "dataset_index") -> DataFrame:
    """All rows with the common columns and the number of the part they come from."""
    cols = common_columns(parts)
    return reduce(lambda a, b: a.unionByName(b), [p.select(*cols).withColumn(tag, F.lit(i)) for i, p in enumerate(parts)])


def task_union(parts: list[DataFrame], text: str, index: str) -> DataFrame:
    """Distinct tasks of several dimensions, numbered densely in the order of first sight. Task dimensions are bounded catalogues."""
    seen = union_common([p.select(text, index) for p in parts], "_part").groupBy(text).agg(F.min(F.struct("_part", index)).alias("_first"))
    return positions(seen, [F.col("_first._part"), F.col(f"_first.{index}"), F.col(text)], "task_index").select(text, "task_index")


def shifted(part: DataFrame, episode: str, index: str, n_episodes: int, n_frames: int) -> DataFrame:
    """A part behind others: its episode and frame numbers moved up."""
    return part.withColumn(episode, F.col(episode) + n_episodes).withColumn(index, F.col(index) + n_frames)


def dense_episodes(episodes: DataFrame, key: str, out: str = "new_index") -> DataFrame:
    """(key, out): episodes numbered densely in the order of their key."""
    return positions(episodes.select(key).distinct(), [F.col(key)], out)


def without(rows: DataFrame, episodes: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of the remaining episodes under their new dense numbers (``new_index``)."""
    kept = episodes.join(gone.select(key).distinct(), key, "left_anti")
    return rows.join(broadcast_if_small(dense_episodes(kept, key), 48), key)


def relabelled(rows: DataFrame, original: str, overrides: DataFrame, key: str, default: str | None) -> DataFrame:
    """New task of each row: the override of its key, else the default, else what it was; numbered by the sorted distinct texts."""
    o = overrides.select(key, F.col("new_task").alias("_o"))
    text = F.coalesce("_o", F.lit(default) if default is not None else F.lit(None).cast("string"), original)
    named = rows.join(broadcast_if_small(o, 120), key, "left").withColumn("task_text", text).drop("_o")
    dim = positions(named.select("task_text").distinct().where("task_text is not null"), [F.col("task_text")], "task_no")
    return named.join(broadcast_if_small(dim, 160), "task_text", "left")


def overlapping(splits: DataFrame, key: str) -> DataFrame:
    """Keys that more than one split claims."""
    return splits.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)


def new_tasks(known: DataFrame, wanted: DataFrame, text: str, index: str) -> DataFrame:
    """Tasks not known yet, numbered on from the greatest known index in the order of their text."""
    top = known.agg(F.coalesce(F.max(index), F.lit(-1)).alias("_top"))
    fresh = wanted.select(text).where(F.col(text).isNotNull()).distinct().join(known.select(text), text, "left_anti")
    return positions(fresh, [F.col(text)], "_n").join(F.broadcast(top), how="cross").select(text, (F.col("_n") + F.col("_top") + 1).alias(index))


def file_bins(order_start: str, size: str, limit: int):
    """File of a row from the running sum of sizes before it (``order_start``): a file ends with the row that crosses the limit."""
    return F.floor(F.col(order_start) / limit).cast("bigint")


def chunk_and_file(number: str, per_chunk: int = 1000):
    """(chunk, file) of a running file number."""
    return F.floor(F.col(number) / per_chunk).cast("bigint"), F.pmod(F.col(number), F.lit(per_chunk))
