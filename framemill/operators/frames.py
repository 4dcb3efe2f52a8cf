"""Identity of stored frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framemill.session import fits_broadcast

#: Estimated bytes of an (episode_index, fps) pair in a hash relation.
_PAIR_BYTES = 64


def frame_rows(frames: DataFrame, episodes: DataFrame, take: dict[str, Column]) -> DataFrame:
    """One row per stored frame: ``ep``, ``fr`` (the frame number) and the columns of ``take``.

    The number is ``frame_index``, or where that is null ``timestamp_s`` times the episode's fps,
    rounded half up; it is null where neither can be had (no or NaN timestamp, no fps). Several
    entries of one episode count with their largest fps. Only named columns are read, so other
    columns of either table, whatever their names, change nothing; names in ``take`` may not be
    ``ep`` or ``fr``. While the (episode, fps) pairs fit a broadcast the frames are not shuffled;
    beyond that only rows without a frame index meet the episodes in a join.
    """
    rows = frames.select(F.col("episode_index").alias("ep"), F.col("frame_index").alias("fr"), F.col("timestamp_s").alias("_ts"), *[c.alias(n) for n, c in take.items()])
    pairs = episodes.where("episode_index is not null").groupBy(F.col("episode_index").alias("ep")).agg(F.max("fps").alias("_fps"))
    by_time = F.when(~F.isnan("_ts"), F.round(F.col("_ts") * F.col("_fps"))).cast("bigint")
    if fits_broadcast(pairs, _PAIR_BYTES):
        return rows.join(F.broadcast(pairs), "ep", "left").withColumn("fr", F.coalesce("fr", by_time)).drop("_fps", "_ts")
    known = rows.where("fr is not null").drop("_ts")
    rest = rows.where("fr is null").join(pairs, "ep", "left").withColumn("fr", by_time).drop("_fps", "_ts")
    return known.unionByName(rest)
