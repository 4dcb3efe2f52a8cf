"""Tables that several query modules start from, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framemill.operators.frames import frame_rows
from framemill.session import table


def steps(spark: SparkSession, d: str) -> DataFrame:
    """Each frame once: ep, i, ts (earliest), task, v (first state channel), a (first action channel), chunk, file."""
    take = {
        "ts": F.col("timestamp_s"),
        "task": F.col("task_index"),
        "v": F.col("observation_state")[0].cast("double"),
        "a": F.col("action_vec")[0].cast("double"),
    }
    rows = frame_rows(table(spark, d, "frames"), table(spark, d, "episodes"), take).where("ep is not null and fr is not null")
    return rows.groupBy("ep", F.col("fr").alias("i")).agg(*[F.min(c).alias(c) for c in take])


STEPS = """steps AS (
  SELECT f.episode_index AS ep, coalesce(f.frame_index, CAST(round(f.timestamp_s * e.fps) AS BIGINT)) AS i, min(f.timestamp_s) AS ts, min(f.task_index) AS task,
    min(CAST(f.observation_state[1] AS DOUBLE)) AS v, min(CAST(f.action_vec[1] AS DOUBLE)) AS a
  FROM frames f LEFT JOIN episodes e USING (episode_index) WHERE f.episode_index IS NOT NULL AND coalesce(f.frame_index, round(f.timestamp_s * e.fps)) IS NOT NULL GROUP BY 1, 2)"""

#: An episode's first and last frame and its values there.
ENDS = "ends AS (SELECT ep, min(i) AS start, max(i) + 1 AS stop, arg_min_null(v, i) AS v0, arg_max_null(v, i) AS v1 FROM steps GROUP BY ep)"
