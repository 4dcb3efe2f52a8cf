"""Structured Streaming variants of the stateful operators.

Each function turns a stream into a stream; ``finished`` runs one over what its source holds now and
returns what was written, which is how the batch queries and the tests use them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framemill.session import shared_dir


def source(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files under a path."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def finished(stream: DataFrame, mode: str = "append", name: str = "stream", base: str | None = None) -> DataFrame:
    """Run a stream over all that is available and read what it wrote; in update mode each trigger's rows are kept.

    ``base`` is the folder of the stream's state and output; given again, the stream goes on from where it was.
    """
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/framemill-{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").start(f"{base}/out")
    else:
        # a batch that is repeated after a failure writes the same folder again
        query = writer.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out/batch={n}")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out") if mode == "append" else spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")


def tumbling(events: DataFrame, time: str, window: str, delay: str, keys: list[str]) -> DataFrame:
    """Counts and sums of closed windows; rows later than the delay are dropped by the watermark."""
    w = F.window(time, window)
    return events.withWatermark(time, delay).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, delay: str, keys: list[str]) -> DataFrame:
    """Closed sessions of each key."""
    w = F.session_window(time, gap)
    return events.withWatermark(time, delay).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), *keys, "n")


def first_seen(rows: DataFrame, time: str, delay: str, keys: list[str]) -> DataFrame:
    """Rows whose keys have not come before within the delay; the state is bounded by it."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


MOMENTS = "key bigint, n bigint, mean double, m2 double, mn double, mx double"


def running_moments(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, std, mn, mx) after each trigger: five numbers of state per key, merged batch by batch."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2, mn, mx = state.get if state.exists else (0, 0.0, 0.0, float("inf"), float("-inf"))
        for pdf in batches:
            x = pdf["v"].dropna().to_numpy(float)
            if not len(x):
                continue
            delta = x.mean() - mean
            total = n + len(x)
            m2 += ((x - x.mean()) ** 2).sum() + delta * delta * n * len(x) / total
            mean += delta * len(x) / total
            n, mn, mx = total, min(mn, x.min()), max(mx, x.max())
        state.update((n, float(mean), float(m2), float(mn), float(mx)))
        if n:
            yield pd.DataFrame({"key": [k[0]], "n": [n], "mean": [mean], "std": [float(np.sqrt(m2 / n))], "mn": [mn], "mx": [mx]})

    src = rows.select(F.col(key).cast("bigint").alias("key"), F.col(value).cast("double").alias("v"))
    out = "key bigint, n bigint, mean double, std double, mn double, mx double"
    return src.groupBy("key").applyInPandasWithState(step, out, "n bigint, mean double, m2 double, mn double, mx double", "update", GroupStateTimeout.NoTimeout)


def ring(rows: DataFrame, key: str, order: str, capacity: int) -> DataFrame:
    """(key, slot, ord) of the last ``capacity`` rows of each key after each trigger, oldest first; the state is a list of that length."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for pdf in batches:
            held = sorted(held + pdf["o"].astype(int).tolist())[-capacity:]
        state.update((held,))
        yield pd.DataFrame({"key": k[0], "slot": range(len(held)), "ord": held})

    src = rows.select(F.col(key).cast("bigint").alias("key"), F.col(order).cast("bigint").alias("o"))
    return src.groupBy("key").applyInPandasWithState(step, "key bigint, slot int, ord bigint", "held array<bigint>", "update", GroupStateTimeout.NoTimeout)


def latest(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows kept per trigger, those of each key's last one."""
    last = batches.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return batches.join(last, [*keys, "batch"]).drop("batch")


def merging_sink(target: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]):
    """A foreachBatch function that merges each batch into a versioned table: version n is written from n - 1, so a repeated batch changes nothing."""

    def sink(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        old = spark.read.parquet(f"{target}/version={n - 1}") if n else None
        merge(old, df).write.mode("overwrite").parquet(f"{target}/version={n}")

    return sink
