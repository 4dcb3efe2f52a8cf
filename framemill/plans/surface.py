"""Queries of the surface for user functions: processors, batches, workers, accumulators, buffers, progress and resumed streams."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framemill.functions import pipelines
from framemill.plans.registry import Registry
from framemill.session import shared_dir, table
from framemill.sources import formats
from framemill.streaming import stateful

R = Registry()


@pipelines.processor("task_words")
def _task_words(item: dict) -> dict | None:
    words = (item["task"] or "").split()
    return {"task_index": item["task_index"], "first": words[0], "n": len(words)} if words else None


@R.query("SELECT task_index, string_split(task, ' ')[1] AS first, len(string_split(task, ' ')) AS n FROM tasks WHERE task <> ''")
def raw_item_processor(spark: SparkSession, d: str) -> DataFrame:
    """UDF-03: samples that a registered function of an item makes."""
    return pipelines.processed(table(spark, d, "tasks"), "task_words", "task_index bigint, first string, n bigint")


@R.query("SELECT event_id, k FROM events CROSS JOIN (VALUES (0), (1)) t(k) WHERE k = 0 OR event_id % 2 = 0")
def iterable_step(spark: SparkSession, d: str) -> DataFrame:
    """UDF-02: a generator over the rows of a partition that gives one or two for each."""

    def twice(rows):
        for r in rows:
            yield {"event_id": r["event_id"], "k": 0}
            if r["event_id"] % 2 == 0:
                yield {"event_id": r["event_id"], "k": 1}

    return pipelines.stream_step(twice, "event_id bigint, k int")(table(spark, d, "events").select("event_id"))


@R.query("SELECT stream_id, arrival_no // 16 AS batch, string_agg(sample_id, ',' ORDER BY arrival_no, sample_id) AS ids, count(*) AS n FROM (SELECT DISTINCT stream_id, arrival_no, sample_id FROM pack_samples WHERE sample_id IS NOT NULL AND arrival_no IS NOT NULL) GROUP BY 1, 2")
def batch_and_collate(spark: SparkSession, d: str) -> DataFrame:
    """UDF-04, UDF-05: batches of a stream by arrival, each collated to arrays in order."""
    s = table(spark, d, "pack_samples").where("sample_id is not null and arrival_no is not null").select("stream_id", "arrival_no", "sample_id").distinct()
    s = s.withColumn("batch", F.expr("arrival_no div 16"))
    made = pipelines.collated(s, ["stream_id", "batch"], "arrival_no", ["sample_id"])
    return made.select("stream_id", "batch", F.array_join("sample_id", ",").alias("ids"), F.size("sample_id").cast("bigint").alias("n"))


@R.query("SELECT event_id % 5 AS worker, count(*) AS n, 1 AS partitions FROM events GROUP BY 1")
def worker_shares(spark: SparkSession, d: str) -> DataFrame:
    """UDF-06: rows laid out by a strategy, the share of each worker in one partition."""
    rows = pipelines.distributed(table(spark, d, "events").select("event_id"), F.col("event_id"), 5)
    return rows.withColumn("p", F.spark_partition_id()).groupBy(F.col("worker").cast("bigint").alias("worker")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p").cast("int").alias("partitions"))


class Spread(pipelines.Accumulator):
    """Difference between the greatest and the least value."""

    state, result = "array<double>", "double"

    def update(self, values: pd.Series) -> list[float]:
        seen = values.dropna()
        return [float(seen.min()), float(seen.max())] if len(seen) else []

    def merge(self, states: list) -> list[float]:
        some = [s for s in states if len(s)]
        return [min(s[0] for s in some), max(s[1] for s in some)] if some else []

    def finalize(self, state: list[float]) -> float | None:
        return state[1] - state[0] if len(state) else None


@R.query("SELECT event_type, max(value) - min(value) AS result FROM events GROUP BY 1")
def accumulator(spark: SparkSession, d: str) -> DataFrame:
    """UDF-12: a user's aggregate, updated where the rows are and merged by its states."""
    return pipelines.accumulated(table(spark, d, "events"), "event_type", "value", Spread())


@R.query("SELECT event_id % 3 AS worker, event_id, TRUE AS near FROM events")
def shuffle_buffer(spark: SparkSession, d: str) -> DataFrame:
    """SMP-23: each worker's rows through a buffer of 100; none comes out more than that before its turn."""
    rows = table(spark, d, "events").select("event_id")
    out = pipelines.buffered_shuffle(rows, F.col("event_id"), 3, F.col("event_id"), 100, 7)
    turn = rows.withColumn("worker", F.pmod("event_id", F.lit(3)).cast("int")).groupBy("worker").agg(F.min("event_id").alias("first"))
    near = F.col("event_id") <= F.col("first") + 3 * (F.col("place") + 100)
    return out.join(F.broadcast(turn), "worker").select(F.col("worker").cast("bigint").alias("worker"), "event_id", near.alias("near"))


@R.query("SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 1 ELSE 2 END AS run FROM events")
def progress_resume(spark: SparkSession, d: str) -> DataFrame:
    """SNK-16: a run that stops half-way, and one that reads what is done and does the rest."""
    path = f"{shared_dir(spark)}/framemill-progress-{uuid.uuid4().hex}.json"
    progress = formats.Progress(path if "://" in path else f"file://{path.removeprefix('file:')}")
    rows, runs = table(spark, d, "events").select("event_id", (F.col("event_id") % 4).alias("slice")), []
    for run, most in ((1, 2), (2, 4)):
        done = progress.load().get("done", [])
        now = [k for k in range(4) if k not in done][: most - len(done)]
        runs.append(rows.where(F.col("slice").isin(now)).select("event_id", F.lit(run).alias("run")))
        progress.save({"done": [*done, *now]})
    return runs[0].unionByName(runs[1])


@R.query("SELECT event_id FROM events")
def stream_resumed(spark: SparkSession, d: str) -> DataFrame:
    """SRC-10, STM-04: a stream that ends, and goes on from its checkpoint when more files have come; each row once."""
    base = f"{shared_dir(spark)}/framemill-resumed-{uuid.uuid4().hex}"
    rows = table(spark, d, "events").select("event_id", "value")
    out = None
    for part in (0, 1):
        rows.where(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{base}/in")
        out = stateful.finished(stateful.source(spark, f"{base}/in", rows.schema).select("event_id"), base=f"{base}/run")
    return out


@R.query("SELECT task_index, task, 'pipe' AS via FROM tasks")
def format_registry(spark: SparkSession, d: str) -> DataFrame:
    """UDF-08, UDF-09: a reader and a writer registered for a suffix of one's own."""
    suffix = f".own{uuid.uuid4().hex[:6]}"
    formats.register(suffix, read=lambda s, p, o: s.read.schema("task_index bigint, task string").option("sep", "|").csv(p), write=lambda df, p, o: df.write.option("sep", "|").csv(p))
    path = f"{shared_dir(spark)}/framemill-own-{uuid.uuid4().hex}{suffix}"
    formats.dump(table(spark, d, "tasks").select("task_index", "task"), path)
    return formats.load(spark, path).withColumn("via", F.lit("pipe"))
