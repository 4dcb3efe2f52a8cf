"""Queries that run streams to their end, and storage round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framemill.functions import rotations
from framemill.plans.registry import Registry
from framemill.session import shared_dir, table
from framemill.sources import formats, manifests, rewrite, store
from framemill.streaming import stateful

R = Registry()


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return stateful.source(spark, f"{d}/events.parquet*", schema).withColumn("ts", F.col("ts").cast("timestamp"))


@R.query("""WITH w AS (SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
  SELECT start::TIMESTAMP AS start, event_type, n, total FROM w WHERE start + INTERVAL 1 hour <= (SELECT max(ts) FROM events) - INTERVAL 1 day""")
def stream_tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    """Closed event-time windows of a stream (extra)."""
    out = stateful.finished(stateful.tumbling(_events(spark, d), "ts", "1 hour", "1 day", ["event_type"]), name="tumbling")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@R.query("SELECT user_id AS key, count(value) AS n, round(avg(value), 8) AS mean, round(stddev_pop(value), 8) AS std, min(value) AS mn, max(value) AS mx FROM events WHERE value IS NOT NULL GROUP BY 1")
def stream_running_statistics(spark: SparkSession, d: str) -> DataFrame:
    """STM-02, STM-03: the state after the last trigger equals the batch statistics."""
    out = stateful.latest(stateful.finished(stateful.running_moments(_events(spark, d), "user_id", "value"), "update", "moments"), ["key"])
    return out.select("key", "n", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"), "mn", "mx")


@R.query("SELECT user_id AS key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS slot, event_id AS ord FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 8")
def stream_ring_buffer(spark: SparkSession, d: str) -> DataFrame:
    """STM-01, STM-06 (see streaming.monitor): the last eight rows of each key."""
    return stateful.latest(stateful.finished(stateful.ring(_events(spark, d), "user_id", "event_id", 8), "update", "ring"), ["key"])


@R.query("SELECT DISTINCT event_id FROM events")
def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """SRC-10, STM-04: each row once, within the watermark, from a stream that can be resumed from its checkpoint."""
    return stateful.finished(stateful.first_seen(_events(spark, d), "ts", "400 days", ["event_id"]).select("event_id"), name="seen")


def _root(spark: SparkSession) -> str:
    root = f"{shared_dir(spark)}/framemill-store-{uuid.uuid4().hex}"
    return root if "://" in root else f"file://{root.removeprefix('file:')}"


def _built(spark: SparkSession, d: str, where: str = "true") -> store.Episodes:
    root = _root(spark)
    ev = _rows(spark, d, where)
    store.create(ev, root, 10.0, [F.col("ts"), F.col("event_id")], ["state"])
    return store.Episodes(spark, store.discover([root])[0])


def _rows(spark: SparkSession, d: str, where: str) -> DataFrame:
    return table(spark, d, "events").where(where).select(F.col("user_id").alias("episode_index"), "ts", "event_id", F.col("event_type").alias("task"), F.array("value").alias("state"))


@R.query("""SELECT event_id, user_id AS episode_index, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index, round((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 10.0, 6) AS "timestamp",
  row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS "index", dense_rank() OVER (ORDER BY event_type) - 1 AS task_index FROM events""")
def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """SRC-01, SRC-08, SRC-12, SRC-33, SNK-03, SNK-07, SNK-09: written as a data set and read back."""
    return _built(spark, d).frames(["event_id", "episode_index", "frame_index", "timestamp", "index", "task_index"]).withColumn("timestamp", F.round("timestamp", 6))


@R.query("WITH e AS (SELECT user_id, count(*) AS n, list_sort(list_distinct(list(event_type))) AS tasks FROM events GROUP BY 1) SELECT user_id AS episode_index, n AS length, tasks, CAST(sum(n) OVER (ORDER BY user_id) - n AS BIGINT) AS dataset_from_index, CAST(sum(n) OVER (ORDER BY user_id) AS BIGINT) AS dataset_to_index FROM e")
def store_episode_table(spark: SparkSession, d: str) -> DataFrame:
    """SRC-04, SRC-05, SNK-04, SNK-08."""
    return _built(spark, d).episodes().drop("chunk")


@R.query("SELECT 'state' AS feature, 0 AS dim, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events")
def store_statistics(spark: SparkSession, d: str) -> DataFrame:
    """SRC-07, SNK-10."""
    return _built(spark, d).stats().select("feature", "dim", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


_EDITED = """SELECT event_id, e AS episode_index, row_number() OVER (PARTITION BY e ORDER BY ts, event_id) - 1 AS frame_index, row_number() OVER (ORDER BY e, ts, event_id) - 1 AS "index", event_type AS task FROM r"""


def _edited(ds: store.Episodes) -> DataFrame:
    tasks = ds.tasks().select("task_index", "task")
    return ds.frames(["event_id", "episode_index", "frame_index", "index", "task_index"]).join(F.broadcast(tasks), "task_index", "left").drop("task_index")


@R.query(f"WITH n AS (SELECT *, user_id % 2 AS part FROM events), k AS (SELECT part, user_id, row_number() OVER (ORDER BY part, user_id) - 1 AS e FROM (SELECT DISTINCT part, user_id FROM n)), r AS (SELECT n.*, e FROM n JOIN k USING (part, user_id)) {_EDITED}")
def store_merge(spark: SparkSession, d: str) -> DataFrame:
    """EDT-01, EDT-02, EDT-04: two data sets merged on storage, read back from the files."""
    roots = [_built(spark, d, f"user_id % 2 = {k}").root for k in (0, 1)]
    rewrite.merge(spark, roots, out := _root(spark), ["state"])
    return _edited(store.Episodes(spark, out))


@R.query(f"WITH k AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS e FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 3 <> 0)), r AS (SELECT events.*, e FROM events JOIN k USING (user_id)) {_EDITED}")
def store_delete(spark: SparkSession, d: str) -> DataFrame:
    """EDT-05, EDT-08, EDT-09: a data set rewritten without some episodes, the others numbered anew."""
    ds = _built(spark, d)
    rewrite.delete(ds, ds.episodes().where("episode_index % 3 = 0"), out := _root(spark), ["state"])
    return _edited(store.Episodes(spark, out))


@R.query("WITH k AS (SELECT user_id, user_id % 3 AS m, row_number() OVER (PARTITION BY least(1, user_id % 3) ORDER BY user_id) - 1 AS episode_index FROM (SELECT DISTINCT user_id FROM events)) SELECT CASE WHEN m = 0 THEN 'held' ELSE 'train' END AS part, episode_index, count(*) AS n, round(sum(value), 4) AS total FROM events JOIN k USING (user_id) GROUP BY ALL")
def store_split(spark: SparkSession, d: str) -> DataFrame:
    """EDT-06: a data set split into data sets of their own, read back."""
    ds = _built(spark, d)
    parts = {"held": ds.episodes().where("episode_index % 3 = 0"), "train": ds.episodes().where("episode_index % 3 <> 0")}
    roots = rewrite.split(ds, parts, _root(spark), ["state"])
    each = [store.Episodes(spark, r).frames().withColumn("part", F.lit(name)) for name, r in roots.items()]
    total = F.round(F.sum(F.element_at("state", 1)), 4)
    return each[0].unionByName(each[1]).groupBy("part", "episode_index").agg(F.count(F.lit(1)).alias("n"), total.alias("total"))


@R.query(f"WITH m AS (SELECT max(user_id) AS top FROM events WHERE user_id % 2 = 0), k AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS n FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 1)), r AS (SELECT events.*, coalesce(top + 1 + k.n, user_id) AS e FROM events CROSS JOIN m LEFT JOIN k USING (user_id)) {_EDITED}")
def store_append(spark: SparkSession, d: str) -> DataFrame:
    """SNK-01, SNK-02, SNK-05: episodes committed behind those of a data set, in new files."""
    ds = _built(spark, d, "user_id % 2 = 0")
    rewrite.append(_rows(spark, d, "user_id % 2 = 1"), ds.root, [F.col("ts"), F.col("event_id")], ["state"], rows_per_file=5000)
    return _edited(store.Episodes(spark, ds.root))


@R.query("SELECT 'state' AS feature, 0 AS dim, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events")
def store_append_statistics(spark: SparkSession, d: str) -> DataFrame:
    """STM-03, SRC-05: statistics merged when episodes were appended are those of all frames."""
    ds = _built(spark, d, "user_id % 2 = 0")
    rewrite.append(_rows(spark, d, "user_id % 2 = 1"), ds.root, [F.col("ts"), F.col("event_id")], ["state"])
    return store.Episodes(spark, ds.root).stats().select("feature", "dim", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _clips(spark: SparkSession, d: str) -> DataFrame:
    """Curator lines made of the episode table: windows of 40 frames, one in four without a caption; written as JSON lines and read under the declared schema."""
    e = table(spark, d, "episodes")
    n = F.col("num_frames")
    starts = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(40).cast("bigint")))
    w = F.transform(starts, lambda s: F.struct(s.alias("start_frame"), F.least(s + 39, n - 1).alias("end_frame"), F.create_map(F.lit("m_caption"), F.when(F.pmod(s, F.lit(160)) != 120, F.concat(F.lit("clip "), s.cast("string")))).alias("captions")))
    rows = e.select(F.col("domain_name").alias("clip_location"), F.col("episode_index").cast("string").alias("span_uuid"), F.lit(640).alias("width"), (F.lit(300) + F.col("episode_index") % 400).cast("int").alias("height"), n, F.col("fps").alias("framerate"), w.alias("windows"))
    path = f"{shared_dir(spark)}/framemill-clips-{uuid.uuid4().hex}"
    rows.write.option("ignoreNullFields", "false").json(path)
    return manifests.read_lines(spark, path, manifests.CLIPS)


_CUR = """WITH c AS (SELECT CAST(episode_index AS VARCHAR) AS uuid, domain_name AS loc, 300 + episode_index % 400 AS h, num_frames AS n, fps, num_frames / fps AS dur FROM episodes),
  w AS (SELECT uuid, s, least(s + 39, n - 1) AS e FROM (SELECT uuid, n, unnest(range(0, n, 40)) AS s FROM c WHERE n > 0) WHERE least(s + 39, n - 1) - s + 1 >= 20 AND s % 160 <> 120),
  r AS (SELECT c.*, CASE WHEN coalesce(loc, '') = '' THEN 'missing_identity' WHEN n IS NULL OR fps IS NULL OR dur IS NULL THEN 'missing_clip_metadata' WHEN dur > 12 THEN 'duration_too_long' WHEN least(640, h) < 360 THEN 'short_edge_too_small' WHEN uuid NOT IN (SELECT uuid FROM w) THEN 'no_valid_window' END AS reason FROM c)"""


def _curated(spark: SparkSession, d: str) -> DataFrame:
    return manifests.curated(_clips(spark, d), model="m", min_edge=360, min_frames=20, max_seconds=12.0)


@R.query(f"{_CUR} SELECT uuid, reason FROM r")
def clip_curation(spark: SparkSession, d: str) -> DataFrame:
    """FLT-01, FLT-02, S17..S19, SRC-15, SRC-20: JSON lines to manifest rows with the first reason to drop them."""
    return _curated(spark, d).select("uuid", "reason")


@R.query(f"{_CUR}, k AS (SELECT uuid, s, e, row_number() OVER (PARTITION BY uuid ORDER BY s) - 1 AS i FROM w WHERE uuid IN (SELECT uuid FROM r WHERE reason IS NULL)) SELECT uuid || '_w' || i AS uuid, s AS start_frame, e AS end_frame, 'clip ' || s AS caption FROM k")
def manifest_window_flatten(spark: SparkSession, d: str) -> DataFrame:
    """WIN-13, SNK-11: the kept rows written as a manifest, read again, a row per window."""
    path = f"{shared_dir(spark)}/framemill-manifest-{uuid.uuid4().hex}"
    manifests.write_manifest(_curated(spark, d), path)
    rows = manifests.usable(manifests.read_lines(spark, path, manifests.MANIFEST), min_frames=20, min_edge=360)
    return manifests.by_window(rows).select("uuid", "start_frame", "end_frame", "caption")


@R.query("SELECT task_index, task, 'tasks' AS kind FROM tasks")
def format_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """SRC-18, SRC-22, SRC-28..30, SNK-12: written and read by file name, through CSV, JSON lines and Parquet."""
    base = f"{shared_dir(spark)}/framemill-formats-{uuid.uuid4().hex}"
    df = table(spark, d, "tasks")
    for suffix in ("csv", "jsonl", "parquet"):
        formats.dump(df, f"{base}.{suffix}")
        df = formats.load(spark, f"{base}.{suffix}", schema="task_index bigint, task string")
    return df.withColumn("kind", F.lit("tasks"))


@R.query("""SELECT vec_id, round(2 * degrees(asin(least(1.0, sqrt(x * x + y * y + z * z) / sqrt(x * x + y * y + z * z + w * w)))), 4) AS angle
  FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(abs(embedding[4]) AS DOUBLE) AS w FROM embeddings)""")
def rotation_conversion(spark: SparkSession, d: str) -> DataFrame:
    """MTH-10, MTH-13, MON-06: quaternion over six numbers to an axis and angle; the angle is checked."""
    q = F.transform(F.slice("embedding", 1, 4), lambda v, i: F.when(i == 3, F.abs(v)).otherwise(v).cast("double"))
    six = rotations.convert_column("quat_xyzw", "rot6d")
    axis = rotations.convert_column("rot6d", "axisangle")
    e = table(spark, d, "embeddings").select("vec_id", q.alias("q")).withColumn("r", six("q")).withColumn("a", axis("r"))
    return e.select("vec_id", F.round(F.degrees(F.sqrt(F.aggregate("a", F.lit(0.0), lambda s, v: s + v * v))), 4).alias("angle"))


@R.query("""WITH f AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events), e AS (SELECT min(user_id) AS u FROM events) SELECT event_id, i AS frame_index FROM f, e WHERE user_id = u AND i BETWEEN 1 AND 3""")
def store_window_scan(spark: SparkSession, d: str) -> DataFrame:
    """SRC-02, SRC-34: a window of one episode, its bounds checked, its row groups pruned."""
    ds = _built(spark, d)
    first = ds.episodes().agg(F.min("episode_index")).first()[0]
    return ds.window(first, 1, 4, ["event_id", "frame_index"])


@R.query("SELECT 'success' AS source, count(*) AS n FROM events UNION ALL SELECT 'failure', count(*) FROM events")
def split_roots_union(spark: SparkSession, d: str) -> DataFrame:
    """SRC-13, SRC-14, SRC-35: roots under labels, read as one table."""
    root = _built(spark, d).root
    return store.open_labelled(spark, {"success": root, "failure": root}).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT domain_name AS path, coalesce(CASE WHEN fps > 20 THEN 'top' END, 'front') AS video_key FROM episodes WHERE domain_name IS NOT NULL")
def manifest_defaults(spark: SparkSession, d: str) -> DataFrame:
    """SRC-17, SRC-19, SRC-23, EDT-13, RDR-13, RDR-18, RDR-19: rows of a manifest of data sets, settings of the row before the defaults."""
    e = table(spark, d, "episodes").where("domain_name is not null")
    lines = e.select(F.col("domain_name").alias("path"), F.when(F.col("fps") > 20, "top").alias("video_key"))
    return manifests.with_defaults(lines, {"video_key": "front"})


@R.query(f"{_CUR} SELECT uuid, CASE WHEN reason IS NOT NULL AND reason <> 'no_valid_window' THEN reason WHEN CAST(uuid AS BIGINT) NOT IN (SELECT episode_index FROM action_policy_batch WHERE episode_index IS NOT NULL) THEN 'missing_control_path' ELSE reason END AS reason FROM r")
def control_manifest(spark: SparkSession, d: str) -> DataFrame:
    """SRC-16, RDR-17: clips without a control file are dropped after the other checks of the clip."""
    have = table(spark, d, "action_policy_batch").where("episode_index is not null").select(F.col("episode_index").cast("string").alias("span_uuid")).distinct()
    controls = have.withColumn("control_path", F.concat(F.lit("depth/"), "span_uuid"))
    return manifests.curated(_clips(spark, d), model="m", min_edge=360, min_frames=20, max_seconds=12.0, controls=controls).select("uuid", "reason")


@R.query("SELECT user_id AS episode_index, count(*) AS n, list_sort(list_distinct(list(event_type))) AS tasks FROM events GROUP BY 1")
def layout_migration(spark: SparkSession, d: str) -> DataFrame:
    """EDT-11: an earlier layout (a file per episode, tasks as JSON lines) brought into this one."""
    import json

    from pyarrow import fs

    base = f"{shared_dir(spark)}/framemill-old-{uuid.uuid4().hex}"
    base = base if "://" in base else f"file://{base}"
    kinds = table(spark, d, "events").select("event_type").distinct().withColumn("task_index", F.crc32("event_type"))
    kinds.select("task_index", F.col("event_type").alias("task")).write.json(f"{base}/meta/tasks.jsonl")
    e = table(spark, d, "events").select(F.col("user_id").alias("episode_index"), F.col("event_id").alias("frame_index"), F.crc32("event_type").alias("task_index"), "value")
    e.write.parquet(f"{base}/data/chunk-000")
    files, at = fs.FileSystem.from_uri(f"{base}/{store.INFO}")
    with files.open_output_stream(at) as f:
        f.write(json.dumps({"fps": 10}).encode())
    store.migrate(spark, base, f"{base}-new")
    return store.Episodes(spark, f"{base}-new").episodes().select("episode_index", F.col("length").alias("n"), "tasks")
