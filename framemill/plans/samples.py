"""Queries of sampling, splitting, sharding, mixing, batching and data-set editing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framemill.operators import batching, editing, sampling
from framemill.operators.ordering import running_sum
from framemill.plans.base import STEPS, steps
from framemill.plans.registry import Registry
from framemill.session import broadcast_if_small, table

R = Registry()

_POS = "p AS (SELECT doc_id, row_number() OVER (ORDER BY sha256(CAST(doc_id AS VARCHAR) || '/0'), doc_id) - 1 AS pos FROM documents)"


def _pos(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    return sampling.positions(docs, [sampling.sha_key(F.col("doc_id")), F.col("doc_id")])


@R.query(f"WITH {_POS} SELECT doc_id, pos FROM p")
def sha_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """SRT-01, SMP-02, SMP-23: a shuffle that comes out the same everywhere."""
    return _pos(spark, d)


@R.query("SELECT pair_id, (row_number() OVER (ORDER BY pair_id) - 1) % 8 AS shard FROM t2i_pairs")
def shard_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """SMP-01, SRC-11."""
    rows = sampling.positions(table(spark, d, "t2i_pairs").select("pair_id"), [F.col("pair_id")])
    return rows.select("pair_id", sampling.shard(F.col("pos"), 8).alias("shard"))


@R.query(f"WITH {_POS} SELECT doc_id, pos % 4 AS rank, (pos // 4) % 3 AS worker FROM p")
def shard_two_level(spark: SparkSession, d: str) -> DataFrame:
    """SMP-03."""
    rank, worker = sampling.two_level(F.col("pos"), 4, 3)
    return _pos(spark, d).select("doc_id", rank.alias("rank"), worker.alias("worker"))


@R.query("""WITH e AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS pos FROM eval_items), n AS (SELECT count(*) * 3 AS n FROM e)
  SELECT item_id, pos, CAST(unnest(range(0, 3)) AS INTEGER) AS copy FROM e UNION ALL SELECT item_id, pos, 3::INTEGER FROM e, n WHERE pos < (7 - n % 7) % 7""")
def shard_repeat_pad(spark: SparkSession, d: str) -> DataFrame:
    """SMP-04."""
    items = sampling.positions(table(spark, d, "eval_items").select("item_id"), [F.col("item_id")])
    return sampling.repeated(items, 3, items.count(), 7)


@R.query(f"""WITH {STEPS}, b AS (SELECT ep, row_number() OVER (ORDER BY sha256(CAST(ep AS VARCHAR) || '/5'), ep) - 1 AS block FROM (SELECT DISTINCT ep FROM steps)) SELECT ep, i, block FROM steps JOIN b USING (ep)""")
def block_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """SMP-05, SMP-06, SMP-17: episodes shuffled, the order inside kept."""
    s = steps(spark, d).select("ep", "i")
    blocks = sampling.positions(s.select("ep").distinct(), [sampling.sha_key(F.col("ep"), 5), F.col("ep")], "block")
    return s.join(broadcast_if_small(blocks, 48), "ep")


@R.query("WITH p AS (SELECT record_id, row_number() OVER (ORDER BY record_id) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT record_id FROM t2i_records)) SELECT record_id FROM p WHERE pos < greatest(1, floor(n * 0.25))")
def head_fraction(spark: SparkSession, d: str) -> DataFrame:
    """SMP-09, SRC-18: the sampling operator keeps the first quarter by id."""
    rows = sampling.positions(table(spark, d, "t2i_records").select("record_id").distinct(), [F.col("record_id")])
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    return rows.join(F.broadcast(n), how="cross").where(F.col("pos") < sampling.head_count(F.col("n"), 0.25)).select("record_id")


@R.query("""WITH e AS (SELECT episode_index, num_frames AS n, least(num_frames, greatest(4, CAST(floor(pow(num_frames, 0.75)) AS BIGINT))) AS m FROM episodes WHERE num_frames > 0),
  k AS (SELECT *, unnest(range(0, m)) AS k FROM e) SELECT episode_index, CAST(round_even(k * CASE WHEN m > 1 THEN (n - 1) / (m - 1)::DOUBLE ELSE 0 END, 0) AS BIGINT) AS i FROM k""")
def evenly_spaced_sample(spark: SparkSession, d: str) -> DataFrame:
    """SMP-08, AGG-37."""
    n = F.col("num_frames")
    m = F.least(n, F.greatest(F.lit(4), F.floor(F.pow(n, 0.75))))
    return table(spark, d, "episodes").where("num_frames > 0").select("episode_index", F.explode(sampling.evenly(n, m)).alias("i"))


@R.query("""WITH p AS (SELECT episode_index, row_number() OVER (ORDER BY episode_index) - 1 AS pos, count(*) OVER () AS n FROM episodes)
  SELECT episode_index, CASE WHEN pos < floor(n * 0.7) THEN 'train' WHEN pos < floor(n * 0.7) + floor(n * 0.2) THEN 'val' ELSE 'test' END AS split FROM p""")
def split_fraction(spark: SparkSession, d: str) -> DataFrame:
    """SMP-11, EDT-06: contiguous splits, the last takes the rest."""
    rows = sampling.positions(table(spark, d, "episodes").select("episode_index"), [F.col("episode_index")])
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    b = sampling.fraction_bounds(F.col("n"), {"train": 0.7, "val": 0.2, "test": 0.1})
    at = lambda s: (F.col("pos") >= b[s][0]) & (F.col("pos") < b[s][1])
    return rows.join(F.broadcast(n), how="cross").select("episode_index", F.when(at("train"), "train").when(at("val"), "val").when(at("test"), "test").alias("split"))


@R.query("WITH p AS (SELECT episode_index, row_number() OVER (ORDER BY sha256(CAST(episode_index AS VARCHAR) || '/9'), episode_index) - 1 AS pos, count(*) OVER () AS n FROM episodes) SELECT episode_index, CASE WHEN pos < round_even(n * 0.1, 0) THEN 'val' ELSE 'train' END AS split FROM p")
def split_random(spark: SparkSession, d: str) -> DataFrame:
    """SMP-10: a hash takes the place of the generator's permutation."""
    rows = sampling.positions(table(spark, d, "episodes").select("episode_index"), [sampling.sha_key(F.col("episode_index"), 9), F.col("episode_index")])
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    return rows.join(F.broadcast(n), how="cross").select("episode_index", F.when(F.col("pos") < F.bround(F.col("n") * 0.1, 0), "val").otherwise("train").alias("split"))


_U = "CAST(CAST('0x' || substr(sha256(CAST({c} AS VARCHAR) || '/{s}'), 1, 12) AS UBIGINT) AS DOUBLE) / 281474976710656.0"


@R.query(f"SELECT pair_id, CASE WHEN u < 0.5 THEN 'a' WHEN u < 0.8 THEN 'b' ELSE 'c' END AS source FROM (SELECT pair_id, {_U.format(c='pair_id', s=1)} AS u FROM t2i_pairs)")
def mixture_weighted(spark: SparkSession, d: str) -> DataFrame:
    """SMP-12, SMP-13, SMP-15: a weighted choice that is a function of the id and the seed."""
    u = sampling.uniform(F.col("pair_id"), 1)
    return table(spark, d, "t2i_pairs").select("pair_id", sampling.weighted_choice(u, {"a": 5.0, "b": 3.0, "c": 2.0}).alias("source"))


@R.query("SELECT event_id, CASE WHEN event_id % 6 < 1 THEN 'x' WHEN event_id % 6 < 3 THEN 'y' ELSE 'z' END AS source FROM events")
def mixture_ratio_cycle(spark: SparkSession, d: str) -> DataFrame:
    """SMP-14, STM-07."""
    return table(spark, d, "events").select("event_id", sampling.ratio_cycle(F.col("event_id"), {"x": 1, "y": 2, "z": 3}).alias("source"))


@R.query("""WITH w AS (SELECT source, target_weight AS r FROM mix_targets WHERE target_weight > 0), i AS (SELECT source, r / sum(r) OVER () * 64 AS ideal FROM w), b AS (SELECT *, greatest(1, floor(ideal)) AS base FROM i),
  g AS (SELECT source, CAST(base + CASE WHEN row_number() OVER (ORDER BY ideal - base DESC, source) <= 64 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS ranks FROM b)
  SELECT source, ranks, CAST(coalesce(sum(ranks) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_rank FROM g""")
def rank_allocation(spark: SparkSession, d: str) -> DataFrame:
    """SMP-16."""
    return sampling.allocation_table(table(spark, d, "mix_targets"), "source", "target_weight", 64)


@R.query(f"WITH {STEPS}, e AS (SELECT ep, min(i) AS lo, max(i) + 1 AS hi FROM steps GROUP BY ep) SELECT ep, i FROM steps JOIN e USING (ep) WHERE i >= lo + 3 AND i < hi - 5")
def sampler_drop_edges(spark: SparkSession, d: str) -> DataFrame:
    """SMP-18."""
    from framemill.operators.episodic import bounds

    s = steps(spark, d).select("ep", "i")
    e = broadcast_if_small(bounds(s, ["ep"], "i"), 64)
    return sampling.trimmed(s.join(e, "ep"), "i", "start", "stop", 3, 5).select("ep", "i")


@R.query("""WITH r AS (SELECT DISTINCT record_id, coalesce(model_mode = 'policy', false) AS online, fps IS NOT NULL AS kept FROM action_policy_batch), n AS (SELECT count(*) FILTER (WHERE online AND kept) AS a, count(*) FILTER (WHERE NOT online AND kept) AS b FROM r)
  SELECT record_id, online, kept, round(CASE WHEN NOT kept THEN 0 WHEN online THEN 0.3 / a ELSE 0.7 / b END, 9) AS weight FROM r, n""")
def sampler_weights(spark: SparkSession, d: str) -> DataFrame:
    """SMP-19."""
    rows = table(spark, d, "action_policy_batch").select("record_id", F.coalesce(F.col("model_mode") == "policy", F.lit(False)).alias("online"), F.col("fps").isNotNull().alias("kept")).distinct()
    return sampling.mass_weights(rows, "online", "kept", 0.3).withColumn("weight", F.round("weight", 9))


@R.query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR) || '/3')) AS r FROM documents) WHERE r <= 25")
def reservoir_per_group(spark: SparkSession, d: str) -> DataFrame:
    """SMP-07: k rows of each group by hash, cut in slices before the group meets."""
    return sampling.smallest(table(spark, d, "documents").select("lang", "doc_id"), ["lang"], sampling.sha_key(F.col("doc_id"), 3), 25)


@R.query(f"SELECT pair_id, CASE WHEN len(f) = 0 THEN 480 ELSE f[CAST(floor(u * len(f)) AS INT) + 1] END AS tier, u < 0.1 AS no_caption FROM (SELECT pair_id, list_filter([480, 720, 1080], lambda t: t <= length(prompt) * 4) AS f, {_U.format(c='pair_id', s=2)} AS u FROM t2i_pairs WHERE prompt IS NOT NULL)")
def resolution_tier_choice(spark: SparkSession, d: str) -> DataFrame:
    """SMP-21, SMP-22."""
    u = sampling.uniform(F.col("pair_id"), 2)
    return table(spark, d, "t2i_pairs").where("prompt is not null").select("pair_id", sampling.eligible_tier(F.length("prompt") * 4, [480, 720, 1080], u).alias("tier"), (u < 0.1).alias("no_caption"))


# Batching

_ONCE = "s AS (SELECT stream_id, sample_id, min(arrival_no) AS arrival_no, max(sample_len) AS size, max(modality) AS kind FROM pack_samples WHERE sample_len > 0 GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY arrival_no, sample_id) - 1 AS pos FROM s)"


def _arrived(spark: SparkSession, d: str) -> DataFrame:
    from framemill.operators.episodic import numbered

    s = table(spark, d, "pack_samples").where("sample_len > 0").groupBy("stream_id", "sample_id").agg(F.min("arrival_no").alias("arrival_no"), F.max("sample_len").alias("size"), F.max("modality").alias("kind"))
    return numbered(s, ["stream_id"], [F.col("arrival_no"), F.col("sample_id")], "pos")


@R.query(f"WITH {_ONCE} SELECT stream_id, sample_id, pos // 32 AS batch, pos % 32 AS place FROM o")
def batch_fixed(spark: SparkSession, d: str) -> DataFrame:
    """PCK-01, PCK-09."""
    return _arrived(spark, d).select("stream_id", "sample_id", batching.fixed(F.col("pos"), 32).alias("batch"), (F.col("pos") % 32).alias("place"))


def _shards(spark: SparkSession, d: str) -> DataFrame:
    return _arrived(spark, d).withColumn("shard", batching.sharded(F.col("pos"), 2000)).select("stream_id", "shard", "pos", "sample_id", "size", "kind")


@R.query()
def pack_sequential(spark: SparkSession, d: str) -> DataFrame:
    """PCK-02, PCK-05, UDF-04: checked against a plain replay in the tests."""
    return batching.packed(_shards(spark, d), ["stream_id", "shard"], "pos", "size", "sequential", limit=20_000)


@R.query()
def pack_pool(spark: SparkSession, d: str) -> DataFrame:
    """PCK-03, PCK-04: checked against a plain replay in the tests."""
    return batching.packed(_shards(spark, d), ["stream_id", "shard"], "pos", "size", "pooled", limit=20_000)


@R.query(f"""WITH RECURSIVE {_ONCE}, t AS (SELECT stream_id, pos // 2000 AS shard, pos % 2000 AS p, sample_id, size FROM o),
  f AS (SELECT stream_id, shard, p, sample_id, size, CAST(size AS BIGINT) AS total, 0::BIGINT AS batch FROM t WHERE p = 0
    UNION ALL SELECT t.stream_id, t.shard, t.p, t.sample_id, t.size, CASE WHEN f.total + t.size > 20000 THEN t.size ELSE f.total + t.size END, CASE WHEN f.total + t.size > 20000 THEN f.batch + 1 ELSE f.batch END FROM f JOIN t ON t.stream_id = f.stream_id AND t.shard = f.shard AND t.p = f.p + 1)
  SELECT stream_id, shard, sample_id, batch FROM f""")
def pack_inference(spark: SparkSession, d: str) -> DataFrame:
    """PCK-06: nothing is dropped, a sample over the budget goes alone."""
    return batching.packed(_shards(spark, d), ["stream_id", "shard"], "pos", "size", "greedy", limit=20_000).select("stream_id", "shard", "sample_id", "batch")


@R.query("SELECT chunk_index, file_index, CAST(b // 65536 AS BIGINT) AS dst FROM (SELECT chunk_index, file_index, coalesce(sum(size) OVER (ORDER BY chunk_index, file_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT chunk_index, file_index, max(size_bytes) AS size FROM data_files GROUP BY 1, 2))")
def file_rotation(spark: SparkSession, d: str) -> DataFrame:
    """PCK-07, PCK-08, SNK-03, SNK-05, EDT-03: a running sum over all files, not a fold in one task."""
    f = table(spark, d, "data_files").groupBy("chunk_index", "file_index").agg(F.max("size_bytes").alias("size"))
    cum = running_sum(f, "size", [F.col("chunk_index"), F.col("file_index")], "before", "rotation")
    return cum.select("chunk_index", "file_index", editing.file_bins("before", "size", 65536).alias("dst"))


@R.query("WITH n AS (SELECT episode_index, row_number() OVER (ORDER BY episode_index) - 1 AS no FROM episodes) SELECT episode_index, no // 50 AS chunk, no % 50 AS file FROM n")
def chunk_file_counter(spark: SparkSession, d: str) -> DataFrame:
    """SNK-06."""
    rows = sampling.positions(table(spark, d, "episodes").select("episode_index"), [F.col("episode_index")], "no")
    chunk, file = editing.chunk_and_file("no", 50)
    return rows.select("episode_index", chunk.alias("chunk"), file.alias("file"))


@R.query("""WITH s AS (SELECT sample_id, any_value(split_lens) AS l FROM pack_samples WHERE len(split_lens) > 0 GROUP BY 1), x AS (SELECT sample_id, unnest(range(0, len(l))) AS k, unnest(l) AS n FROM s)
  SELECT sample_id, k, CAST(sum(n) OVER (PARTITION BY sample_id ORDER BY k) - n AS BIGINT) AS start, CAST(sum(n) OVER (PARTITION BY sample_id ORDER BY k) AS BIGINT) AS stop, CAST(ceil(n / 64.0) * 64 AS BIGINT) AS padded FROM x""")
def sequence_offsets(spark: SparkSession, d: str) -> DataFrame:
    """PCK-10..12: spans of a pack with their offsets and padded lengths."""
    s = table(spark, d, "pack_samples").where("size(split_lens) > 0").groupBy("sample_id").agg(F.any_value("split_lens").alias("l"))
    x = s.select("sample_id", F.posexplode("l").alias("k", "n"))
    return batching.offsets(x, ["sample_id"], "k", "n").select("sample_id", F.col("k").cast("bigint").alias("k"), "start", "stop", batching.rounded_up(F.col("n"), 64).alias("padded"))


@R.query(f"WITH {_ONCE} SELECT stream_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS tokens, count(*) FILTER (WHERE size >= 20000) AS dropped_count FROM o GROUP BY stream_id")
def packing_metrics(spark: SparkSession, d: str) -> DataFrame:
    """AGG-27: what the sequential packer holds and what it cannot."""
    p = batching.packed(_shards(spark, d), ["stream_id", "shard"], "pos", "size", "sequential", limit=20_000)
    return p.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens"), F.count(F.when(F.col("batch").isNull(), 1)).alias("dropped_count"))


# Editing

_A = "SELECT episode_index, domain_name, fps, num_frames FROM episodes WHERE fps <= 15"
_B = "SELECT episode_index, domain_name, fps, tasks FROM episodes WHERE fps > 15"


@R.query(f"SELECT episode_index, domain_name, fps, 0 AS dataset_index FROM ({_A}) UNION ALL SELECT episode_index, domain_name, fps, 1 FROM ({_B})")
def union_common_columns(spark: SparkSession, d: str) -> DataFrame:
    """SET-01, SET-03, SRC-09."""
    e = table(spark, d, "episodes")
    a = e.where("fps <= 15").select("episode_index", "domain_name", "fps", "num_frames")
    return editing.union_common([a, e.where("fps > 15").select("episode_index", "domain_name", "fps", "tasks")])


@R.query("""WITH a AS (SELECT task, 0 AS part, task_index AS k FROM tasks WHERE contains(task, 'a') UNION ALL SELECT task, 1, 47 - task_index FROM tasks), f AS (SELECT task, min((part, k)) AS f FROM a GROUP BY task)
  SELECT task, row_number() OVER (ORDER BY f, task) - 1 AS task_index FROM f""")
def union_tasks(spark: SparkSession, d: str) -> DataFrame:
    """SET-02, SET-06."""
    t = table(spark, d, "tasks")
    return editing.task_union([t.where("contains(task, 'a')"), t.select("task", (47 - F.col("task_index")).alias("task_index"))], "task", "task_index")


@R.query("""WITH n AS (SELECT max(episode_index) + 1 AS e, CAST(sum(coalesce(num_frames, 0)) AS BIGINT) AS f FROM episodes WHERE fps <= 15)
  SELECT episode_index, dataset_from_index FROM episodes WHERE fps <= 15 UNION ALL SELECT episode_index + e, dataset_from_index + f FROM episodes, n WHERE fps > 15""")
def merge_datasets(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-19: numbers of a second table of episodes moved behind those of the first; ``store_merge`` merges data sets."""
    e = table(spark, d, "episodes")
    a, b = e.where("fps <= 15"), e.where("fps > 15")
    n = a.agg((F.max("episode_index") + 1).alias("e"), F.sum(F.coalesce("num_frames", F.lit(0))).alias("f")).first()
    cols = ["episode_index", "dataset_from_index"]
    return a.select(cols).union(editing.shifted(b, "episode_index", "dataset_from_index", n["e"] or 0, n["f"] or 0).select(cols))


@R.query(f"""WITH {STEPS}, k AS (SELECT episode_index AS ep, row_number() OVER (ORDER BY episode_index) - 1 AS new_index FROM episodes WHERE episode_index NOT IN (SELECT episode_index FROM episodes WHERE domain_name = 'roadview'))
  SELECT new_index, count(*) AS n FROM steps JOIN k USING (ep) GROUP BY 1""")
def delete_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Frames of the remaining episodes under new numbers; ``store_delete`` rewrites a data set."""
    e = table(spark, d, "episodes").select(F.col("episode_index").alias("ep"), "domain_name")
    left = editing.without(steps(spark, d).select("ep", "i"), e, e.where("domain_name = 'roadview'"), "ep")
    return left.groupBy("new_index").agg(F.count(F.lit(1)).alias("n"))


@R.query("""WITH t AS (SELECT episode_index, CASE WHEN fps > 25 THEN 'fast' WHEN num_frames IS NULL THEN 'open' ELSE coalesce(tasks[1], 'open') END AS task_text FROM episodes), dim AS (SELECT task_text, row_number() OVER (ORDER BY task_text) - 1 AS task_no FROM (SELECT DISTINCT task_text FROM t))
  SELECT episode_index, task_text, task_no FROM t JOIN dim USING (task_text)""")
def retask(spark: SparkSession, d: str) -> DataFrame:
    """EDT-07."""
    e = table(spark, d, "episodes").select("episode_index", "fps", F.when(F.col("num_frames").isNull(), F.lit("open")).otherwise(F.coalesce(F.try_element_at("tasks", F.lit(1)), F.lit("open"))).alias("old"))
    o = table(spark, d, "episodes").where("fps > 25").select("episode_index", F.lit("fast").alias("new_task"))
    return editing.relabelled(e, "old", o, "episode_index", None).select("episode_index", "task_text", "task_no")


@R.query("SELECT episode_index FROM (SELECT episode_index FROM episodes WHERE fps > 10 UNION ALL SELECT episode_index FROM episodes WHERE num_frames > 60) GROUP BY 1 HAVING count(*) > 1")
def split_overlap_check(spark: SparkSession, d: str) -> DataFrame:
    """SET-05, SET-07."""
    e = table(spark, d, "episodes")
    return editing.overlapping(e.where("fps > 10").select("episode_index").union(e.where("num_frames > 60").select("episode_index")), "episode_index")


@R.query("""WITH top AS (SELECT max(task_index) AS t FROM tasks), f AS (SELECT DISTINCT prompt AS task FROM action_policy_batch WHERE prompt IS NOT NULL AND prompt NOT IN (SELECT task FROM tasks WHERE task IS NOT NULL))
  SELECT task, row_number() OVER (ORDER BY task) + t AS task_index FROM f, top""")
def append_new_tasks(spark: SparkSession, d: str) -> DataFrame:
    """EDT-12, SNK-09."""
    want = table(spark, d, "action_policy_batch").select(F.col("prompt").alias("task"))
    return editing.new_tasks(table(spark, d, "tasks"), want, "task", "task_index")


@R.query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 20")
def top_k_documents(spark: SparkSession, d: str) -> DataFrame:
    """SRT-05, SRT-07: a top-k report."""
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc_nulls_last("n_chars"), "doc_id").limit(20)


@R.query("SELECT chunk_index, file_index, min(global_index) AS start_index, count(*) AS n FROM frames WHERE chunk_index IS NOT NULL AND file_index IS NOT NULL GROUP BY 1, 2")
def file_start_index(spark: SparkSession, d: str) -> DataFrame:
    """SRC-03: the least global row of each (chunk, file), from which its rows count."""
    rows = table(spark, d, "frames").where("chunk_index is not null and file_index is not null")
    return rows.groupBy("chunk_index", "file_index").agg(F.min("global_index").alias("start_index"), F.count(F.lit(1)).alias("n"))
