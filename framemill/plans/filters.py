"""Queries of filters, projections and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framemill.operators import curation, lookups
from framemill.plans.base import STEPS, steps
from framemill.plans.registry import Registry
from framemill.session import broadcast_if_small, table

R = Registry()

_REASON = """CASE WHEN episode_index IS NULL OR recording_id IS NULL THEN 'missing_identity' WHEN fps IS NULL OR image_size IS NULL OR view_point IS NULL THEN 'missing_metadata'
  WHEN fps > 25 THEN 'rate_too_high' WHEN image_size < 300 THEN 'short_edge_too_small' WHEN coalesce(trim(prompt), '') = '' THEN 'no_caption' END"""


def _reasoned(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    checks = [
        ("missing_identity", c("episode_index").isNull() | c("recording_id").isNull()),
        ("missing_metadata", c("fps").isNull() | c("image_size").isNull() | c("view_point").isNull()),
        ("rate_too_high", c("fps") > 25),
        ("short_edge_too_small", c("image_size") < 300),
        ("no_caption", F.coalesce(F.trim("prompt"), F.lit("")) == ""),
    ]
    return table(spark, d, "action_policy_batch").withColumn("reason", curation.first_reason(checks))


@R.query(f"SELECT record_id, episode_index, prompt FROM action_policy_batch WHERE {_REASON} IS NULL")
def curation_kept(spark: SparkSession, d: str) -> DataFrame:
    """FLT-01, FLT-03, FLT-21: rows without a drop reason."""
    return _reasoned(spark, d).where("reason is null").select("record_id", "episode_index", "prompt")


@R.query(f"SELECT {_REASON} AS reason, count(*) AS n FROM action_policy_batch GROUP BY 1 HAVING reason IS NOT NULL")
def curation_drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    """AGG-15, SRT-04, SNK-11."""
    return curation.reason_counts(_reasoned(spark, d))


_WORDS = ["robot", "window", "Crosswalk"]


@R.query("SELECT doc_id FROM documents WHERE trim(text) = '' OR text IS NULL OR contains(lower(text), 'robot') OR contains(lower(text), 'window') OR contains(lower(text), 'crosswalk')")
def keyword_filter_include(spark: SparkSession, d: str) -> DataFrame:
    """FLT-04."""
    return table(spark, d, "documents").where(curation.keyword_pass(F.col("text"), _WORDS, True)).select("doc_id")


@R.query("SELECT doc_id FROM documents WHERE coalesce(contains(source, 'notes'), false) OR trim(text) = '' OR text IS NULL OR NOT (contains(lower(text), 'robot') OR contains(lower(text), 'window') OR contains(lower(text), 'crosswalk'))")
def keyword_filter_exclude(spark: SparkSession, d: str) -> DataFrame:
    """FLT-04, with sources that bypass the filter."""
    return table(spark, d, "documents").where(curation.keyword_pass(F.col("text"), _WORDS, False, F.col("source").contains("notes"))).select("doc_id")


@R.query("""SELECT source, count(*) AS n, count(*) FILTER (WHERE contains(lower(text), 'robot')) AS n_found, round(100.0 * count(*) FILTER (WHERE contains(lower(text), 'robot')) / count(*), 6) AS percent FROM documents GROUP BY source""")
def keyword_filter_statistics(spark: SparkSession, d: str) -> DataFrame:
    """AGG-16."""
    hit = F.count(F.when(curation.has_keyword(F.col("text"), ["robot"]), 1))
    n = F.count(F.lit(1))
    return table(spark, d, "documents").groupBy("source").agg(n.alias("n"), hit.alias("n_found"), F.round(100.0 * hit / n, 6).alias("percent"))


_TIERS = [("third_person", 480, 400), ("ego_view", 300, 500)]


@R.query("""SELECT record_id FROM action_policy_batch LEFT JOIN (VALUES ('third_person', 480, 400), ('ego_view', 300, 500)) t(view_point, w, h) USING (view_point)
  WHERE NOT coalesce(image_size < w AND image_size < h, false)""")
def resolution_tier_filter(spark: SparkSession, d: str) -> DataFrame:
    """FLT-05, FLT-11: dropped only when both sides are below the tier's minimum."""
    tiers = spark.createDataFrame(_TIERS, "view_point string, w int, h int")
    small = curation.below_tier(F.col("image_size"), F.col("image_size"), F.col("w"), F.col("h"))
    return table(spark, d, "action_policy_batch").join(F.broadcast(tiers), "view_point", "left").where(~F.coalesce(small, F.lit(False))).select("record_id")


_PATH = "'set/frames_' || CASE WHEN num_frames < 40 THEN 'gt_30' WHEN num_frames < 80 THEN '40_80' WHEN num_frames < 200 THEN '80_200' ELSE '200_inf' END || '/x.json'"


@R.query(f"""WITH p AS (SELECT episode_index, {_PATH} AS path FROM episodes WHERE num_frames IS NOT NULL),
  b AS (SELECT *, CASE WHEN path LIKE '%gt_30%' OR path LIKE '%inf%' THEN 'inf'::DOUBLE ELSE CAST(regexp_extract(path, 'frames_\\d+_(\\d+)', 1) AS DOUBLE) END AS hi FROM p)
  SELECT episode_index, path FROM b WHERE hi > 80 AND hi <= 200 OR hi IS NULL""")
def bucket_pruning(spark: SparkSession, d: str) -> DataFrame:
    """FLT-09, FLT-10: paths by the bounds coded in them; the lower limit is exclusive, the upper inclusive."""
    n = F.col("num_frames")
    name = F.when(n < 40, "gt_30").when(n < 80, "40_80").when(n < 200, "80_200").otherwise("200_inf")
    rows = table(spark, d, "episodes").where("num_frames is not null").select("episode_index", F.concat(F.lit("set/frames_"), name, F.lit("/x.json")).alias("path"))
    return rows.where(curation.bucket_kept(F.col("path"), min_frames=80, max_frames=200))


@R.query("SELECT pair_id, CASE WHEN contains(' ' || regexp_replace(lower(extra_prompt), '\\W+', ' ', 'g') || ' ', ' kitchen robot ') THEN 'kitchen robot' WHEN contains(' ' || regexp_replace(lower(extra_prompt), '\\W+', ' ', 'g') || ' ', ' ceramic mug ') THEN 'ceramic mug' END AS word FROM t2i_pairs WHERE word IS NOT NULL")
def blocklist_exact(spark: SparkSession, d: str) -> DataFrame:
    """FLT-14, JON-16, STR-13: whole words, whatever the case and spacing."""
    return table(spark, d, "t2i_pairs").select("pair_id", curation.word_match(F.col("extra_prompt"), ["kitchen robot", "ceramic mug"]).alias("word")).where("word is not null")


@R.query()
def blocklist_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """FLT-15: stretches within one letter of a listed phrase; checked against brute force in the tests."""
    return curation.fuzzy_match(table(spark, d, "t2i_pairs"), "pair_id", "extra_prompt", ["cetamic mug", "kitchin robot"])


@R.query("SELECT task_index, list_aggregate(list_transform(string_split(task, ' '), lambda w: CASE WHEN lower(regexp_replace(w, '^\\W+|\\W+$', '', 'g')) IN ('chair', 'bus') THEN '****' ELSE w END), 'string_agg', ' ') AS censored FROM tasks")
def censored_prompts(spark: SparkSession, d: str) -> DataFrame:
    """FLT-16: listed words masked, allowed ones restored."""
    return table(spark, d, "tasks").select("task_index", curation.masked_words(F.col("task"), ["chair", "bus", "counter"], ["counter"]).alias("censored"))


@R.query("""SELECT pair_id, CASE WHEN coalesce(trim(prompt), '') = '' THEN 'empty' WHEN contains(lower(prompt), 'conveyor') THEN 'word' WHEN contains(lower(prompt), 'tram') THEN 'phrase' ELSE 'safe' END AS verdict FROM t2i_pairs""")
def safety_verdict(spark: SparkSession, d: str) -> DataFrame:
    """FLT-17, FLT-18: the first check that speaks decides."""
    p = F.col("prompt")
    checks = [("empty", F.coalesce(F.trim(p), F.lit("")) == ""), ("word", curation.has_keyword(p, ["conveyor"])), ("phrase", curation.has_keyword(p, ["tram"]))]
    return table(spark, d, "t2i_pairs").select("pair_id", F.coalesce(curation.first_reason(checks), F.lit("safe")).alias("verdict"))


@R.query("""SELECT doc_id, least(n, 40) AS n_kept FROM (SELECT doc_id, len(string_split(text, ' ')) AS n, string_split(text, ' ') AS t FROM documents WHERE text IS NOT NULL) WHERE n <= 40 OR NOT list_contains(t[41:], 'robot')""")
def length_filter_truncate(spark: SparkSession, d: str) -> DataFrame:
    """FLT-07: long sequences are cut, or dropped where the cut part holds a media token."""
    tokens = F.split("text", " ")
    kept, cut = curation.length_rule(tokens, 40, ["robot"])
    return table(spark, d, "documents").where("text is not null").where(kept).select("doc_id", F.size(cut).cast("bigint").alias("n_kept"))


@R.query("""SELECT record_id, rule FROM (SELECT record_id, 'fps' AS rule FROM action_policy_batch WHERE NOT coalesce(fps BETWEEN 1 AND 24, false)
  UNION ALL SELECT record_id, 'image_size' FROM action_policy_batch WHERE NOT coalesce(image_size >= 256, false) UNION ALL SELECT record_id, 'view_point' FROM action_policy_batch WHERE view_point IS NULL)""")
def frame_validation(spark: SparkSession, d: str) -> DataFrame:
    """FLT-06, FLT-22, FLT-23, FLT-28: every rule a row breaks."""
    rules = {"fps": F.col("fps").between(1, 24), "image_size": F.col("image_size") >= 256, "view_point": F.col("view_point").isNotNull()}
    return curation.violations(table(spark, d, "action_policy_batch"), rules, ["record_id"])


@R.query("SELECT domain_name, count(DISTINCT fps) AS n_rates, count(DISTINCT fps) = 1 AS compatible FROM episodes WHERE fps IS NOT NULL GROUP BY 1")
def metadata_compatibility(spark: SparkSession, d: str) -> DataFrame:
    """FLT-24."""
    e = table(spark, d, "episodes").where("fps is not null").groupBy("domain_name").agg(F.countDistinct("fps").alias("n_rates"))
    return e.withColumn("compatible", F.col("n_rates") == 1)


@R.query("SELECT episode_index, list_sort(list_distinct(tasks)) AS tasks, len(tasks) > 1 AND len(list_distinct(tasks)) < len(tasks) AS repeated FROM episodes WHERE tasks IS NOT NULL")
def subtask_annotation_check(spark: SparkSession, d: str) -> DataFrame:
    """FLT-27: annotations of an episode, repeats found."""
    t = F.col("tasks")
    return table(spark, d, "episodes").where("tasks is not null").select("episode_index", F.array_sort(F.array_distinct(t)).alias("tasks"), ((F.size(t) > 1) & (F.size(F.array_distinct(t)) < F.size(t))).alias("repeated"))


@R.query(f"WITH {STEPS} SELECT ep, i, tasks.task AS task FROM steps LEFT JOIN tasks ON steps.task = tasks.task_index")
def task_dimension_join(spark: SparkSession, d: str) -> DataFrame:
    """JON-02, SRC-06."""
    dim = broadcast_if_small(table(spark, d, "tasks").select(F.col("task_index").alias("k"), F.col("task").alias("name")), 200)
    s = steps(spark, d).select("ep", "i", "task")
    return s.join(dim, s["task"] == dim["k"], "left").select("ep", "i", F.col("name").alias("task"))


@R.query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'BUILDING' AND r_name = 'EUROPE'")
def catalog_join(spark: SparkSession, d: str) -> DataFrame:
    """JON-01, SRC-24, SRC-25."""
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    n = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@R.query("""WITH m AS (SELECT chunk_index, file_index, max(num_rows) AS n FROM data_files WHERE num_rows > 0 GROUP BY 1, 2)
  SELECT episode_index, coalesce(n, -1) AS n_rows, CASE WHEN n IS NULL THEN 0 ELSE m.chunk_index * 2 END AS dst_chunk FROM episodes LEFT JOIN m ON m.chunk_index = data_chunk_index AND m.file_index = data_file_index""")
def composite_remap_default(spark: SparkSession, d: str) -> DataFrame:
    """JON-03."""
    m = table(spark, d, "data_files").where("num_rows > 0").groupBy(F.col("chunk_index").alias("data_chunk_index"), F.col("file_index").alias("data_file_index")).agg(F.max("num_rows").alias("n"))
    m = m.withColumn("dst", F.col("data_chunk_index") * 2)
    e = table(spark, d, "episodes").select("episode_index", "data_chunk_index", "data_file_index")
    out = lookups.remapped(e, m, ["data_chunk_index", "data_file_index"], {"n_rows": "n", "dst_chunk": "dst"}, {"n_rows": F.lit(-1), "dst_chunk": F.lit(0)})
    return out.select("episode_index", "n_rows", "dst_chunk")


_NEAR = f"""WITH q AS (SELECT record_id, episode_index AS ep, CAST(record_id % 40 AS BIGINT) * 333333 AS t FROM (SELECT DISTINCT record_id, episode_index FROM action_policy_batch WHERE episode_index IS NOT NULL)),
  {STEPS}, r AS (SELECT ep, i, CAST(round(ts * 1000000) AS BIGINT) AS t FROM steps WHERE ts IS NOT NULL AND NOT isnan(ts)),
  j AS (SELECT q.record_id, q.ep, q.t, min((abs(r.t - q.t), r.t, r.i)) AS b FROM q LEFT JOIN r ON r.ep = q.ep AND abs(r.t - q.t) {{op}} 60000 GROUP BY 1, 2, 3)"""


def _queries_and_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = table(spark, d, "action_policy_batch").where("episode_index is not null").select("record_id", F.col("episode_index").alias("ep")).distinct()
    q = q.withColumn("t", (F.col("record_id") % 40) * 333333)
    r = steps(spark, d).where("ts is not null and not isnan(ts)").select("ep", "i", F.round(F.col("ts") * 1000000).cast("bigint").alias("rt"))
    return q, r


@R.query(_NEAR.format(op="<") + " SELECT record_id, ep, t, b[1] AS gap, b[3] AS i FROM j WHERE b IS NOT NULL AND b[1] IS NOT NULL")
def asof_nearest_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """JON-05: nearest frame in time, strictly within the tolerance, ties to the earlier."""
    q, r = _queries_and_rows(spark, d)
    out = lookups.asof_nearest(q, r, ["ep"], "t", "rt", 60000, ["i"], ["record_id", "ep", "t"])
    return out.where("gap is not null").select("record_id", "ep", "t", "gap", F.col("i_near").alias("i"))


@R.query(_NEAR.format(op="<=") + " SELECT record_id, ep, t, b[3] AS i, b[1] IS NULL AS is_pad FROM j")
def asof_nearest_pad(spark: SparkSession, d: str) -> DataFrame:
    """JON-06: beyond the tolerance the row is padding."""
    q, r = _queries_and_rows(spark, d)
    out = lookups.asof_nearest(q, r, ["ep"], "t", "rt", 60000, ["i"], ["record_id", "ep", "t"], strict=False)
    return out.select("record_id", "ep", "t", F.col("i_near").alias("i"), F.col("gap").isNull().alias("is_pad"))


@R.query("""WITH l AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, epoch_us(ts) AS t, event_id AS e FROM events WHERE event_type = 'click')
  SELECT l.event_id, max((r.t, r.e))[1] AS rt, max((r.t, r.e))[2] AS click_id FROM l JOIN r ON r.user_id = l.user_id AND r.t <= l.t AND l.t - r.t <= 86400000000 GROUP BY 1""")
def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    """The last earlier row, at most a day back (extra)."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    right = e.where("event_type = 'click'").select("user_id", F.col("t").alias("rt"), F.col("event_id").alias("e"))
    out = lookups.asof_backward(left, right, ["user_id"], "t", "rt", 86_400_000_000, ["e"], ["event_id"])
    return out.where("rt_asof is not null").select("event_id", F.col("rt_asof").alias("rt"), F.col("e_asof").alias("click_id"))


@R.query("SELECT global_index, e.episode_index AS ep, global_index - e.dataset_from_index AS offset_in FROM (SELECT DISTINCT global_index FROM frames) JOIN episodes e ON global_index >= dataset_from_index AND global_index < dataset_to_index")
def range_lookup_bisect(spark: SparkSession, d: str) -> DataFrame:
    """JON-08, JON-09: flat indexes to the episode whose range holds them, as an equi-join on buckets."""
    r = table(spark, d, "episodes").where("dataset_to_index > dataset_from_index").select(F.col("episode_index").alias("ep"), "dataset_from_index", "dataset_to_index")
    p = table(spark, d, "frames").select("global_index").where("global_index is not null").distinct()
    out = lookups.range_lookup(p, r, "global_index", "dataset_from_index", "dataset_to_index", 256)
    return out.select("global_index", "ep", (F.col("global_index") - F.col("dataset_from_index")).alias("offset_in"))


_KEEP = "SELECT episode_index, 5 AS k_start, 25 AS k_stop FROM episodes UNION ALL SELECT episode_index, 30, 200 FROM episodes WHERE fps > 10"


@R.query(f"WITH k AS ({_KEEP}), s AS (SELECT episode_index, 0 AS start, num_frames AS stop FROM episodes WHERE num_frames IS NOT NULL) SELECT episode_index, greatest(start, k_start) AS lo, least(stop, k_stop - 4) AS hi FROM s JOIN k USING (episode_index) WHERE least(stop, k_stop - 4) > greatest(start, k_start)")
def keep_range_intersection(spark: SparkSession, d: str) -> DataFrame:
    """JON-10, FLT-12."""
    e = table(spark, d, "episodes")
    k = e.select("episode_index", F.lit(5).alias("k_start"), F.lit(25).alias("k_stop")).union(e.where("fps > 10").select("episode_index", F.lit(30), F.lit(200)))
    s = e.where("num_frames is not null").select("episode_index", F.lit(0).alias("start"), F.col("num_frames").alias("stop"))
    return lookups.intersect_ranges(s, k, ["episode_index"], 4).select("episode_index", "lo", "hi")


_FILES = "SELECT 'root/' || clip_uuid || '.mp4' AS path FROM documents WHERE lang = 'en' UNION SELECT 'root/' || clip_uuid || '_depth.mp4' FROM documents WHERE source = 'lab_notes'"


@R.query(f"WITH f AS ({_FILES}) SELECT doc_id, CASE WHEN ('root/' || clip_uuid || '.mp4') IN (SELECT path FROM f WHERE path IS NOT NULL) THEN 'root/' || clip_uuid || '.mp4' WHEN ('root/' || clip_uuid || '_depth.mp4') IN (SELECT path FROM f WHERE path IS NOT NULL) THEN 'root/' || clip_uuid || '_depth.mp4' END AS control FROM documents WHERE clip_uuid IS NOT NULL")
def file_priority_join(spark: SparkSession, d: str) -> DataFrame:
    """JON-12, SRC-19: the first candidate path that exists."""
    docs = table(spark, d, "documents")
    plain, depth = F.concat(F.lit("root/"), "clip_uuid", F.lit(".mp4")), F.concat(F.lit("root/"), "clip_uuid", F.lit("_depth.mp4"))
    files = docs.where("lang = 'en'").select(plain.alias("path")).union(docs.where("source = 'lab_notes'").select(depth))
    return lookups.first_found(docs.where("clip_uuid is not null"), files, [plain, depth], "control", "doc_id").select("doc_id", "control")


@R.query("SELECT doc_id FROM documents WHERE clip_uuid IN (SELECT clip_uuid FROM documents WHERE lang = 'zh' AND clip_uuid IS NOT NULL)")
def control_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """JON-13, FLT-08."""
    docs = table(spark, d, "documents")
    return docs.join(docs.where("lang = 'zh'").select("clip_uuid").distinct(), "clip_uuid", "left_semi").select("doc_id")


@R.query("SELECT pair_id FROM t2i_pairs WHERE pair_id NOT IN (SELECT record_id FROM action_policy_batch WHERE record_id IS NOT NULL)")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """JON-14, SNK-16, SET-04."""
    done = table(spark, d, "action_policy_batch").select(F.col("record_id").alias("pair_id")).distinct()
    return table(spark, d, "t2i_pairs").join(done, "pair_id", "left_anti").select("pair_id")


@R.query("SELECT p.pair_id, t.task FROM t2i_pairs p JOIN tasks t ON p.pair_id % 48 = t.task_index")
def caption_prompt_join(spark: SparkSession, d: str) -> DataFrame:
    """JON-15."""
    t = broadcast_if_small(table(spark, d, "tasks"), 200)
    return table(spark, d, "t2i_pairs").join(t, F.col("pair_id") % 48 == F.col("task_index")).select("pair_id", "task")


@R.query(f"""WITH {STEPS}, r AS (SELECT ep, CAST(round(ts * 1000000) AS BIGINT) AS t FROM steps WHERE ts IS NOT NULL AND NOT isnan(ts)),
  ev AS (SELECT record_id, ep, (record_id % 20) * 142857 AS s, (record_id % 20) * 142857 + 900000 AS e FROM (SELECT DISTINCT record_id, episode_index AS ep FROM action_policy_batch WHERE episode_index IS NOT NULL)),
  sn AS (SELECT record_id, ev.ep, min((abs(r.t - s), r.t))[2] AS s, min((abs(r.t - e), r.t))[2] AS e, min(abs(r.t - s)) AS ds, min(abs(r.t - e)) AS de FROM ev JOIN r USING (ep) GROUP BY 1, 2)
  SELECT ep, s, e, string_agg('n' || record_id, ' ' ORDER BY record_id) AS caption FROM sn WHERE ds <= 2000000 AND de <= 2000000 GROUP BY ep, s, e""")
def snap_intervals_merge(spark: SparkSession, d: str) -> DataFrame:
    """JON-07, SRT-03."""
    marks = steps(spark, d).where("ts is not null and not isnan(ts)").select("ep", F.round(F.col("ts") * 1000000).cast("bigint").alias("mark"))
    ev = table(spark, d, "action_policy_batch").where("episode_index is not null").select("record_id", F.col("episode_index").alias("ep")).distinct()
    s = (F.col("record_id") % 20) * 142857
    ev = ev.select("record_id", "ep", s.alias("s0"), (s + 900000).alias("e0"), F.concat(F.lit("n"), F.col("record_id").cast("string")).alias("cap"))
    return lookups.snapped(ev, marks, ["ep"], "s0", "e0", "mark", "cap", "record_id", 2_000_000)


# Projections

@R.query("SELECT doc_id AS id, text AS caption, coalesce(lang, 'en') AS lang FROM documents WHERE text IS NOT NULL")
def rename_keep_merge(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-01..04: renamed, merged from a struct with existing values first, unneeded columns dropped."""
    nested = table(spark, d, "documents").where("text is not null").select(F.struct("doc_id", "text", F.coalesce("lang", F.lit("en")).alias("lang")).alias("s"))
    return nested.select("s.*").withColumnsRenamed({"doc_id": "id", "text": "caption"})


@R.query("""SELECT record_id, CASE WHEN lower(trim(model_mode)) IN ('policy', 'val', 'valid') THEN 'val' ELSE lower(trim(model_mode)) END AS split,
  CASE WHEN contains(domain_name, '://') THEN domain_name ELSE 'data/' || domain_name END AS rel, CASE WHEN contains(domain_name, 'arm') THEN 'arm' WHEN contains(domain_name, 'road') THEN 'road' ELSE 'other' END AS category FROM action_policy_batch""")
def split_and_category(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-15, PRJ-17, PRJ-18, PRJ-20."""
    m, n = F.lower(F.trim("model_mode")), F.col("domain_name")
    cat = F.when(n.contains("arm"), "arm").when(n.contains("road"), "road").otherwise("other")
    return table(spark, d, "action_policy_batch").select("record_id", F.when(m.isin("policy", "val", "valid"), "val").otherwise(m).alias("split"), F.when(n.contains("://"), n).otherwise(F.concat(F.lit("data/"), n)).alias("rel"), cat.alias("category"))


@R.query("SELECT p_partkey, [CAST(p_size AS FLOAT), CAST(p_retailprice AS FLOAT)] AS state, 30.0::DOUBLE AS fps FROM part")
def build_feature_vector(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-05, PRJ-09, PRJ-16: named scalars as a vector, constants attached."""
    return table(spark, d, "part").select("p_partkey", F.array(F.col("p_size").cast("float"), F.col("p_retailprice").cast("float")).alias("state"), F.lit(30.0).alias("fps"))
