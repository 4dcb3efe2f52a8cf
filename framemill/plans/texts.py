"""Queries of text, JSON, conversation and size functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framemill.functions import captions as C
from framemill.plans.registry import Registry
from framemill.session import table

R = Registry()


@R.query("""SELECT episode_index, 'Clip ' || domain_name || CASE WHEN rtrim('Clip ' || domain_name) LIKE '%.' THEN ' ' ELSE '. ' END || printf('The video is %.1f seconds long and is of %.0f FPS.', floor(num_frames / fps), fps) AS caption FROM episodes WHERE fps > 0 AND num_frames IS NOT NULL AND domain_name IS NOT NULL""")
def metadata_suffix(spark: SparkSession, d: str) -> DataFrame:
    """STR-03, STR-43."""
    e = table(spark, d, "episodes").where("fps > 0 and num_frames is not null and domain_name is not null")
    return e.select("episode_index", C.with_sentence(F.concat(F.lit("Clip "), "domain_name"), C.duration_sentence(F.col("num_frames"), F.col("fps"))).alias("caption"))


_VIEWS = "MAP {'ego_view': 'This video is captured from a first-person perspective looking at the scene.', 'wrist_view': 'This video is captured from a wrist-mounted camera.'}"


@R.query(f"""SELECT record_id, prompt || CASE WHEN rtrim(prompt) LIKE '%.' THEN ' ' ELSE '. ' END || printf('This video is of %dx%d resolution.', image_size, image_size) AS sized,
  CASE WHEN action_chunk_size IS NULL THEN printf('IdleFrames: %d.', image_size % 7) ELSE printf('IdleFrames: %d out of %d.', image_size % 7, action_chunk_size) END AS idle,
  {_VIEWS}[view_point] AS seen FROM action_policy_batch WHERE prompt <> '' AND image_size IS NOT NULL""")
def size_idle_view_suffix(spark: SparkSession, d: str) -> DataFrame:
    """STR-04, STR-05, STR-06, STR-07."""
    a = table(spark, d, "action_policy_batch").where("prompt <> '' and image_size is not null")
    s = F.col("image_size")
    return a.select("record_id", C.with_sentence(F.col("prompt"), C.size_sentence(s, s)).alias("sized"), C.idle_sentence(s % 7, F.col("action_chunk_size")).alias("idle"), C.view_sentence(F.col("view_point")).alias("seen"))


@R.query("""SELECT pair_id, CASE WHEN starts_with(trim(prompt), '{') THEN trim(prompt) ELSE regexp_replace(trim(prompt), '\\.+$', '') || '.' END AS caption FROM t2i_pairs WHERE prompt IS NOT NULL AND NOT regexp_matches(prompt, '\\s$|^\\s')""")
def dense_caption_text(spark: SparkSession, d: str) -> DataFrame:
    """STR-01, S20 for prompts without white space at their ends, as the SQL has it; ``dense_caption_all`` has every prompt."""
    return table(spark, d, "t2i_pairs").where("prompt is not null").where(~F.col("prompt").rlike(r"\s$|^\s")).select("pair_id", C.dense_text(F.col("prompt")).alias("caption"))


@R.query(f"""SELECT pair_id, CASE WHEN starts_with(t, '{{') THEN t ELSE rtrim(t, '.') || '.' END AS caption FROM (SELECT pair_id, regexp_replace(prompt, '{C.OUTER_SPACE}', '', 'g') AS t FROM t2i_pairs WHERE prompt IS NOT NULL)""")
def dense_caption_all(spark: SparkSession, d: str) -> DataFrame:
    """STR-01, S20: every prompt that is not null."""
    return table(spark, d, "t2i_pairs").where("prompt is not null").select("pair_id", C.dense_text(F.col("prompt")).alias("caption"))


@R.query("""SELECT pair_id, coalesce(nullif(trim(CASE WHEN pair_id % 3 = 0 THEN ' ' ELSE extra_prompt END), ''), nullif(trim(model_mode), '')) AS caption FROM t2i_pairs""")
def caption_priority(spark: SparkSession, d: str) -> DataFrame:
    """SRT-08, STR-02: the first caption of a priority list that is not blank, from a map of named captions."""
    m = F.create_map(F.lit("m1_enhanced_caption"), F.when(F.col("pair_id") % 3 == 0, F.lit(" ")).otherwise(F.col("extra_prompt")), F.lit("a_caption"), F.col("model_mode"))
    return table(spark, d, "t2i_pairs").select("pair_id", C.window_caption(m, "m2", "m1").alias("caption"))


@R.query("""WITH t AS (SELECT event_id, abs(value) * 97.5 AS s FROM events WHERE value IS NOT NULL), m AS (SELECT event_id, s, CAST(floor(s / 60) AS BIGINT) AS mi FROM t)
  SELECT event_id, printf('%02d:%02d:%02d', mi // 60, mi % 60, CAST(floor(s - mi * 60) AS BIGINT)) AS hms, printf('%d:%02d', CAST(floor(s) AS BIGINT) // 60, CAST(floor(s) AS BIGINT) % 60) AS ms FROM m""")
def timestamp_format(spark: SparkSession, d: str) -> DataFrame:
    """STR-09, STR-10."""
    s = F.abs("value") * 97.5
    return table(spark, d, "events").where("value is not null").select("event_id", C.clock(s).alias("hms"), C.short_clock(F.floor(s)).alias("ms"))


@R.query("SELECT DISTINCT width, height, CAST(width // gcd(width, height) AS VARCHAR) || ',' || CAST(height // gcd(width, height) AS VARCHAR) AS ratio, CASE WHEN width / height < 0.65 THEN '9,16' WHEN width / height < 0.88 THEN '3,4' WHEN width / height < 1.16 THEN '1,1' WHEN width / height < 1.55 THEN '4,3' ELSE '16,9' END AS bucket FROM (SELECT p_size * 16 AS width, (p_partkey % 50 + 1) * 9 AS height FROM part)")
def aspect_ratio_and_bucket(spark: SparkSession, d: str) -> DataFrame:
    """STR-19, STR-20, S24."""
    p = table(spark, d, "part").select((F.col("p_size") * 16).alias("width"), ((F.col("p_partkey") % 50 + 1) * 9).alias("height")).distinct()
    w, h = F.col("width"), F.col("height")
    return p.select("width", "height", C.reduced_ratio(w, h).alias("ratio"), C.aspect_bucket(w, h).alias("bucket"))


@R.query("SELECT doc_id, trim(regexp_extract('<a>' || source || '</a> tail', '<a>(.*?)</a>', 1)) AS inner_text, clip_uuid AS bucket, source AS key FROM documents WHERE source IS NOT NULL AND clip_uuid IS NOT NULL")
def tag_fence_uri(spark: SparkSession, d: str) -> DataFrame:
    """STR-14, STR-15, STR-44, CHT-06."""
    docs = table(spark, d, "documents").where("source is not null and clip_uuid is not null")
    b, k = C.uri_parts(F.concat(F.lit("s3://"), "clip_uuid", F.lit("/"), "source"))
    return docs.select("doc_id", C.bare_tag(F.concat(F.lit("<a>"), "source", F.lit("</a> tail")), "a").alias("inner_text"), b.alias("bucket"), k.alias("key"))


@R.query()
def structured_json_recovery(spark: SparkSession, d: str) -> DataFrame:
    """STR-16, STR-17, STR-37: the object in an answer, whatever surrounds it."""
    return table(spark, d, "t2i_pairs").select("pair_id", C.recovered_json()("prompt").alias("object")).where("object is not null")


@R.query()
def number_formatting(spark: SparkSession, d: str) -> DataFrame:
    """STR-08."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", C.rounded_numbers(2)("text").alias("text"))


@R.query()
def repeated_marker_compression(spark: SparkSession, d: str) -> DataFrame:
    """STR-11."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", C.squeezed_repeats()("text").alias("text"))


@R.query("SELECT doc_id, len(regexp_extract_all(text, '-?\\d+\\.?\\d*(?:[eE][+-]?\\d+)?')) AS n FROM documents WHERE text IS NOT NULL")
def float_format_count(spark: SparkSession, d: str) -> DataFrame:
    """STR-08: how many numbers a text holds."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"-?\d+\.?\d*(?:[eE][+-]?\d+)?"), F.lit(0))).cast("bigint").alias("n"))


@R.query("SELECT record_id, view_point, CASE model_mode WHEN 'policy' THEN 'user' WHEN 'forward_dynamics' THEN 'assistant' END AS role FROM action_policy_batch")
def role_normalize(spark: SparkSession, d: str) -> DataFrame:
    """STR-30."""
    raw = F.when(F.col("model_mode") == "policy", "human").when(F.col("model_mode") == "forward_dynamics", "gpt").otherwise("tool")
    return table(spark, d, "action_policy_batch").select("record_id", "view_point", C.role(raw).alias("role"))


@R.query("""SELECT pair_id, CASE WHEN coalesce(prompt_lang, '') = '' THEN coalesce(extra_prompt, '') ELSE '<think>' || chr(10) || prompt_lang || chr(10) || '</think>' || chr(10) || chr(10) || coalesce(extra_prompt, '') END AS folded, CASE WHEN coalesce(prompt_lang, '') = '' THEN 1 ELSE 4 END AS n_parts FROM t2i_pairs""")
def conversation_fold(spark: SparkSession, d: str) -> DataFrame:
    """STR-31, STR-32, CHT-01."""
    parts = C.with_reasoning(F.coalesce("extra_prompt", F.lit("")), F.col("prompt_lang"))
    return table(spark, d, "t2i_pairs").select("pair_id", F.concat_ws("", F.transform(parts, lambda p: p["text"])).alias("folded"), F.size(parts).alias("n_parts"))


@R.query("SELECT doc_id, 'image,' || CASE WHEN lang = 'zh' THEN 'video,' ELSE '' END || 'text' AS kinds, 'i' || doc_id AS media FROM documents")
def text_media_order(spark: SparkSession, d: str) -> DataFrame:
    """STR-33, STR-38, CHT-02, CHT-03: media before texts, and the first reference."""
    part = lambda kind, ref: F.struct(F.lit(kind).alias("type"), ref.cast("string").alias("ref"))
    i = F.concat(F.lit("i"), F.col("doc_id").cast("string"))
    base = F.array(part("text", F.lit(None)), part("image", i))
    parts = F.when(F.col("lang") == "zh", F.concat(base, F.array(part("video", i)))).otherwise(base)
    ordered = C.media_first(parts)
    return table(spark, d, "documents").select("doc_id", F.concat_ws(",", F.transform(ordered, lambda p: p["type"])).alias("kinds"), C.first_media(ordered).alias("media"))


@R.query("SELECT pair_id, CAST(nullif(regexp_extract(model_mode || ' ' || CAST(pair_id % 8 AS VARCHAR), '\\b([1-5])\\b', 1), '') AS INT) AS score FROM t2i_pairs")
def score_parse(spark: SparkSession, d: str) -> DataFrame:
    """STR-39, STR-40."""
    return table(spark, d, "t2i_pairs").select("pair_id", C.score(F.concat("model_mode", F.lit(" "), (F.col("pair_id") % 8).cast("string"))).alias("score"))


@R.query("SELECT task_index, replace(replace(replace('<img-1> ' || task || ' <img-2>', '<img-1>', '<x>'), '<img-2>', '<img-1>'), '<x>', '<img-2>') AS text FROM tasks")
def marker_renumber(spark: SparkSession, d: str) -> DataFrame:
    """STR-36."""
    t = F.concat(F.lit("<img-1> "), "task", F.lit(" <img-2>"))
    return table(spark, d, "tasks").select("task_index", C.renumbered_markers(t, [2, 1]).alias("text"))


@R.query("""SELECT episode_index, CAST((1 + (num_frames - 1) // 4) * (480 // 32) * (640 // 32) + 2 AS BIGINT) AS tokens, CAST((1 + (num_frames - 1) // 4) * ceil((470 // 16) / 2.0) * ceil((650 // 16) / 2.0) + 2 AS BIGINT) AS tokens_ceil,
  num_frames * 784 * 2 AS pixels, (num_frames * 1000 // 784) // 2 AS back FROM episodes WHERE num_frames > 0""")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """STR-41, S15, CHT-07."""
    n = F.col("num_frames")
    t = lambda h, w, f: C.vision_tokens(n, F.lit(h), F.lit(w), 16, 2, 4, f).cast("bigint")
    return table(spark, d, "episodes").where("num_frames > 0").select("episode_index", t(480, 640, True).alias("tokens"), t(470, 650, False).alias("tokens_ceil"), C.pixels_of_tokens(n).alias("pixels"), C.tokens_of_pixels(n * 1000).alias("back"))


@R.query("""WITH s AS (SELECT DISTINCT p_size * 40 AS w, (p_partkey % 40 + 1) * 30 AS h FROM part), c AS (SELECT w, h, least(1.0, sqrt(100000.0 / (w * h))) AS k FROM s)
  SELECT w, h, CAST(greatest(28, floor(floor(w * k) / 28) * 28) AS BIGINT) AS width, CAST(greatest(28, floor(floor(h * k) / 28) * 28) AS BIGINT) AS height FROM c""")
def capped_image_size(spark: SparkSession, d: str) -> DataFrame:
    """CHT-08, MTH-18, WIN-31."""
    s = table(spark, d, "part").select((F.col("p_size") * 40).alias("w"), ((F.col("p_partkey") % 40 + 1) * 30).alias("h")).distinct()
    w, h = C.capped_size(F.col("w"), F.col("h"), 100_000, 28)
    return s.select("w", "h", w.cast("bigint").alias("width"), h.cast("bigint").alias("height"))


@R.query("""SELECT sample_id, [i >= 4 AND i <= len(l) + 4 FOR i IN range(1, len(l) + 7)] AS mask FROM (SELECT sample_id, any_value(split_lens) AS l FROM pack_samples WHERE len(split_lens) > 0 GROUP BY 1)""")
def assistant_token_mask(spark: SparkSession, d: str) -> DataFrame:
    """CHT-05: [start, role, break, tokens.., end, start, other role]."""
    s = table(spark, d, "pack_samples").where("size(split_lens) > 0").groupBy("sample_id").agg(F.any_value("split_lens").alias("l"))
    body = F.transform("l", lambda v: F.abs(v) + 100)
    tokens = F.concat(F.array(F.lit(1), F.lit(7), F.lit(9)), body, F.array(F.lit(2)), F.array(F.lit(1), F.lit(8)))
    closed = F.concat(tokens, F.array().cast("array<int>"))
    return s.select("sample_id", C.assistant_mask(closed, 1, 2, 7).alias("mask"))


@R.query("SELECT task_index, '<|im_start|>user' || chr(10) || task || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS chat FROM tasks")
def chat_template(spark: SparkSession, d: str) -> DataFrame:
    """CHT-04."""
    msgs = F.array(F.struct(F.lit("user").alias("role"), F.col("task").alias("text")))
    body = F.array_join(F.transform(msgs, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["text"], F.lit("<|im_end|>\n"))), "")
    return table(spark, d, "tasks").select("task_index", F.concat(body, F.lit("<|im_start|>assistant\n")).alias("chat"))


@R.query("""SELECT episode_index, json_object('domain', domain_name, 'frames', num_frames)::VARCHAR AS prompt FROM episodes WHERE domain_name IS NOT NULL AND num_frames IS NOT NULL""")
def action_prompt_json(spark: SparkSession, d: str) -> DataFrame:
    """STR-18, STR-21, STR-22: fields without a value are left out."""
    e = table(spark, d, "episodes").where("domain_name is not null and num_frames is not null")
    return e.select("episode_index", F.to_json(F.struct(F.col("domain_name").alias("domain"), F.col("num_frames").alias("frames"), F.lit(None).cast("string").alias("nothing"))).alias("prompt"))


@R.query("SELECT e.episode_index, t AS k, h AS row_no, w AS col_no FROM (SELECT episode_index FROM episodes) e, range(0, 2) a(t), range(0, 2) b(h), range(0, 3) c(w)")
def grid_position_ids(spark: SparkSession, d: str) -> DataFrame:
    """Positions of a time-height-width grid, without offsets, frame rates or text."""
    e = table(spark, d, "episodes").select("episode_index")
    seq = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    return e.withColumn("k", seq(2)).withColumn("row_no", seq(2)).withColumn("col_no", seq(3))


@R.query("SELECT sample_id, l[2:3] AS part FROM (SELECT sample_id, any_value(split_lens) AS l FROM pack_samples WHERE len(split_lens) > 0 GROUP BY 1)")
def slice_fields(spark: SparkSession, d: str) -> DataFrame:
    """MTH-25."""
    s = table(spark, d, "pack_samples").where("size(split_lens) > 0").groupBy("sample_id").agg(F.any_value("split_lens").alias("l"))
    return s.select("sample_id", F.slice("l", 2, 2).alias("part"))
