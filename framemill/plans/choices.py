"""Queries of captions in chunks, weighted choices, strides, sizes and marked-up answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framemill.functions import captions as C
from framemill.functions import chunks
from framemill.functions.jsontext import parse
from framemill.operators import sampling
from framemill.plans.registry import Registry
from framemill.plans.samples import _U
from framemill.session import shared_dir, table

R = Registry()


def _captioned(spark: SparkSession, d: str) -> DataFrame:
    """Each episode with a caption of chunks of 50 frames as JSON text; every fifth has a plain caption."""
    e = table(spark, d, "episodes").where("num_frames > 0")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("num_frames") - 1, F.lit(50).cast("bigint"))
    each = F.transform(starts, lambda s: F.struct(F.concat(F.lit("chunk_"), s.cast("string")).alias("key"), F.struct(
        s.alias("start_frame"), F.least(s + 50, F.col("num_frames")).alias("end_frame"), F.concat(F.lit("part "), s.cast("string")).alias("caption"),
        F.create_map(F.lit("subject"), F.col("domain_name"), F.lit("light"), F.lit("soft"), F.lit("from"), s.cast("string")).alias("caption_json"),
    ).alias("value")))
    text = F.to_json(F.map_from_entries(each))
    return e.select("episode_index", "domain_name", "num_frames", F.when(F.col("episode_index") % 5 == 0, F.concat(F.lit("plain "), "domain_name")).otherwise(text).alias("caption"))


_CUT = f"e AS (SELECT episode_index, domain_name, num_frames, range(0, num_frames, 50) AS s, {_U.format(c='episode_index', s=21)} AS u FROM episodes WHERE num_frames > 0), p AS (SELECT *, s[CAST(floor(u * len(s)) AS BIGINT) + 1] AS first FROM e)"


@R.query(f"WITH {_CUT} SELECT episode_index, CASE WHEN episode_index % 5 = 0 THEN 'plain ' || domain_name ELSE 'part ' || first END AS text FROM p")
def caption_multi_chunk(spark: SparkSession, d: str) -> DataFrame:
    """STR-23, STR-27: the text of one chunk of a caption that is a JSON object of chunks; a plain caption passes through."""
    return _captioned(spark, d).select("episode_index", chunks.plain_or_chunk(F.col("caption"), sampling.uniform(F.col("episode_index"), 21)).alias("text"))


_DROP = _U.format(c="(episode_index || ':' || k)", s=22)


@R.query(f"""WITH {_CUT}, c AS (SELECT * FROM p WHERE episode_index % 5 <> 0), f AS (SELECT episode_index, unnest(['subject', 'light', 'from']) AS k FROM c), kept AS (SELECT episode_index, string_agg(k, ',' ORDER BY k) AS fields FROM f WHERE {_DROP} >= 0.3 GROUP BY 1)
  SELECT episode_index, first AS start_frame, least(first + 50, num_frames) AS end_frame, coalesce(fields, '') AS fields FROM c LEFT JOIN kept USING (episode_index)""")
def caption_json_chunk(spark: SparkSession, d: str) -> DataFrame:
    """STR-25: one chunk with its frames, each field of its caption dropped with a chance of 0.3."""
    c = _captioned(spark, d).where("episode_index % 5 <> 0")
    got = chunks.chunk_of(F.col("caption"), sampling.uniform(F.col("episode_index"), 21))["value"]
    left = chunks.fields_left(got["caption_json"], F.col("episode_index"), 0.3, 22)
    return c.select("episode_index", got["start_frame"].alias("start_frame"), got["end_frame"].alias("end_frame"), F.array_join(F.array_sort(F.map_keys(left)), ",").alias("fields"))


@R.query("""SELECT pair_id, CASE WHEN a IS NULL THEN 'subject' ELSE 'audio_description,subject' END AS fields, a AS audio FROM (SELECT pair_id, CASE WHEN pair_id % 3 = 0 THEN 'flat ' || pair_id WHEN pair_id % 3 = 1 THEN 'nested' END AS a FROM t2i_pairs)""")
def audio_caption_injection(spark: SparkSession, d: str) -> DataFrame:
    """STR-07, STR-25: an audio caption, flat or nested, as a field of the caption."""
    flat = F.when(F.col("pair_id") % 3 == 0, F.concat(F.lit("flat "), F.col("pair_id").cast("string"))).otherwise("")
    nested = F.when(F.col("pair_id") % 3 == 1, F.array(F.lit(""), F.lit("nested"), F.lit("later")))
    audio = chunks.audio_caption(flat, nested)
    fields = chunks.with_audio(F.create_map(F.lit("subject"), F.lit("x")), audio)
    return table(spark, d, "t2i_pairs").select("pair_id", F.array_join(F.array_sort(F.map_keys(fields)), ",").alias("fields"), F.try_element_at(fields, F.lit(chunks.AUDIO_FIELD)).alias("audio"))


@R.query("SELECT doc_id, 'chunk_0_' || n_chars AS key, n_chars AS end_frame, coalesce(nullif(source, ''), lang) AS description FROM documents WHERE n_chars IS NOT NULL AND coalesce(nullif(source, ''), nullif(lang, '')) IS NOT NULL")
def caption_legacy_chunk(spark: SparkSession, d: str) -> DataFrame:
    """STR-26: one chunk over all frames from the first caption of the earlier schema that is not empty."""
    c = chunks.legacy_chunk({"caption_short": F.col("lang"), "caption_dense": F.col("source")}, F.col("n_chars"))
    return table(spark, d, "documents").where("n_chars is not null").select("doc_id", c.alias("c")).where("c is not null").select("doc_id", "c.key", "c.end_frame", "c.description")


@R.query(f"""WITH p AS (SELECT pair_id, extra_prompt AS short, prompt AS long, {_U.format(c='pair_id', s=23)} AS u FROM t2i_pairs)
  SELECT pair_id, CASE WHEN u < 0.6 THEN 'long' ELSE 'short' END AS style, CASE WHEN u < 0.6 THEN long ELSE short END AS text FROM p WHERE coalesce(CASE WHEN u < 0.6 THEN long ELSE short END, '') <> ''""")
def caption_styles(spark: SparkSession, d: str) -> DataFrame:
    """STR-24, STR-28: one style of caption by its probability; a row whose chosen one is empty goes."""
    style = sampling.weighted_choice(sampling.uniform(F.col("pair_id"), 23), {"long": 0.6, "short": 0.4})
    rows = table(spark, d, "t2i_pairs").withColumn("style", style).withColumn("text", F.when(F.col("style") == "long", F.col("prompt")).otherwise(F.col("extra_prompt")))
    return rows.where("text <> ''").select("pair_id", "style", "text")


@R.query(f"""WITH p AS (SELECT pair_id, extra_prompt AS gt, prompt AS ai, {_U.format(c='pair_id', s=24)} AS u, coalesce(prompt, '') = '' OR prompt LIKE '{{%' AS issue FROM t2i_pairs)
  SELECT pair_id, CASE WHEN u < 0.7 AND NOT issue THEN 'ai' ELSE 'gt' END AS source, CASE WHEN u < 0.7 AND NOT issue THEN ai ELSE gt END AS text FROM p""")
def caption_mixed_sources(spark: SparkSession, d: str) -> DataFrame:
    """STR-29: the written or the generated caption by a ratio; a generated one with an issue falls back to the written one."""
    issue = (F.coalesce("prompt", F.lit("")) == "") | F.coalesce(F.col("prompt").startswith("{"), F.lit(False))
    wanted = sampling.weighted_choice(sampling.uniform(F.col("pair_id"), 24), {"ai": 0.7, "gt": 0.3})
    rows = table(spark, d, "t2i_pairs").withColumn("source", F.when((wanted == "ai") & ~issue, "ai").otherwise("gt"))
    return rows.select("pair_id", "source", F.when(F.col("source") == "ai", F.col("prompt")).otherwise(F.col("extra_prompt")).alias("text"))


_T = _U.format(c="(doc_id || ':' || n)", s=25)


@R.query(f"""WITH n AS (SELECT * FROM (VALUES (0, 'blur', 1.0), (1, 'crop', 2.0), (2, 'flip', 3.0), (3, 'tone', 4.0)) t(i, n, w)), k AS (SELECT doc_id, i, n, row_number() OVER (PARTITION BY doc_id ORDER BY -ln(1 - {_T}) / w, i) AS place FROM (SELECT doc_id FROM documents) CROSS JOIN n)
  SELECT doc_id, string_agg(n, ',' ORDER BY i) AS chosen FROM k WHERE place <= 2 GROUP BY 1""")
def weighted_subset(spark: SparkSession, d: str) -> DataFrame:
    """SMP-20: two of four transforms by weight without repeats, in their own order."""
    some = chunks.weighted_subset(F.col("doc_id"), {"blur": 1.0, "crop": 2.0, "flip": 3.0, "tone": 4.0}, 2, 25)
    return table(spark, d, "documents").select("doc_id", F.array_join(some, ",").alias("chosen"))


@R.query(f"""WITH e AS (SELECT episode_index, CAST(least(5, greatest(1, num_frames // 60)) AS INT) AS most, {_U.format(c='episode_index', s=26)} AS u FROM episodes WHERE num_frames IS NOT NULL)
  SELECT episode_index, most, CAST(least(most, 1 + floor(-ln(1 - u * (1 - exp(-2.0 * most))) / 2.0)) AS INT) AS stride FROM e""")
def biased_strides(spark: SparkSession, d: str) -> DataFrame:
    """WIN-29: strides with weights that fall off exponentially; the SQL inverts their distribution."""
    e = table(spark, d, "episodes").where("num_frames is not null")
    most = F.least(F.lit(5), F.greatest(F.lit(1), F.floor(F.col("num_frames") / 60))).cast("int")
    return e.select("episode_index", most.alias("most"), chunks.biased_stride(sampling.uniform(F.col("episode_index"), 26), most).alias("stride"))


_SIZES = [(320, 192), (256, 256), (192, 320), (224, 288)]
_SIZE_SQL = ", ".join(f"({i}, {h}, {w})" for i, (h, w) in enumerate(_SIZES))
_PICTURE = "SELECT event_id, 100 + event_id % 700 AS h, 120 + (event_id * 7) % 900 AS w FROM events"


@R.query(f"WITH e AS ({_PICTURE}), s AS (SELECT * FROM (VALUES {_SIZE_SQL}) t(i, sh, sw)), k AS (SELECT event_id, sh, sw, row_number() OVER (PARTITION BY event_id ORDER BY abs(h / w - sh / sw), i) AS place FROM e CROSS JOIN s) SELECT event_id, sh, sw FROM k WHERE place = 1")
def nearest_sizes(spark: SparkSession, d: str) -> DataFrame:
    """WIN-31: the predefined size whose ratio is nearest."""
    best = chunks.nearest_size(100 + F.col("event_id") % 700, 120 + (F.col("event_id") * 7) % 900, _SIZES)
    return table(spark, d, "events").select("event_id", best["h"].alias("sh"), best["w"].alias("sw"))


@R.query(f"""WITH e AS ({_PICTURE}), a AS (SELECT *, greatest(256 / h, 320 / w) AS c, least(256 / h, 320 / w) AS p FROM e), r AS (SELECT event_id, CAST(round(h * c) AS INT) AS ch, CAST(round(w * c) AS INT) AS cw, CAST(round(h * p) AS INT) AS ph, CAST(round(w * p) AS INT) AS pw FROM a)
  SELECT event_id, ch, cw, CAST(floor((ch - 256) / 2) AS BIGINT) AS crop_top, CAST(floor((cw - 320) / 2) AS BIGINT) AS crop_left, ph, pw, 256 - ph - CAST(floor((256 - ph) / 2) AS BIGINT) AS bottom, 320 - pw - CAST(floor((320 - pw) / 2) AS BIGINT) AS "right" FROM r""")
def resize_crop_pad(spark: SparkSession, d: str) -> DataFrame:
    """MTH-18: sizes and offsets to cover a target and cut it out, or to fit into it and pad."""
    h, w = 100 + F.col("event_id") % 700, 120 + (F.col("event_id") * 7) % 900
    c, p = chunks.covered(h, w, 256, 320), chunks.padded(h, w, 256, 320)
    cols = {"ch": c["resized_h"], "cw": c["resized_w"], "crop_top": c["top"], "crop_left": c["left"], "ph": p["resized_h"], "pw": p["resized_w"], "bottom": p["bottom"], "right": p["right"]}
    return table(spark, d, "events").select("event_id", *[v.alias(k) for k, v in cols.items()])


@R.query("SELECT task_index, task, 'user' AS role, task AS content FROM tasks")
def json_array_manifest(spark: SparkSession, d: str) -> DataFrame:
    """SRC-18: a manifest that is one JSON array of records with conversations, written and read."""
    from pyarrow import fs

    path = f"{shared_dir(spark)}/framemill-array-{uuid.uuid4().hex}.json"
    path = path if "://" in path else f"file://{path.removeprefix('file:')}"
    t = table(spark, d, "tasks").select("task_index", "task", F.array(F.struct(F.lit("user").alias("role"), F.col("task").alias("content"))).alias("talk"))
    # a catalogue of fixed size
    lines = [r["j"] for r in t.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()]
    store, at = fs.FileSystem.from_uri(path)
    with store.open_output_stream(at) as out:
        out.write(("[" + ",\n".join(lines) + "]").encode())
    rows = spark.read.schema("task_index bigint, task string, talk array<struct<role: string, content: string>>").option("multiLine", True).json(path)
    return rows.select("task_index", "task", F.explode("talk").alias("t")).select("task_index", "task", "t.role", "t.content")


@R.query("SELECT record_id, CASE record_id % 3 WHEN 0 THEN 'tag' WHEN 1 THEN 'fence' ELSE 'words' END AS dress, record_name AS name FROM (SELECT record_id, any_value(record_name) AS record_name FROM t2i_records WHERE record_name IS NOT NULL AND record_id IS NOT NULL GROUP BY 1)")
def prompt_json_extraction(spark: SparkSession, d: str) -> DataFrame:
    """CHT-06, STR-14..16: a JSON object out of an answer that has it in a tag, in a code fence or between words."""
    rows = table(spark, d, "t2i_records").where("record_name is not null and record_id is not null").groupBy("record_id").agg(F.any_value("record_name").alias("record_name"))
    body = F.to_json(F.struct(F.col("record_name").alias("name")))
    kind = F.col("record_id") % 3
    answer = F.when(kind == 0, F.concat(F.lit("<answer>\n"), body, F.lit("\n</answer>"))).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), body, F.lit(" as asked.")))

    @F.pandas_udf("string")
    def name(answers):
        return answers.map(lambda a: (parse(a)[1] or {}).get("name"))

    inner = F.when(kind == 0, C.bare_tag(answer, "answer")).when(kind == 1, C.without_fence(answer)).otherwise(answer)
    return rows.select("record_id", F.when(kind == 0, "tag").when(kind == 1, "fence").otherwise("words").alias("dress"), name(inner).alias("name"))
