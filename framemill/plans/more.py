"""Queries of schemas, actions, remaining windows, joins and text formats."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framemill.functions import captions as C
from framemill.functions import pipelines, rotations
from framemill.operators import actions, curation, sampling, schemas, statistics
from framemill.plans.base import STEPS, steps
from framemill.plans.registry import Registry
from framemill.session import broadcast_if_small, table

R = Registry()


@R.query("SELECT record_id AS meta_id, domain_name AS meta_where_domain, fps AS meta_where_fps, prompt FROM action_policy_batch")
def flatten_nested(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-08, PRJ-10, PRJ-12."""
    a = table(spark, d, "action_policy_batch")
    n = a.select(F.struct(F.col("record_id").alias("id"), F.struct(F.col("domain_name").alias("domain"), "fps").alias("where")).alias("meta"), "prompt")
    return schemas.flattened(n)


@R.query("SELECT episode_index, frame_index, timestamp_s AS \"timestamp\", global_index AS \"index\", task_index, timestamp_s * 2 AS doubled FROM frames")
def add_remove_features(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-06, PRJ-07, UDF-10: required columns stay, new ones come in one projection."""
    f = table(spark, d, "frames").withColumnsRenamed({"timestamp_s": "timestamp", "global_index": "index"})
    f = schemas.without_features(f, ["observation_state", "action_vec", "chunk_index", "file_index", "captured_at", "ingested_at"])
    return schemas.with_features(f, {"doubled": F.col("timestamp") * 2})


@R.query("SELECT n AS name, CASE WHEN starts_with(n, 'observation.image') THEN 'visual' WHEN starts_with(n, 'observation') THEN 'state' WHEN starts_with(n, 'action') THEN 'action' END AS kind FROM (SELECT DISTINCT CASE WHEN fps > 20 THEN 'observation.image.' ELSE 'observation.' END || domain_name AS n FROM episodes WHERE domain_name IS NOT NULL)")
def feature_kinds(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-11, PRJ-13."""
    e = table(spark, d, "episodes").where("domain_name is not null")
    n = e.select(F.concat(F.when(F.col("fps") > 20, "observation.image.").otherwise("observation."), "domain_name").alias("name")).distinct()
    return n.select("name", schemas.kind_of(F.col("name")).alias("kind"))


@R.query("WITH m AS (SELECT episode_index AS old, row_number() OVER (ORDER BY num_frames DESC NULLS LAST, episode_index) - 1 AS new FROM episodes) SELECT f.global_index, f.chunk_index, f.file_index, new FROM frames f JOIN m ON f.episode_index = m.old")
def dictionary_remap(spark: SparkSession, d: str) -> DataFrame:
    """JON-04."""
    m = sampling.positions(table(spark, d, "episodes").select("episode_index", "num_frames"), [F.col("num_frames").desc_nulls_last(), F.col("episode_index")], "new").select("episode_index", "new")
    f = table(spark, d, "frames").select("episode_index", "global_index", "chunk_index", "file_index")
    return f.join(broadcast_if_small(m, 48), "episode_index").drop("episode_index")


@R.query(f"""WITH {STEPS}, q AS (SELECT ep, i, ts, unnest([-1, 0, 2]) AS k FROM steps WHERE ts IS NOT NULL AND NOT isnan(ts)), t AS (SELECT ep, CAST(round(ts * 1000) AS BIGINT) AS ms FROM steps WHERE ts IS NOT NULL AND NOT isnan(ts)),
  b AS (SELECT ep, min(ms) AS a, max(ms) AS z FROM t GROUP BY ep)
  SELECT q.ep, q.i, q.k, CAST(round(q.ts * 1000) AS BIGINT) + q.k * 200 NOT BETWEEN a AND z AS is_pad, greatest(a, least(z, CAST(round(q.ts * 1000) AS BIGINT) + q.k * 200)) AS clamped FROM q JOIN b USING (ep)""")
def timestamp_pad_mask(spark: SparkSession, d: str) -> DataFrame:
    """WIN-07, WIN-08: query times clamped to the episode, and which were outside."""
    s = steps(spark, d).where("ts is not null and not isnan(ts)").select("ep", "i", F.round(F.col("ts") * 1000).cast("bigint").alias("ms"))
    b = broadcast_if_small(s.groupBy("ep").agg(F.min("ms").alias("a"), F.max("ms").alias("z")), 64)
    q = s.withColumn("k", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(2)))).join(b, "ep").withColumn("t", F.col("ms") + F.col("k") * 200)
    return q.select("ep", "i", "k", (~F.col("t").between(F.col("a"), F.col("z"))).alias("is_pad"), F.greatest("a", F.least("z", "t")).alias("clamped"))


@R.query("""WITH r AS (SELECT episode_index, num_frames AS n, CASE WHEN len(tasks) > 1 THEN [{'s': 0, 'e': num_frames // 3}, {'s': num_frames // 2, 'e': num_frames}] ELSE [{'s': 0, 'e': num_frames}] END AS r FROM episodes WHERE num_frames > 0)
  SELECT episode_index, u.s AS start, u.e AS stop, CASE WHEN len(r) > 1 THEN n // 2 - n // 3 ELSE 0 END AS unannotated FROM (SELECT *, unnest(r) AS u FROM r)""")
def training_ranges(spark: SparkSession, d: str) -> DataFrame:
    """WIN-15: annotated ranges, or the whole episode, and the frames left out."""
    n = F.col("num_frames")
    whole = lambda s, e: F.struct(s.cast("bigint").alias("s"), e.cast("bigint").alias("e"))
    some = F.array(whole(F.lit(0), F.floor(n / 3)), whole(F.floor(n / 2), n))
    r = F.when(F.size("tasks") > 1, some)
    rows = table(spark, d, "episodes").where("num_frames > 0").select("episode_index", "num_frames", F.coalesce(r, F.array(whole(F.lit(0), n))).alias("r"))
    covered = F.aggregate("r", F.lit(0).cast("bigint"), lambda a, x: a + x["e"] - x["s"])
    return rows.select("episode_index", F.explode("r").alias("u"), (n - covered).alias("unannotated")).select("episode_index", F.col("u.s").alias("start"), F.col("u.e").alias("stop"), "unannotated")


@R.query("""WITH e AS (SELECT episode_index, num_frames AS n, CAST(greatest(1, ceil(fps / 10)) AS BIGINT) AS step FROM episodes WHERE num_frames IS NOT NULL AND fps IS NOT NULL), x AS (SELECT *, 8 * step AS span, (n - 1 - 8 * step) // 2 AS first FROM e)
  SELECT episode_index, CASE WHEN n - 1 >= span THEN range(first, first + span + 1, step) END AS picked FROM x""")
def stride_selection(spark: SparkSession, d: str) -> DataFrame:
    """WIN-27, WIN-30, RDR-17: nine frames from the middle of a clip at no more than ten a second."""
    e = table(spark, d, "episodes").where("num_frames is not null and fps is not null")
    return e.select("episode_index", actions.stride_frames(F.lit(0), F.col("num_frames") - 1, F.col("fps"), 10.0, 9).alias("picked"))


@R.query("SELECT source, string_agg(k, ',' ORDER BY n, k) AS keys FROM (SELECT source, 'input_' || CAST(length(text) % 30 AS VARCHAR) AS k, length(text) % 30 AS n FROM documents GROUP BY ALL) GROUP BY source")
def numeric_suffix_sort(spark: SparkSession, d: str) -> DataFrame:
    """SRT-02: keys by the number behind them; a set of at most thirty a source."""
    k = F.concat(F.lit("input_"), (F.length("text") % 30).cast("string"))
    g = table(spark, d, "documents").groupBy("source").agg(F.collect_set(k).alias("k"))
    num = lambda x: F.regexp_extract(x, r"(\d+)$", 1).cast("int")
    ordered = F.transform(F.array_sort(F.transform("k", lambda x: F.struct(num(x).alias("n"), x.alias("x")))), lambda s: s["x"])
    return g.select("source", F.array_join(ordered, ",").alias("keys"))


@R.query("SELECT doc_id, strip_accents(source) AS plain, upper(lang) AS verdict FROM documents")
def ascii_and_verdict(spark: SparkSession, d: str) -> DataFrame:
    """STR-12, FLT-19: folded names, and the label in a classifier's answer."""
    accents = F.translate("source", "àáâäãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    answer = F.concat(F.lit("Safety: "), F.upper("lang"), F.lit("\nCategories: none"))
    return table(spark, d, "documents").select("doc_id", accents.alias("plain"), F.nullif(F.regexp_extract(answer, r"Safety:\s*(\w+)", 1), F.lit("")).alias("verdict"))


@R.query("""SELECT episode_index, '[' || string_agg('{"start":"' || printf('%d:%02d', CAST(s AS BIGINT) // 60, CAST(s AS BIGINT) % 60) || '","caption":"part ' || k || '"}', ',' ORDER BY k) || ']' AS answer
  FROM (SELECT episode_index, k, k * 7 AS s FROM episodes, range(0, 3) t(k)) GROUP BY 1""")
def timestamped_answer(spark: SparkSession, d: str) -> DataFrame:
    """STR-34, STR-35: events of an answer as JSON with clock times."""
    ev = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct(C.short_clock(k * 7).alias("start"), F.concat(F.lit("part "), k.cast("string")).alias("caption")))
    return table(spark, d, "episodes").select("episode_index", F.to_json(ev).alias("answer"))


@R.query("SELECT doc_id, len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS n FROM documents WHERE trim(text) <> ''")
def token_count(spark: SparkSession, d: str) -> DataFrame:
    """STR-42, UDF-11: tokens by white space, the cost function of the packers' tests."""
    t = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    return table(spark, d, "documents").where("trim(text) <> ''").select("doc_id", F.size(t).cast("bigint").alias("n"))


#: Domains of the test tables beside those of the readers.
_KNOWN = actions.DOMAINS | {"roadview": (20, 7), "heron_arm": (21, 7), "lintel-seven-dual": (22, 14), "handheld_grip": (23, 10)}


@R.query("SELECT DISTINCT domain_name, CASE trim(domain_name) WHEN 'roadview' THEN 20 WHEN 'heron_arm' THEN 21 WHEN 'lintel-seven-dual' THEN 22 WHEN 'handheld_grip' THEN 23 END AS domain_id, CASE trim(domain_name) WHEN 'roadview' THEN 7 WHEN 'heron_arm' THEN 7 WHEN 'lintel-seven-dual' THEN 14 WHEN 'handheld_grip' THEN 10 END AS width FROM episodes")
def domain_ids(spark: SparkSession, d: str) -> DataFrame:
    """MTH-15, MTH-16: id and action width of each domain by a registry, null for one that is not in it."""
    i, w = actions.domain(F.col("domain_name"), _KNOWN)
    return table(spark, d, "episodes").select("domain_name").distinct().select("domain_name", i.alias("domain_id"), w.alias("width"))


@R.query()
def relative_action_chunks(spark: SparkSession, d: str) -> DataFrame:
    """MTH-11, MTH-12, MTH-14: chunks of relative poses, as the LIBERO reader cuts them; the inverse is checked in the tests."""
    f = steps_vectors(spark, d)
    return actions.relative_chunks(f, actions.Reader("libero", "x", chunk=8, stride=4))


def steps_vectors(spark: SparkSession, d: str) -> DataFrame:
    from framemill.operators.frames import frame_rows

    rows = frame_rows(table(spark, d, "frames"), table(spark, d, "episodes"), {"x": F.col("action_vec"), "at": F.col("ingested_at")})
    return rows.where("ep is not null and fr is not null").groupBy("ep", F.col("fr").alias("i")).agg(F.min_by("x", "at").alias("x"))


@R.query("SELECT sample_id, list_transform(range(0, 3), lambda k: CASE WHEN k < len(l) THEN [CAST(l[k + 1] AS DOUBLE), 0.0] ELSE [0.0, 0.0] END) AS actions FROM (SELECT sample_id, any_value(split_lens) AS l FROM pack_samples GROUP BY 1)")
def action_json_loader(spark: SparkSession, d: str) -> DataFrame:
    """CHT-09: actions of a JSON text, padded to the chunk and width, zeros where there are none."""
    s = table(spark, d, "pack_samples").groupBy("sample_id").agg(F.any_value("split_lens").alias("l"))
    text = F.to_json(F.transform("l", lambda v: F.array(v.cast("double"))))
    return s.select("sample_id", actions.loaded_actions(text, 3, 2).alias("actions"))


@R.query("SELECT episode_index, CAST(CASE WHEN k > 0 THEN range(0, k) ELSE [] END AS INTEGER[]) AS conditioning FROM (SELECT episode_index, least(CASE WHEN u < 0.5 THEN 1 WHEN u < 0.75 THEN 3 ELSE 0 END, greatest(0, num_frames - 1)) AS k FROM (SELECT episode_index, num_frames, CAST(CAST('0x' || substr(sha256(CAST(episode_index AS VARCHAR) || '/4'), 1, 12) AS UBIGINT) AS DOUBLE) / 281474976710656.0 AS u FROM episodes WHERE num_frames IS NOT NULL))")
def sequence_plan(spark: SparkSession, d: str) -> DataFrame:
    """MTH-21, RDR-12."""
    u = sampling.uniform(F.col("episode_index"), 4)
    return table(spark, d, "episodes").where("num_frames is not null").select("episode_index", actions.sequence_plan(F.col("num_frames"), u, {1: 2.0, 3: 1.0, 0: 1.0}).alias("conditioning"))


@R.query()
def image_similarity(spark: SparkSession, d: str) -> DataFrame:
    """AGG-32: structural similarity of vectors laid out as square images, against themselves one place on; a vector is read up to its largest square."""
    width = F.floor(F.sqrt(F.size("embedding"))).cast("int")
    e = table(spark, d, "embeddings").where("size(embedding) >= 16").select("vec_id", width.alias("w"), F.slice("embedding", 1, width * width).cast("array<double>").alias("a"))
    b = F.concat(F.slice("a", 2, F.size("a") - 1), F.slice("a", 1, 1))
    return e.select("vec_id", statistics.ssim_column(2.0)("a", b, F.col("w")).alias("ssim"))


@R.query()
def box_suppression(spark: SparkSession, d: str) -> DataFrame:
    """FLT-20: boxes left after suppression; the boxes are the vectors' numbers."""
    @F.pandas_udf("array<int>")
    def keep(rows: pd.Series) -> pd.Series:
        def one(x):
            boxes = [(abs(x[i]) * 50, abs(x[i + 1]) * 50, abs(x[i]) * 50 + 40, abs(x[i + 1]) * 50 + 40, abs(x[i + 2])) for i in range(0, len(x) - 2, 3)]
            return curation.kept_boxes(boxes, 0.02, 0.4, 50, 5)

        return rows.map(one)

    return table(spark, d, "embeddings").where("size(embedding) >= 3").select("vec_id", keep("embedding").alias("kept"))


@R.query()
def mask_rows(spark: SparkSession, d: str) -> DataFrame:
    """MTH-17: the set pixels in some rows of a run-length mask."""
    @F.pandas_udf("bigint")
    def count(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: int(np.sum(rotations.decode_rle_rows([int(abs(v)) % 9 for v in r], 16, 8, 4, 12))))

    s = table(spark, d, "pack_samples").where("size(split_lens) > 0").groupBy("sample_id").agg(F.any_value("split_lens").alias("l"))
    return s.select("sample_id", count("l").alias("n"))


@pipelines.pipeline("letters")
def _letters(letter: str) -> list[pipelines.Step]:
    def count(row: dict) -> dict | None:
        return {"pair_id": row["pair_id"], "n": row["prompt"].count(letter)} if row["prompt"] else None

    return [lambda df: df.select("pair_id", "prompt"), pipelines.row_step(count, "pair_id bigint, n bigint"), lambda df: df.where("n > 0")]


@R.query("SELECT pair_id, length(prompt) - length(replace(prompt, 'a', '')) AS n FROM t2i_pairs WHERE prompt <> '' AND contains(prompt, 'a')")
def registered_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """UDF-01, UDF-07, FLT-21: a named chain of steps, one of them a function of a row that may drop it."""
    return pipelines.apply(table(spark, d, "t2i_pairs"), "letters", letter="a")


@R.query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, rank() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC) AS place FROM orders GROUP BY 1, 2")
def ranked_groups(spark: SparkSession, d: str) -> DataFrame:
    """Rank functions (extra), over the few aggregated rows."""
    from pyspark.sql import Window

    g = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("place", F.rank().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("n"))).cast("bigint"))


@R.query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    """Plain grouped aggregation (extra)."""
    li = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))
