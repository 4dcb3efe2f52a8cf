"""Queries of the problems of language-model corpora, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framemill.llm import leaks, mixing, packing, pairs, quality, reservoir, splits
from framemill.plans.registry import Registry
from framemill.session import table

R = Registry()

_LENGTH = "CASE WHEN len(split_lens) > 0 THEN list_sum(split_lens) ELSE CASE WHEN sample_len >= 0 THEN sample_len END END"
_PIECES = f"""
  items AS (SELECT sample_id, min(stream_id) AS stream_id, CAST(max({_LENGTH}) AS BIGINT) AS length FROM pack_samples GROUP BY sample_id),
  capped AS (SELECT * FROM items JOIN pack_budgets USING (stream_id) WHERE length IS NOT NULL)
"""


@R.query(f"WITH {_PIECES} SELECT DISTINCT sample_id FROM capped WHERE length > sequence_length")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Samples longer than their stream's capacity: those that the containers hold in pieces."""
    made = packing.pack(table(spark, d, "pack_samples"), table(spark, d, "pack_budgets"))
    held = made.select(F.explode(F.arrays_zip("sample_ids", "piece_counts")).alias("p"))
    return held.where("p.piece_counts > 1").select(F.col("p.sample_ids").alias("sample_id")).distinct()


@R.query()
def p2_containers(spark: SparkSession, d: str) -> DataFrame:
    """The containers and what they hold."""
    return packing.pack(table(spark, d, "pack_samples"), table(spark, d, "pack_budgets"))


@R.query(f"WITH {_PIECES} SELECT stream_id, count(*) AS n_samples, CAST(sum(length) AS BIGINT) AS tokens FROM capped GROUP BY stream_id")
def p2_packed_totals(spark: SparkSession, d: str) -> DataFrame:
    """Samples and tokens that the containers of each stream hold: as many as came in."""
    made = packing.pack(table(spark, d, "pack_samples"), table(spark, d, "pack_budgets"))
    held = made.select("stream_id", F.explode(F.arrays_zip("sample_ids", "sample_lens", "piece_nos")).alias("p"))
    n = F.sum(F.when(F.col("p.piece_nos") == 0, 1).otherwise(0))
    return held.groupBy("stream_id").agg(n.alias("n_samples"), F.sum("p.sample_lens").alias("tokens"))


@R.query()
def p2_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers of each stream, the least number possible and the share of unused space."""
    made = packing.pack(table(spark, d, "pack_samples"), table(spark, d, "pack_budgets"))
    used, space = F.sum("used"), F.sum("sequence_length")
    return made.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_containers"), F.ceil(used / F.max("sequence_length")).alias("least"), (1 - used / space).alias("unused_share"))


@R.query()
def p2_search(spark: SparkSession, d: str) -> DataFrame:
    """Containers of each stream by best fit, after the search, and at the lower bound of its blocks."""
    return packing.gains(table(spark, d, "pack_samples"), table(spark, d, "pack_budgets"))


@R.query(f"WITH {_PIECES} SELECT stream_id, TRUE AS every_container_fits, TRUE AS split_only_if_longer FROM capped GROUP BY stream_id")
def p2_limits(spark: SparkSession, d: str) -> DataFrame:
    """Whether each container of a stream is within its capacity, and only samples longer than that are split."""
    made = packing.pack(table(spark, d, "pack_samples"), table(spark, d, "pack_budgets"))
    whole = F.forall(F.arrays_zip("piece_counts", "sample_lens", "piece_nos"), lambda p: (p["piece_counts"] == 1) | (p["sample_lens"] == F.col("sequence_length")) | (p["piece_nos"] == p["piece_counts"] - 1))
    return made.groupBy("stream_id").agg(F.bool_and(F.col("used") <= F.col("sequence_length")).alias("every_container_fits"), F.bool_and(whole).alias("split_only_if_longer"))


_TIES = r"""
  named AS (SELECT DISTINCT episode_index AS e, lower(regexp_replace(domain_name, '[^\p{L}\p{N}]+', '', 'g')) AS dom, CAST(regexp_extract(recording_id, '\d+') AS BIGINT) AS rec
    FROM action_policy_batch WHERE episode_index IS NOT NULL AND domain_name IS NOT NULL AND regexp_matches(recording_id, '\d')),
  tie AS (SELECT x.e AS a, y.e AS b FROM named x JOIN named y ON x.dom = y.dom AND x.rec = y.rec WHERE x.e <> y.e
    UNION SELECT episode_index, ref_episode_index FROM action_policy_batch WHERE episode_index <> ref_episode_index
    UNION SELECT ref_episode_index, episode_index FROM action_policy_batch WHERE episode_index <> ref_episode_index),
  reach AS (SELECT a, b FROM tie UNION SELECT r.a, t.b FROM reach r JOIN tie t ON r.b = t.a)
"""


@R.query(f"WITH RECURSIVE {_TIES} SELECT DISTINCT a AS episode_a, b AS episode_b FROM reach WHERE a < b")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of episodes that must share a split."""
    return splits.tied_pairs(splits.episode_components(table(spark, d, "action_policy_batch")))


@R.query()
def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of each record."""
    return splits.split(table(spark, d, "action_policy_batch"))


@R.query()
def p3_split_shares(spark: SparkSession, d: str) -> DataFrame:
    """Records and their share in each split."""
    n = splits.split(table(spark, d, "action_policy_batch")).groupBy("split").agg(F.count(F.lit(1)).alias("n_records"))
    total = n.agg(F.sum("n_records").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("split", "n_records", (F.col("n_records") / F.col("total")).alias("share"))


@R.query("""SELECT (SELECT count(*) FROM (SELECT DISTINCT record_id, episode_index FROM action_policy_batch)) AS n_records, 0 AS divided_components, 0 AS divided_episodes
  WHERE EXISTS (SELECT 1 FROM action_policy_batch)""")
def p3_undivided(spark: SparkSession, d: str) -> DataFrame:
    """Records that have a split, and components and episodes whose records are in several: none."""
    made = splits.split(table(spark, d, "action_policy_batch"))
    several = lambda key: F.count_distinct(F.when(F.col("n") > 1, F.col(key))).cast("int")
    n = made.groupBy("component", "episode_index").agg(F.count_distinct("split").alias("n"), F.count(F.lit(1)).alias("records"), F.min("split").alias("least"), F.max("split").alias("most"))
    comps = n.where("component is not null").groupBy("component").agg(F.min("least").alias("least"), F.max("most").alias("most")).agg(F.coalesce(F.sum((F.col("least") != F.col("most")).cast("int")), F.lit(0)).cast("int").alias("divided_components"))
    return n.agg(F.sum("records").alias("n_records"), several("episode_index").alias("divided_episodes")).where("n_records > 0").crossJoin(F.broadcast(comps))


def _drawn(spark: SparkSession, d: str, records: bool = False) -> DataFrame:
    return reservoir.draw(table(spark, d, "frames"), table(spark, d, "episodes"), table(spark, d, "stats_metadata"), records)


@R.query()
def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    """The frames drawn for each domain, with their records."""
    return _drawn(spark, d, records=True)


@R.query("""
  WITH keyed AS (SELECT f.episode_index, coalesce(f.frame_index, CAST(round(f.timestamp_s * e.fps) AS BIGINT)) AS fr, e.domain_name
    FROM frames f JOIN episodes e USING (episode_index)),
  n AS (SELECT domain_name, count(*) AS n FROM (SELECT DISTINCT * FROM keyed) GROUP BY domain_name)
  SELECT domain_name, least(n, reservoir_size, coalesce(max_samples, reservoir_size)) AS num_samples_stats,
    least(n, reservoir_size, coalesce(max_samples, reservoir_size)) AS n_distinct
  FROM stats_metadata JOIN n USING (domain_name)""")
def p4_sample_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The number drawn for each domain, as reported and as counted."""
    drawn = _drawn(spark, d).groupBy("domain_name", "num_samples_stats")
    return drawn.agg(F.countDistinct("episode_index", "frame_index").alias("n_distinct"))


@R.query()
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective pairs and their defect."""
    return pairs.defects(table(spark, d, "t2i_pairs"))


@R.query()
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@R.query()
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are not natural prose, and what they are."""
    return quality.graded(table(spark, d, "documents")).where("kind is not null").select("doc_id", "kind").distinct()


@R.query()
def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The statistics and outlier scores of every document."""
    return quality.graded(table(spark, d, "documents")).select("doc_id", "language", *quality.STATS, "score", "peak", "table_score", "list_score", "junk_score")


@R.query()
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@R.query()
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mixture reaches."""
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))
