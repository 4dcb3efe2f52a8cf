"""Queries of the general data problems: compaction (p1) and shredding (p5)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framemill.operators.compaction import HEADER, compact_frames, concat_files, write_small_files
from framemill.operators.shredding import SUBJECT, entries, flat_tables, shred, states
from framemill.plans.registry import Registry
from framemill.session import shared_dir, stored, table

R = Registry()

_KEYED = """
  SELECT f.episode_index, coalesce(f.frame_index, CAST(round(CASE WHEN NOT isnan(f.timestamp_s) THEN f.timestamp_s END * e.fps) AS BIGINT)) AS frame_index
  FROM frames f LEFT JOIN (SELECT episode_index, max(fps) AS fps FROM episodes GROUP BY episode_index) e USING (episode_index)
"""


@R.query(f"SELECT episode_index, frame_index FROM ({_KEYED}) WHERE episode_index IS NOT NULL AND frame_index IS NOT NULL GROUP BY episode_index, frame_index HAVING count(*) > 1")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Frames held by more than one stored row: what the compaction left out, a key each."""
    made = compact_frames(table(spark, d, "frames"), table(spark, d, "episodes"))
    return made.where("kind = 'dropped'").select(F.col("ep").alias("episode_index"), F.col("fr").alias("frame_index")).distinct()


@R.query("SELECT DISTINCT 'part' AS what, count(*) AS n_lines FROM (SELECT DISTINCT episode_index, frame_index FROM (" + _KEYED + ")) HAVING count(*) > 0")
def p1_compacted_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all written files together, read back from the files themselves: one for each frame."""
    out = f"{shared_dir(spark)}/framemill-lines-{uuid.uuid4().hex}"
    made = compact_frames(table(spark, d, "frames"), table(spark, d, "episodes"), out)
    # the manifest names the files; what a repeated task left beside them is not read
    files = stored(made.where("kind = 'file'").select("path"), "manifest")
    return _read_lines(spark, files).agg(F.lit("part").alias("what"), F.count(F.lit(1)).alias("n_lines"))


def _read_lines(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The lines of the files that a manifest names, one path for each file written; the JVM reads zstandard by the suffix."""
    paths = [r["path"] for r in manifest.collect()]
    return spark.read.text(paths) if paths else spark.createDataFrame([], "value string")


def _joined(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Each (chunk, file) of the frames written as a small file, these joined byte by byte, and the result read back by its manifest."""
    base = f"{shared_dir(spark)}/framemill-small-{uuid.uuid4().hex}"
    base = base if "://" in base or base.startswith("file:") else f"file://{base}"
    small = write_small_files(table(spark, d, "frames"), f"{base}/in", kind, header=kind == "text")
    made = concat_files(small, f"{base}/out", kind=kind, header=kind == "text")
    n = made.agg(F.sum("n_parts").alias("n_parts"), F.count(F.lit(1)).alias("n_files"), F.sum("n_bytes").alias("n_bytes"))
    lines = _read_lines(spark, made)
    if kind == "text":
        lines = lines.where(F.col("value") != HEADER)
    return lines.agg(F.count(F.lit(1)).alias("n_lines")).crossJoin(F.broadcast(n)).where("n_lines > 0").select("n_parts", "n_lines", (F.col("n_files") < F.col("n_parts")).alias("fewer"))


_SMALL = "SELECT count(DISTINCT (coalesce(chunk_index, -1), coalesce(file_index, -1))) AS n_parts, count(*) AS n_lines, TRUE AS fewer FROM frames HAVING count(*) > 0"


@R.query(_SMALL)
def p1_joined_text(spark: SparkSession, d: str) -> DataFrame:
    """Small newline-delimited files with a header each, joined without parsing: parts, lines read back, and whether there are fewer files."""
    return _joined(spark, d, "text")


@R.query(_SMALL)
def p1_joined_zstd(spark: SparkSession, d: str) -> DataFrame:
    """Small files of zstandard frames, joined frame by frame: parts, lines read back, and whether there are fewer files."""
    return _joined(spark, d, "zstd")


_CHILDREN = {SUBJECT: "subject", f"{SUBJECT}.appearance_details[]": "appearance_details", f"{SUBJECT}.action[]": "action"}


@R.query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Subjects and the entries of their appearance_details and action, with positions."""
    found = entries(shred(table(spark, d, "t2i_records"), paths=list(_CHILDREN)))
    child = F.create_map(*[F.lit(x) for pair in _CHILDREN.items() for x in pair])[F.col("path")]
    return found.select("record_id", "subject_pos", child.alias("child"), F.coalesce("child_pos", F.lit(0)).alias("child_pos"))


@R.query()
def p5_subjects(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of subjects."""
    return flat_tables(table(spark, d, "t2i_records"))["subjects"]


@R.query()
def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of records."""
    return flat_tables(table(spark, d, "t2i_records"))["records"]


@R.query()
def p5_actions(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of the subjects' actions."""
    return flat_tables(table(spark, d, "t2i_records"))["action"]


@R.query()
def p5_states(spark: SparkSession, d: str) -> DataFrame:
    """What the definition levels tell of each column: values there, blank in their array, in an empty array, or missing."""
    return states(shred(table(spark, d, "t2i_records")))
