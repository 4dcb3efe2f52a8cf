"""Manifests: lines of clips with windows, conversations and captions, and the curation that writes them."""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framemill.functions.captions import window_caption
from framemill.operators.curation import first_reason, reason_counts

#: Columns of a curated clip as it arrives; captions of a window are a map of named texts.
CLIPS = (
    "span_uuid string, source_video string, duration_span array<double>, clip_location string, width int, height int, num_frames bigint, framerate double, "
    "windows array<struct<start_frame:bigint, end_frame:bigint, captions:map<string,string>>>, _corrupt string"
)
#: Columns of a training manifest.
MANIFEST = (
    "uuid string, duration double, width int, height int, nb_frames bigint, framerate double, vision_path string, "
    "t2w_windows array<struct<start_frame:bigint, end_frame:bigint, temporal_interval:int, caption:string>>"
)


def read_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """JSON lines (compressed or not) under a declared schema; lines that are no JSON keep their text in ``_corrupt`` where the schema has it."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(paths)


def duration(frames: Column, rate: Column, span: Column) -> Column:
    """Seconds from frames and rate, else from the span's ends; null where neither is known."""
    return F.when((rate > 0) & frames.isNotNull(), frames / rate).when(F.size(span) == 2, span[1] - span[0])


def curated(clips: DataFrame, model: str | None = None, enhanced: str | None = None, min_edge: int = 0, min_frames: int = 61, max_seconds: float = 61.0, interval: int = 1, controls: DataFrame | None = None) -> DataFrame:
    """Clips as manifest rows with ``reason``: null for kept ones, else the first of the checks that drops it.

    The checks, in order: malformed line, identity, metadata, duration (a longer one than max_seconds
    drops), short edge, control file (with ``controls``: span_uuid, control_path), windows. A window
    needs both ends, min_frames frames (both ends count) and a caption.
    """
    c = F.col
    if controls is not None:
        clips = clips.join(controls.select("span_uuid", "control_path").dropDuplicates(["span_uuid"]), "span_uuid", "left")
    good = F.filter("windows", lambda w: w["start_frame"].isNotNull() & w["end_frame"].isNotNull() & (w["end_frame"] - w["start_frame"] + 1 >= min_frames))
    shaped = F.transform(good, lambda w: F.struct(w["start_frame"].alias("start_frame"), w["end_frame"].alias("end_frame"), F.lit(interval).alias("temporal_interval"), window_caption(w["captions"], model, enhanced).alias("caption")))
    rows = clips.withColumn("_d", duration(c("num_frames"), c("framerate"), c("duration_span"))).withColumn("_w", F.coalesce(F.filter(shaped, lambda w: w["caption"].isNotNull()), F.array()))
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    checks = [
        ("malformed_json", c("_corrupt").isNotNull() if "_corrupt" in clips.columns else F.lit(False)),
        ("missing_identity", blank(c("span_uuid")) | blank(c("clip_location"))),
        ("missing_clip_metadata", c("width").isNull() | c("height").isNull() | c("num_frames").isNull() | c("framerate").isNull() | c("_d").isNull()),
        ("duration_too_long", c("_d") > max_seconds),
        ("short_edge_too_small", (F.lit(min_edge) > 0) & (F.least("width", "height") < min_edge)),
    ]
    if controls is not None:
        checks.append(("missing_control_path", c("control_path").isNull()))
    checks.append(("no_valid_window", F.size("_w") == 0))
    kept = [c("span_uuid").alias("uuid"), c("_d").alias("duration"), "width", "height", c("num_frames").alias("nb_frames"), "framerate", c("clip_location").alias("vision_path"), c("_w").alias("t2w_windows")]
    extra = ["control_path"] if controls is not None else []
    return rows.select(*kept, *extra, first_reason(checks).alias("reason"))


def write_manifest(rows: DataFrame, out: str) -> dict[str, int]:
    """Write the kept rows as JSON lines and a summary of the drop reasons beside them; raises where nothing is kept."""
    rows.where("reason is null").drop("reason").write.mode("errorifexists").json(out)
    dropped = {r["reason"]: r["n"] for r in reason_counts(rows).collect()}  # one row per reason
    n = rows.sparkSession.read.schema(MANIFEST).json(out).count()
    summary = {"kept": n, "dropped": dropped}
    store, at = fs.FileSystem.from_uri(out if "://" in out else f"file://{out}")
    with store.open_output_stream(at.rstrip("/") + ".summary.json") as f:
        f.write(json.dumps(summary).encode())
    if not n:
        raise ValueError(f"nothing was kept: {dropped}")
    return summary


def usable(manifest: DataFrame, min_frames: int = 0, min_edge: int = 0, max_seconds: float = 61.0) -> DataFrame:
    """Manifest rows not over the duration or under the short edge, with their windows of min_frames frames; rows left without one go."""
    w = F.filter("t2w_windows", lambda x: x["end_frame"] - x["start_frame"] + 1 >= min_frames)
    ok = (F.coalesce("duration", F.lit(0.0)) <= max_seconds) & (F.coalesce(F.least("width", "height"), F.lit(min_edge)) >= min_edge)
    return manifest.where(ok).withColumn("t2w_windows", w).where(F.size("t2w_windows") > 0)


def by_window(manifest: DataFrame) -> DataFrame:
    """One row per window, the id with its number behind it."""
    rows = manifest.select("*", F.posexplode("t2w_windows").alias("_i", "_w"))
    return rows.withColumn("uuid", F.concat("uuid", F.lit("_w"), F.col("_i").cast("string"))).select(*[c for c in manifest.columns if c != "t2w_windows"], "_w.*")


def with_defaults(lines: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """A manifest of data sets whose rows may override settings: the row's value, else the default. Rows without a path are refused."""
    if not lines.where("path is null").isEmpty():
        raise ValueError("a line without a path")
    return lines.withColumns({k: F.coalesce(F.col(k) if k in lines.columns else F.lit(None), F.lit(v)) for k, v in defaults.items()})


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header, its NaN texts as nulls."""
    df = spark.read.option("header", True).option("nanValue", "NaN").csv(path)
    df = df.select(*[F.when(F.lower(F.trim(F.col(f"`{c}`"))).isin("nan", ""), None).otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return df.select(*columns) if columns else df


def read_caption_dirs(spark: SparkSession, root: str) -> DataFrame:
    """(name, caption, kind) of folders with a caption.json or caption.txt; JSON is preferred."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "caption.*").text(root)
    rows = files.select("value", F.input_file_name().alias("p")).select("value", F.regexp_extract("p", r"/([^/]+)/caption\.(?:json|txt)$", 1).alias("name"), F.regexp_extract("p", r"caption\.(json|txt)$", 1).alias("kind"))
    best = F.min_by(F.struct(F.trim("value").alias("caption"), "kind"), "kind")
    return rows.where("name <> ''").groupBy("name").agg(best.alias("b")).select("name", "b.caption", "b.kind")
