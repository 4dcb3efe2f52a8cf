"""Session settings, size-checked broadcasts and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Largest estimated size of a side that an operator broadcasts by itself.
BROADCAST_LIMIT_BYTES = 48 << 20


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("framemill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        own = tempfile.mkdtemp(prefix="framemill-ckpt-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
        current = sc.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table to the shared folder and read it back.

    Used where a result is read several times: column pruning and statistics stay
    available, and losing an executor loses nothing. The shuffle files of the write are
    removed when it has ended, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/framemill-{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT_BYTES) -> bool:
    """Whether counted rows times ``row_bytes`` stay within the limit; the count is a parallel aggregation."""
    return df.count() * max(1, row_bytes) <= limit


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast only where the counted size proves small; otherwise leave the join to Catalyst and AQE."""
    return F.broadcast(df) if fits_broadcast(df, row_bytes, limit) else df


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the session was made; once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_framemill_shipped", False):
        return
    home = Path(__file__).resolve().parent
    folder = shared_dir(spark)
    local = folder.removeprefix("file://") if folder.startswith(("file:", "/")) else tempfile.mkdtemp()  # addPyFile copies it from there
    os.makedirs(local, exist_ok=True)
    archive = os.path.join(local, f"framemill-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(archive)
    sc._framemill_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a scan has fewer partitions than those: for costly per-row work on few files.

    Inputs estimated at a gigabyte or more have partitions enough and are left as they are.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= 1 << 30:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
