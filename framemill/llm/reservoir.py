"""Fixed-size uniform samples of frames by block acceptance-rejection over Parquet row groups."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framemill.operators.ordering import running_sum
from framemill.session import broadcast_if_small, stored

#: Proposals for each wanted frame in the first stage, and the least number there.
PROPOSALS, LEAST_PROPOSALS = 4, 1000
#: Proposals that one task makes.
CHUNK = 100_000
#: How many times the wanted frames of a domain the second stage keeps, and some more for chance.
SPARE = 2.0

GROUPS = "path string, rg int, first bigint, n bigint"
FETCHED = "gno bigint, path string, pos bigint, i bigint, ep bigint, fr bigint, ts double"


def wanted(metadata: DataFrame) -> DataFrame:
    """(domain, k, seed): the sample size of each named domain.

    ``k`` is reservoir_size, at most max_samples where given; a null reservoir_size leaves
    max_samples alone to decide, both null (or negative) draw nothing. A null seed is 0. Of
    several entries of a domain the largest size counts. The table has a row for each domain.
    """
    k = F.greatest(F.lit(0), F.coalesce(F.least("reservoir_size", "max_samples"), F.lit(0)))
    return metadata.where("domain_name is not null").groupBy(F.col("domain_name").alias("domain")).agg(F.max(k).alias("k"), F.min(F.coalesce("sampling_seed", F.lit(0))).alias("seed"))


def _plain(path: Column) -> Column:
    """A file's name as both the list of files and the scan give it, which write local ones with one or three slashes."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def _open(path: str):
    from pyarrow import fs
    from pyarrow import parquet as pq

    system, inside = fs.FileSystem.from_uri(path)
    return pq.ParquetFile(system.open_input_file(inside))


def row_groups(frames: DataFrame) -> DataFrame:
    """(path, rg, first, n) of the row groups of the files under ``frames``, read from their footers where the tasks run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                meta = _open(path).metadata
                sizes = [meta.row_group(k).num_rows for k in range(meta.num_row_groups)]
                rows += [(path, k, first, n) for k, (first, n) in enumerate(zip(np.cumsum([0, *sizes]).tolist(), sizes)) if n]
            yield pd.DataFrame(rows, columns=["path", "rg", "first", "n"])

    spark = frames.sparkSession
    files = [(p,) for p in sorted(frames.inputFiles())]
    found = spark.createDataFrame(files, "path string").select(_plain(F.col("path")).alias("path")).repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism)))
    return running_sum(found.mapInPandas(run, GROUPS).withColumn("one", F.lit(1)), "one", [F.col("path"), F.col("rg")], "gno", "groups").drop("one")


def _fetched(groups: DataFrame, proposals: int, number: int, largest: int, seed: int) -> DataFrame:
    """The rows that proposals meet, each with the first proposal of it: (gno, path, pos, i, ep, fr, ts).

    A proposal is a row group, each as likely, and an offset below the largest group's size. One whose offset its group has not is
    rejected, as is one that came up before. A task reads key columns of the groups that were proposed, nothing of others.
    """
    spark = groups.sparkSession
    starts = spark.range(0, proposals, CHUNK).repartition(max(1, math.ceil(proposals / CHUNK))).select(F.explode(F.sequence(F.col("id"), F.least(F.col("id") + CHUNK, F.lit(proposals)) - 1)).alias("i"))
    roll = lambda what, below: F.pmod(F.xxhash64(F.lit(what), F.lit(seed), "i"), F.lit(below))
    tried = starts.select("i", roll("group", number).alias("gno"), roll("offset", largest).alias("offset"))
    first = tried.groupBy("gno", "offset").agg(F.min("i").alias("i"))
    real = first.join(broadcast_if_small(groups, 256), "gno").where("offset < n")
    some = real.groupBy("gno", "path", "rg", "first").agg(F.collect_list(F.struct("offset", "i")).alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            last, file = None, None
            for gno, path, rg, begin, cells in sorted(zip(pdf["gno"], pdf["path"], pdf["rg"], pdf["first"], pdf["cells"]), key=lambda r: (r[1], r[2])):
                if path != last:
                    last, file = path, _open(path)
                at = np.array([c["offset"] for c in cells], np.int64)
                t = file.read_row_group(int(rg), columns=["episode_index", "frame_index", "timestamp_s"]).take(at)
                ep, fr, ts = (t.column(c).to_pandas(integer_object_nulls=True) for c in ("episode_index", "frame_index", "timestamp_s"))
                yield pd.DataFrame({"gno": gno, "path": path, "pos": begin + at, "i": [c["i"] for c in cells], "ep": ep.astype("Int64"), "fr": fr.astype("Int64"), "ts": ts.astype("float64")})

    # at most as many cells of a group as proposals of it, and no more than it has rows
    return some.mapInPandas(run, FETCHED)


def _numbered(rows: DataFrame, of: DataFrame) -> DataFrame:
    """Frame numbers and domains: ``fr`` is the stored number or the time by the episode's fps; ``alone`` marks rows without one.

    Such a row can't be recognised in another copy, so each is a frame of its own.
    """
    by_time = F.when(~F.isnan("ts"), F.round(F.col("ts") * F.col("fps"))).cast("bigint")
    met = rows.join(of, "ep").withColumn("fr", F.coalesce("fr", by_time)).drop("ts", "fps")
    return met.withColumn("alone", F.when(F.col("fr").isNull(), F.xxhash64("path", "pos"))).withColumn("key", F.xxhash64("ep", "fr", "alone"))


def _stored_rows(frames: DataFrame, records: bool) -> DataFrame:
    named = [c for c in frames.columns if c not in ("episode_index", "frame_index", "chunk_index", "file_index")]
    record = [F.struct(*[F.col(f"`{c}`") for c in named]).alias("record")] if records else []
    take = {"ep": "episode_index", "fr": "frame_index", "ts": "timestamp_s", "at": "ingested_at", "chunk": "chunk_index", "file": "file_index"}
    return frames.select(*[F.col(c).alias(n) for n, c in take.items()], _plain(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.row_index").alias("pos"), *record)


def _first(rows: DataFrame, records: bool) -> DataFrame:
    """The first arrival of each frame: earliest ingestion, then the lowest file, then the place in it."""
    kept = ["at", "chunk", "file", "path", "pos", *(["record"] if records else [])]
    out = rows.groupBy("domain", "ep", "fr", "alone", "key").agg(F.min_by(F.struct(*kept), F.struct("at", "chunk", "file", "path", "pos")).alias("f"))
    return out.select("domain", "ep", "fr", "alone", "key", *[f"f.{c}" for c in kept])


def _unit(key: Column, seed: Column) -> Column:
    """A number below 1 from a frame's key."""
    return F.pmod(F.xxhash64(F.lit("frame"), seed, key), F.lit(1 << 52)) / F.lit(float(1 << 52))


def draw(frames: DataFrame, episodes: DataFrame, metadata: DataFrame, records: bool = False) -> DataFrame:
    """Drawn frames: (domain_name, draw_no, episode_index, frame_index, chunk_index, file_index, num_samples_stats[, record]).

    Row groups are chosen uniformly, and an offset up to the largest group's size; a proposal whose offset
    does not exist, that came up before, or whose row is not the first arrival of its frame is rejected, and the first k accepted ones
    of each domain are its sample. So every frame has the same chance, whatever the size of its group and however often
    it is stored. No frames are counted beforehand and none but candidates' copies are shuffled: proposed
    groups are read for their keys, and one scan looks for earlier copies of the candidates.
    Where the proposals leave a domain short, it is drawn anew from all its rows, proposed in the hash order of their frames:
    those below a bound that leaves about SPARE times the sample, or all, so that a domain with no more than k frames comes out
    whole. ``draw_no`` numbers the proposals. Everything follows from seeds and data: the same files give the same sample.
    ``num_samples_stats`` is the number drawn. Frames of no wanted domain are left out; empty tables give no rows. Frames
    that are no Parquet files are written to some first.
    """
    if not frames.inputFiles():
        frames = stored(frames, "frames")
    want = stored(wanted(metadata).where("k > 0"), "wanted")
    goal = want.agg(F.sum("k").alias("k"), F.min("seed").alias("seed")).first()
    of = episodes.where("episode_index is not null").groupBy(F.col("episode_index").alias("ep")).agg(F.max("domain_name").alias("domain"), F.max("fps").alias("fps"))
    of = stored(of.join(broadcast_if_small(want, 96), "domain"), "domains")
    of = broadcast_if_small(of, 128)
    groups = row_groups(frames)
    size = groups.agg(F.count(F.lit(1)).alias("g"), F.max("n").alias("m")).first()
    proposals = max(LEAST_PROPOSALS, PROPOSALS * (goal["k"] or 0)) if goal["k"] and size["g"] else 0
    met = _fetched(groups, proposals, max(1, size["g"]), max(1, size["m"] or 1), goal["seed"] or 0)
    # a domain has at most as many candidates as there were proposals; the first ones of twice its sample are looked at
    nth = F.row_number().over(Window.partitionBy("domain").orderBy("i"))
    candidates = stored(_numbered(met, of).withColumn("nth", nth).where(F.col("nth") <= 2 * F.col("k") + 100).select("domain", "k", "key", "path", "pos", "i"), "candidates")
    keys = candidates.select("key").distinct()
    rows = _numbered(_stored_rows(frames, records), of)
    earliest = _first(rows.join(broadcast_if_small(keys, 32), "key", "left_semi"), records)
    real = candidates.join(earliest.drop("domain", "key"), ["path", "pos"])
    accepted = stored(real.withColumn("nth", F.row_number().over(Window.partitionBy("domain").orderBy("i"))).withColumnRenamed("i", "draw_no"), "accepted")
    got = stored(want.join(accepted.groupBy("domain").agg(F.count(F.lit(1)).alias("got")), "domain", "left").na.fill(0, ["got"]), "got")
    short = got.where("got < k")
    drawn = accepted.join(broadcast_if_small(short.select("domain"), 64), "domain", "left_anti").where("nth <= k")
    if not short.isEmpty():
        # the first stage came upon this part of all rows
        part = -math.expm1(-proposals / max(1.0, float(size["g"] or 1) * float(size["m"] or 1)))
        expected = F.greatest(F.col("got"), F.lit(1)) / F.lit(part)
        bound = F.when(F.col("got") >= 100, (F.col("k") * SPARE + 10 * F.sqrt("k")) / expected).otherwise(1.0)
        limits = short.select("domain", "k", "seed", F.least(F.lit(1.0), bound).alias("bound"))
        rest = _rest(rows, limits, records)
        if not rest.groupBy("domain", "k", "bound").agg(F.max("nth").alias("n")).where("n < k and bound < 1").isEmpty():
            rest = _rest(rows, limits.withColumn("bound", F.lit(1.0)), records)
        drawn = drawn.unionByName(rest.where("nth <= k").withColumn("draw_no", F.lit(proposals) + F.col("nth") - 1).drop("bound"))
    total = F.count(F.lit(1)).over(Window.partitionBy("domain"))
    named = {"domain": "domain_name", "draw_no": "draw_no", "ep": "episode_index", "fr": "frame_index", "chunk": "chunk_index", "file": "file_index"}
    return drawn.select(*[F.col(c).alias(n) for c, n in named.items()], total.alias("num_samples_stats"), *(["record"] if records else []))


def _rest(rows: DataFrame, limits: DataFrame, records: bool) -> DataFrame:
    """The frames of domains that came out short, below their bound, in the order of their hash, stored."""
    mine = rows.drop("k", "seed").join(broadcast_if_small(limits, 96), "domain")
    mine = mine.where(_unit(F.col("key"), F.col("seed")) < F.col("bound"))
    first = _first(mine, records).join(broadcast_if_small(limits, 96), "domain")
    # as many rows of a domain as the bound leaves: about SPARE times its sample
    order = Window.partitionBy("domain").orderBy(_unit(F.col("key"), F.col("seed")), "key")
    kept = ["domain", "k", "bound", "path", "pos", "ep", "fr", "alone", "key", "at", "chunk", "file", "nth", *(["record"] if records else [])]
    return stored(first.withColumn("nth", F.row_number().over(order)).select(*kept), "rest")
