"""Joins by nearness, range, priority and remapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, tolerance: int, payload: list[str], left_id: list[str], strict: bool = True) -> DataFrame:
    """For each left row the right row of its keys that is nearest in time, within ``tolerance`` (integer units, strict or not).

    Times are integers (microseconds, frames). Both sides meet on (keys, time bucket of one
    tolerance): a left row looks into its own bucket and the ones beside it, so the join is an
    equi-join whose groups are bounded by time, not by key. Ties go to the earlier right row.
    Left rows without a partner come out with nulls.
    """
    width = max(1, tolerance)
    r = right.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], F.col(right_time).alias("_rt"), F.struct(*payload).alias("_p")).where("_rt is not null")
    r = r.withColumn("_rb", F.floor(F.col("_rt") / width))
    seen = left.withColumn("_lb", F.floor(F.col(left_time) / width))
    probe = seen.select(*keys, *[c for c in {left_time, *left_id} if c not in keys], F.explode(F.array(F.col("_lb") - 1, F.col("_lb"), F.col("_lb") + 1)).alias("_lb"))
    on = F.col("_lb") == F.col("_rb")
    for j, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_k{j}"))
    gap = F.abs(F.col("_rt") - F.col(left_time))
    near = probe.join(r, on).where(gap < tolerance if strict else gap <= tolerance)
    best = near.groupBy(*left_id).agg(F.min(F.struct(gap.alias("g"), F.col("_rt").alias("t"), F.col("_p").alias("p"))).alias("_best"))
    out = left.join(best, left_id, "left")
    return out.select(*left.columns, F.col("_best.g").alias("gap"), F.col("_best.t").alias(f"{right_time}_near"), *[F.col(f"_best.p.{c}").alias(f"{c}_near") for c in payload if c != right_time])


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, lookback: int, payload: list[str], left_id: list[str]) -> DataFrame:
    """For each left row the last right row of its keys at or before it, at most ``lookback`` units back."""
    width = max(1, lookback)
    r = right.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], F.col(right_time).alias("_rt"), F.struct(*payload).alias("_p")).where("_rt is not null").withColumn("_rb", F.floor(F.col("_rt") / width))
    probe = left.select(*keys, *[c for c in {left_time, *left_id} if c not in keys], F.explode(F.array(F.floor(F.col(left_time) / width) - 1, F.floor(F.col(left_time) / width))).alias("_lb"))
    on = F.col("_lb") == F.col("_rb")
    for j, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"_k{j}"))
    past = probe.join(r, on).where((F.col("_rt") <= F.col(left_time)) & (F.col(left_time) - F.col("_rt") <= lookback))
    best = past.groupBy(*left_id).agg(F.max(F.struct(F.col("_rt").alias("t"), F.col("_p").alias("p"))).alias("_best"))
    out = left.join(best, left_id, "left")
    return out.select(*left.columns, F.col("_best.t").alias(f"{right_time}_asof"), *[F.col(f"_best.p.{c}").alias(f"{c}_asof") for c in payload])


def range_lookup(points: DataFrame, ranges: DataFrame, point: str, start: str, stop: str, width: int) -> DataFrame:
    """Rows of ``points`` with the half-open range [start, stop) they fall into: an equi-join on buckets of ``width``.

    A range is listed under every bucket it touches, so choose ``width`` about the usual length.
    """
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(stop) - 1) / width)))).where(F.col(stop) > F.col(start))
    return points.withColumn("_b", F.floor(F.col(point) / width)).join(r, "_b").where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(stop))).drop("_b")


def intersect_ranges(spans: DataFrame, keep: DataFrame, keys: list[str], chunk: int = 0) -> DataFrame:
    """Overlaps (lo, hi) of [start, stop) spans with the keep ranges [k_start, k_stop) of the same keys, the end shortened by ``chunk``."""
    lo = F.greatest("start", "k_start")
    hi = F.least("stop", F.col("k_stop") - chunk)
    return spans.join(keep, keys).withColumn("lo", lo).withColumn("hi", hi).where("hi > lo").drop("k_start", "k_stop")


def remapped(rows: DataFrame, mapping: DataFrame, keys: list[str], outs: dict[str, str], default: dict[str, Column]) -> DataFrame:
    """Left join on several keys, with a default where the mapping has none: adds the names of ``outs`` from the mapping's columns."""
    m = mapping.select(*keys, *[F.col(v).alias(f"_{n}") for n, v in outs.items()])
    out = rows.join(m, keys, "left")
    return out.withColumns({n: F.coalesce(F.col(f"_{n}"), default[n]) for n in outs}).drop(*[f"_{n}" for n in outs])


def first_found(rows: DataFrame, files: DataFrame, candidates: list[Column], out: str, row_id: str) -> DataFrame:
    """The first of the candidate paths that is in ``files`` (path): one join over the exploded candidates, null where none is."""
    options = F.array(*[F.struct(F.lit(i).alias("rank"), c.alias("path")) for i, c in enumerate(candidates)])
    tried = rows.select(row_id, F.explode(options).alias("c")).select(row_id, "c.rank", "c.path").where("path is not null")
    hit = tried.join(files.select("path").distinct(), "path").groupBy(row_id).agg(F.min_by("path", "rank").alias(out))
    return rows.join(hit, row_id, "left")


def snapped(events: DataFrame, marks: DataFrame, keys: list[str], start: str, stop: str, mark: str, text: str, event_id: str, reach: int) -> DataFrame:
    """Events with both ends at the nearest mark of their keys (ties: the earlier), equal intervals merged with their texts in order.

    Ends farther than ``reach`` from any mark drop the event. Texts of one interval meet in a row.
    """
    ids = [event_id, *keys]
    ends = {}
    for name, at in (("s", start), ("e", stop)):
        near = asof_nearest(events.select(*ids, at), marks, keys, at, mark, reach, [mark], ids, strict=False)
        ends[name] = near.where(F.col("gap").isNotNull()).select(*ids, F.col(f"{mark}_near").alias(name))
    both = events.join(ends["s"], ids).join(ends["e"], ids)
    texts = F.sort_array(F.collect_list(F.struct(F.col(event_id).alias("o"), F.trim(F.col(text)).alias("t"))))
    return both.groupBy(*keys, "s", "e").agg(F.concat_ws(" ", F.transform(texts, lambda x: x["t"])).alias("caption"))
