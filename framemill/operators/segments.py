"""Planning windows over frame ranges: arithmetic on one row per episode, then explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _int(c: Column) -> Column:
    return c.cast("bigint")


def segment_plan(episodes: DataFrame, length: str, max_steps: int, overlap: int, block: int = 1, preserve_tail: bool = False) -> DataFrame:
    """Segments (start, steps) of each episode of ``length`` frames; ``steps`` intervals need steps + 1 frames.

    A long episode is cut every max_steps - overlap steps and a right-aligned segment covers the end
    where it is not covered. One shorter than max_steps gives its whole blocks from the start (and
    with ``preserve_tail`` as many from the end where frames remain); one without a whole block gives nothing.
    """
    avail = F.greatest(F.lit(0), F.col(length) - 1)
    whole = _int(F.floor(avail / block) * block)
    seg = lambda start, steps: F.struct(_int(start).alias("start"), _int(steps).alias("steps"))
    short = F.array(seg(F.lit(0), whole))
    if preserve_tail:
        short = F.when(avail > whole, F.array(seg(F.lit(0), whole), seg(avail - whole, whole))).otherwise(short)
    tail = _int(avail - max_steps)
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0).cast("bigint"), tail, F.lit(max_steps - overlap).cast("bigint")), F.array(tail)))
    long = F.transform(starts, lambda s: seg(s, F.lit(max_steps)))
    plan = F.when(whole == 0, F.array().cast("array<struct<start:bigint,steps:bigint>>")).when(avail < max_steps, short).otherwise(long)
    return episodes.withColumn("_seg", F.explode(plan)).withColumn("start", F.col("_seg.start")).withColumn("steps", F.col("_seg.steps")).drop("_seg")


def balanced_windows(rows: DataFrame, first: str, last: str, fps: str, max_s: float, overlap_s: float) -> DataFrame:
    """The fewest windows (window, win_start, win_end) of at most max_s seconds that cover [first, last] with the exact overlap; sizes differ by one frame at most."""
    n = F.col(last) - F.col(first) + 1
    most, over = F.floor(F.col(fps) * max_s), F.floor(F.col(fps) * overlap_s)
    count = F.when(n <= most, F.lit(1)).otherwise(F.ceil((n - over) / (most - over)))
    total = n + (count - 1) * over
    base, extra = F.floor(total / count), F.pmod(total, count)
    k = F.col("window")
    out = rows.withColumn("window", F.explode(F.sequence(F.lit(0).cast("bigint"), _int(count) - 1)))
    start = F.col(first) + k * (base - over) + F.least(k, extra)
    return out.withColumn("win_start", _int(start)).withColumn("win_end", _int(start + base + F.when(k < extra, 1).otherwise(0) - 1))


def span_starts(length: Column, chunk: int, stride: int) -> Column:
    """Number of chunk starts in an episode: ceil((length - chunk) / stride), 0 where it is too short."""
    return _int(F.greatest(F.lit(0), F.ceil((length - chunk) / stride)))


def fps_stride(fps: Column, stride: int, cap: float) -> Column:
    """Frame stride that keeps the rate at or under ``cap`` (0: no cap)."""
    return _int(F.lit(stride)) if cap <= 0 else _int(F.greatest(F.lit(stride), F.ceil(fps / cap)))


def block_id(index: Column, size: int) -> Column:
    """Block of a frame: the first frame is a block of its own, then blocks of ``size``."""
    return _int(F.when(index == 0, 0).otherwise(1 + F.floor((index - 1) / size)))


def truncated(n: Column, factor: int) -> Column:
    """The largest count of the form factor * k + 1 that is not above ``n``."""
    return _int(F.floor((n - 1) / factor) * factor + 1)


def subtask_bounds(start: Column, end: Column, length: Column, block: int) -> tuple[Column, Column]:
    """[start, end) widened to whole blocks of steps plus one frame: forward as far as the episode goes, then backward."""
    need = F.ceil(F.greatest(F.lit(1), end - start - 1) / block) * block + 1
    stop = F.least(length, start + need)
    begin = F.greatest(F.lit(0), stop - need)
    return _int(begin), _int(stop)


def visible_blocks(pairs_from: DataFrame, pairs_to: DataFrame, keys: list[str], history: int) -> DataFrame:
    """Pairs (q, k) of blocks where k is the block of q or one of the ``history`` before it; an equi-join after an explode of the few candidates."""
    q = pairs_from.withColumn("k_block", F.explode(F.sequence(F.col("q_block") - history, F.col("q_block"))))
    return q.join(pairs_to, [*keys, "k_block"])
