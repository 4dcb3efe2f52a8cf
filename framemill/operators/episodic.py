"""Windows over episodes of frames without a task that holds a whole episode.

A frame is (ep, i); windows reach a bounded number of frames back and ahead. Episodes are cut into
blocks of index values, each block also gets the frames its windows reach into (a halo), and the
window runs inside (ep, block): one shuffle, and no group larger than a block and its halo, however
long an episode is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framemill.operators.ordering import placed
from framemill.session import broadcast_if_small

#: Index values in a block.
BLOCK = 4096


def haloed(df: DataFrame, index: str, before: int, after: int, block: int = BLOCK) -> DataFrame:
    """Copies of rows for every block whose windows reach them: adds ``_block`` and ``_own`` (the row belongs there)."""
    home = F.floor(F.col(index) / block)
    reach = F.sequence(F.floor((F.col(index) - after) / block), F.floor((F.col(index) + before) / block))
    return df.withColumn("_block", F.explode(reach)).withColumn("_own", F.col("_block") == home)


def inside(keys: list[str], index: str) -> Window:
    return Window.partitionBy(*keys, "_block").orderBy(index)


def windowed(df: DataFrame, keys: list[str], index: str, before: int, after: int, columns: dict[str, Column | object], block: int = BLOCK) -> DataFrame:
    """Add window columns that reach at most ``before`` index values back and ``after`` ahead.

    ``columns`` maps a name to a function of the ordered window (partition by keys and block, order by
    index). Indexes are unique within the keys; rows with a null index have no neighbours and come
    out in a block of their own, one per key.
    """
    w = inside(keys, index)
    spread = haloed(df.where(F.col(index).isNotNull()), index, before, after, block)
    return spread.withColumns({n: f(w) for n, f in columns.items()}).where("_own").drop("_block", "_own")


def at_offset(value: Column, offset: int):
    """The value exactly ``offset`` index values away, null where that frame is missing."""
    return lambda w: F.max(value).over(w.rangeBetween(offset, offset))


def bounds(df: DataFrame, keys: list[str], index: str, **extra: Column) -> DataFrame:
    """First and one past the last index of each episode: (keys, start, stop, ...)."""
    return df.groupBy(*keys).agg(F.min(index).alias("start"), (F.max(index) + 1).alias("stop"), *[c.alias(n) for n, c in extra.items()])


def delta_window(df: DataFrame, keys: list[str], index: str, value: str, deltas: dict[str, int], block: int = BLOCK) -> DataFrame:
    """The value at each offset, clamped to the episode, and whether the offset was outside: ``name`` and ``name_is_pad``.

    Outside the episode the value of its first or last frame stands; a frame missing inside gives null.
    """
    first, last = F.min_by(value, index), F.max_by(value, index)
    ends = broadcast_if_small(bounds(df, keys, index, _first=first, _last=last), 96)
    reach = max([abs(v) for v in deltas.values()] or [0])
    near = windowed(df, keys, index, reach, reach, {n: at_offset(F.col(value), k) for n, k in deltas.items()}, block)
    out = near.join(ends, keys)
    for n, k in deltas.items():
        target = F.col(index) + k
        low, high = target < F.col("start"), target >= F.col("stop")
        out = out.withColumn(n, F.when(low, F.col("_first")).when(high, F.col("_last")).otherwise(F.col(n))).withColumn(f"{n}_is_pad", low | high)
    return out.drop("start", "stop", "_first", "_last")


def bounded_fill(df: DataFrame, keys: list[str], index: str, value: str, back: int, ahead: int, block: int = BLOCK) -> DataFrame:
    """Values of ``back`` frames before to ``ahead`` after, going outward; after a missing frame the last one found stands and is marked.

    Adds ``m{k}`` / ``p{k}`` and ``..._is_pad`` for k = 1..back / 1..ahead.
    """
    sides = {f"m{k}": -k for k in range(1, back + 1)} | {f"p{k}": k for k in range(1, ahead + 1)}
    have = {f"_h{n}": (lambda k: lambda w: F.count(F.lit(1)).over(w.rangeBetween(k, k)))(k) for n, k in sides.items()}
    out = windowed(df, keys, index, back, ahead, {n: at_offset(F.col(value), k) for n, k in sides.items()} | have, block)
    for side, reach in (("m", back), ("p", ahead)):
        good, held = F.lit(True), F.col(value)
        for k in range(1, reach + 1):
            n = f"{side}{k}"
            good = good & (F.col(f"_h{n}") > 0)
            held = F.when(good, F.col(n)).otherwise(held)
            out = out.withColumn(f"{n}_is_pad", ~good).withColumn(f"_v{n}", held)
    for n in sides:
        out = out.withColumn(n, F.col(f"_v{n}"))
    return out.drop(*[f"_h{n}" for n in sides], *[f"_v{n}" for n in sides])


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str = "i") -> DataFrame:
    """0-based position of each row within its keys, exact for groups of any size (range-partitioned sort with offsets)."""
    rows = placed(df, [*[F.col(k) for k in keys], *order], "numbered")
    sizes = rows.groupBy("_part", *keys).agg(F.min("_place").alias("_low"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", *keys, (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_low")).alias("_base"))
    right = offsets.select("_part", "_base", *[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)])
    on = rows["_part"] == right["_part"]
    for j, k in enumerate(keys):
        on = on & rows[k].eqNullSafe(right[f"_k{j}"])
    return rows.join(broadcast_if_small(right, 64), on).select(*df.columns, (F.col("_place") + F.col("_base")).alias(out))


def running_islands(df: DataFrame, keys: list[str], index: str, flag: str, least: int, block: int = BLOCK) -> DataFrame:
    """Runs of consecutive indexes where ``flag`` holds, at least ``least`` long: (keys, first, length), for runs of any length.

    Runs are found inside blocks. Those that reach neither edge of their block are whole; only the
    others, two a block at most, meet in a second step that joins them where they touch.
    """
    on = df.where(F.col(flag)).select(*keys, index).withColumn("_block", F.floor(F.col(index) / block))
    w = Window.partitionBy(*keys, "_block").orderBy(index)
    piece = on.withColumn("_g", F.col(index) - F.row_number().over(w)).groupBy(*keys, "_block", "_g").agg(F.min(index).alias("a"), F.max(index).alias("b"))
    at_edge = (F.col("a") == F.col("_block") * block) | (F.col("b") == (F.col("_block") + 1) * block - 1)
    inner = piece.where(~at_edge).select(*keys, F.col("a").alias("first"), (F.col("b") - F.col("a") + 1).alias("length"))
    by = Window.partitionBy(*keys).orderBy("a")
    start = (F.lag("b").over(by).isNull() | (F.col("a") > F.lag("b").over(by) + 1)).cast("int")
    joined = piece.where(at_edge).withColumn("_s", start).withColumn("_r", F.sum("_s").over(by))
    runs = joined.groupBy(*keys, "_r").agg(F.min("a").alias("first"), (F.max("b") - F.min("a") + 1).alias("length"))
    return inner.union(runs.select(*keys, "first", "length")).where(F.col("length") >= least)


def initial_run(df: DataFrame, keys: list[str], index: str, flag: str) -> DataFrame:
    """Length of the run of ``flag`` that each episode begins with: (keys, length); pure aggregation."""
    stop = F.min(F.when(~F.coalesce(F.col(flag), F.lit(False)), F.col(index)))
    agg = df.groupBy(*keys).agg(F.min(index).alias("_a"), F.max(index).alias("_b"), stop.alias("_s"))
    return agg.select(*keys, (F.coalesce("_s", F.col("_b") + 1) - F.col("_a")).alias("length"))


def progress_weights(df: DataFrame, keys: list[str], index: str, progress: str, ahead: int, kappa: float, fallback: float = 1.0, epsilon: float = 1e-6) -> DataFrame:
    """Weights by progress over the next ``ahead`` frames: 1 above ``kappa``, a soft share between 0 and ``kappa``, 0 below, ``fallback`` where unknown.

    The soft share is (delta - (mean - 2 std)) / (4 std + epsilon), clipped to [0, 1], with the population moments of all deltas.
    """
    moved = delta_window(df, keys, index, progress, {"_later": ahead}).drop("_later_is_pad").withColumn("delta", F.col("_later") - F.col(progress)).drop("_later")
    moments = moved.agg(F.avg("delta").alias("_mean"), F.stddev_pop("delta").alias("_std"))
    soft = (F.col("delta") - (F.col("_mean") - 2 * F.col("_std"))) / (4 * F.col("_std") + epsilon)
    soft = F.least(F.lit(1.0), F.greatest(F.lit(0.0), soft))
    weight = F.when(F.col("delta").isNull() | F.isnan("delta"), F.lit(fallback)).when(F.col("delta") > kappa, 1.0).when(F.col("delta") >= 0, soft).otherwise(0.0)
    return moved.join(F.broadcast(moments), how="cross").withColumn("weight", weight).drop("_mean", "_std")


def block_anchor(df: DataFrame, keys: list[str], index: str, size: int, values: list[str]) -> DataFrame:
    """Values relative to the first frame of their block of ``size`` frames; blocks are bounded, so no halo is needed."""
    w = Window.partitionBy(*keys, F.floor(F.col(index) / size)).orderBy(index)
    return df.withColumns({f"{v}_rel": F.col(v) - F.first(v).over(w) for v in values}).withColumn("block", F.floor(F.col(index) / size))
