"""Mergeable moments, exact and histogram quantiles, normalisation bounds and evaluation metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framemill.operators.ordering import placed
from framemill.session import broadcast_if_small

#: Bins of the histogram estimator, and the margin added on both sides of its range.
BINS, MARGIN = 5000, 1e-10


def channels(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """One row per vector element: (keys, dim, x); nulls and NaN elements are left out (a channel may be masked)."""
    long = rows.select(*keys, F.posexplode(vector).alias("dim", "x"))
    return long.where(F.col("x").isNotNull() & ~F.isnan("x")).withColumn("x", F.col("x").cast("double"))


def moments(long: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """(keys, n, mn, mx, mean, std): population moments; partial aggregates merge before the shuffle."""
    return long.groupBy(*keys).agg(F.count(x).alias("n"), F.min(x).alias("mn"), F.max(x).alias("mx"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))


def merged_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of the union from those of its parts (n, mn, mx, mean, std): the variance adds the spread between means."""
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / n
    second = F.sum(F.col("n") * (F.col("std") * F.col("std") + F.col("mean") * F.col("mean"))) / n
    return parts.groupBy(*keys).agg(n.alias("n"), F.min("mn").alias("mn"), F.max("mx").alias("mx"), mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), second - mean * mean)).alias("std"))


def weighted_quantiles(parts: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Count-weighted mean of the parts' quantiles. This is no quantile of the union, only a summary of the parts."""
    return parts.groupBy(*keys).agg(*[(F.sum(F.col("n") * F.col(q)) / F.sum("n")).alias(q) for q in names])


def envelope(parts: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Bounds that hold for every part: the least low and the greatest high quantile."""
    return parts.groupBy(*keys).agg(F.min(low).alias(low), F.max(high).alias(high))


def exact_quantiles(long: DataFrame, keys: list[str], x: str, points: dict[str, float]) -> DataFrame:
    """(keys, n, quantiles) with linear interpolation, exact for groups of any size.

    Values are sorted over range partitions; each partition knows its offset in the group, so the two
    values around every quantile are picked by position and no group meets in one task.
    """
    rows = placed(long.select(*keys, F.col(x).alias("_x")).where("_x is not null"), [*[F.col(k) for k in keys], F.col("_x")], "quantiles")
    part = rows.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_low"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.select("_part", *keys, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low")).alias("_base"), F.sum("_n").over(Window.partitionBy(*keys)).alias("n"))
    at = rows.join(broadcast_if_small(offsets, 96), ["_part", *keys]).withColumn("_i", F.col("_place") + F.col("_base"))
    wanted = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(name).alias("name")) for name, q in points.items()])
    pos = F.transform(wanted, lambda w: F.struct(w["name"].alias("name"), (w["q"] * (F.col("n") - 1)).alias("p")))
    near = at.withColumn("_w", F.explode(F.filter(pos, lambda w: (F.col("_i") >= F.floor(w["p"])) & (F.col("_i") <= F.ceil(w["p"])))))
    near = near.select(*keys, "n", "_x", "_i", F.col("_w.name").alias("_name"), F.floor("_w.p").alias("_f"), (F.col("_w.p") - F.floor("_w.p")).alias("_r"))
    pick = lambda name, step: F.max(F.when((F.col("_name") == name) & (F.col("_i") == F.col("_f") + step), F.col("_x")))
    cols = [c for name in points for c in (pick(name, 0).alias(f"_lo_{name}"), pick(name, 1).alias(f"_hi_{name}"), F.max(F.when(F.col("_name") == name, F.col("_r"))).alias(f"_r_{name}"))]
    both = near.groupBy(*keys).agg(F.max("n").alias("n"), *cols)
    value = lambda q: F.when(F.col(f"_r_{q}") == 0, F.col(f"_lo_{q}")).otherwise(F.col(f"_lo_{q}") + (F.col(f"_hi_{q}") - F.col(f"_lo_{q}")) * F.col(f"_r_{q}"))
    return both.select(*keys, "n", *[value(q).alias(q) for q in points])


def histogram_quantiles(long: DataFrame, keys: list[str], x: str, points: dict[str, float], bins: int = BINS) -> DataFrame:
    """Quantiles from equal bins between minimum and maximum, linear inside a bin; within one bin width of the exact value.

    Two aggregations: ranges, then counts per bin, at most ``bins`` rows per group.
    """
    span = long.groupBy(*keys).agg(F.min(x).alias("_a"), F.max(x).alias("_b"), F.count(x).alias("n"))
    lo, hi = F.col("_a") - MARGIN, F.col("_b") + MARGIN
    width = (hi - lo) / bins
    binned = long.join(broadcast_if_small(span, 96), keys).withColumn("_bin", F.least(F.lit(bins - 1), F.floor((F.col(x) - lo) / width)))
    counts = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_c"), F.first("_a").alias("_a"), F.first("_b").alias("_b"), F.first("n").alias("n"))
    w = Window.partitionBy(*keys).orderBy("_bin")
    cum = counts.withColumn("_upto", F.sum("_c").over(w))
    cols = []
    for name, q in points.items():
        target = F.lit(q) * F.col("n")
        inside = (F.col("_upto") >= target) & (F.col("_upto") - F.col("_c") < target)
        value = lo + width * (F.col("_bin") + (target - (F.col("_upto") - F.col("_c"))) / F.col("_c"))
        cols.append(F.min(F.when(inside, value)).alias(name))
    return cum.groupBy(*keys).agg(F.max("n").alias("n"), *cols)


def load_imbalance(counts: DataFrame, group: list[str], n: str = "n") -> DataFrame:
    """(group, imbalance, entropy): largest share times the number of parts, and entropy over its maximum (1 where there is one part)."""
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    p = F.col(n) / F.sum(n).over(w)
    rows = counts.withColumn("_p", p)
    e = -F.sum(F.when(F.col("_p") > 0, F.col("_p") * F.ln("_p")))
    k = F.count(F.lit(1))
    return rows.groupBy(*group).agg((F.max("_p") * k).alias("imbalance"), F.when(k > 1, e / F.ln(k)).otherwise(1.0).alias("entropy"))


def psnr(mse: Column, data_range: float) -> Column:
    """20 log10(range / sqrt(mse)); infinite where nothing differs."""
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(20 * F.log10(F.lit(data_range) / F.sqrt(mse)))


def squared_error(a: Column, b: Column) -> Column:
    """Mean squared difference of two vectors, over positions that both have."""
    diff = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    have = F.filter(diff, lambda v: v.isNotNull())
    return F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0).cast("double"), lambda s, v: s + v) / F.size(have))


def absolute_error(a: Column, b: Column) -> Column:
    have = F.filter(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda v: v.isNotNull())
    return F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0).cast("double"), lambda s, v: s + v) / F.size(have))


def rotation_error(trace: Column) -> Column:
    """Angle in degrees of a rotation from the trace of its matrix."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))


def ssim(a: np.ndarray, b: np.ndarray, data_range: float = 1.0, size: int = 7) -> float:
    """Structural similarity of two grey images with a uniform window; the mean over all places where it fits."""
    from numpy.lib.stride_tricks import sliding_window_view

    size = min(size, *a.shape)
    x = sliding_window_view(a.astype(float), (size, size))
    y = sliding_window_view(b.astype(float), (size, size))
    n = size * size
    mx, my = x.mean((2, 3)), y.mean((2, 3))
    scale = n / (n - 1) if n > 1 else 1.0
    vx, vy = x.var((2, 3)) * scale, y.var((2, 3)) * scale
    cov = ((x * y).mean((2, 3)) - mx * my) * scale
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
    return float((((2 * mx * my + c1) * (2 * cov + c2)) / ((mx**2 + my**2 + c1) * (vx + vy + c2))).mean())


def evenly_spaced(n: int, least: int = 100, most: int = 10_000, power: float = 0.75) -> np.ndarray:
    """Indexes of an evenly spaced sample of n items: n ** power of them, between ``least`` and ``most``."""
    if n <= 0:
        return np.empty(0, int)
    m = int(min(n, max(min(least, n), min(n**power, most))))
    return np.round(np.linspace(0, n - 1, m)).astype(int)


def ssim_column(data_range: float = 255.0):
    """A pandas function over (reference, other, width): flat grey images of a width."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([ssim(np.asarray(x).reshape(-1, w), np.asarray(y).reshape(-1, w), data_range) for x, y, w in zip(a, b, width)])

    return run
