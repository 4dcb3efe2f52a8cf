"""Deterministic sampling, sharding, splitting and mixing by hashes and exact positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framemill.operators.episodic import numbered


def sha_key(ident: Column, seed: int = 0) -> Column:
    """A sort key that shuffles rows the same way everywhere: sha-256 of the id and the seed."""
    return F.sha2(F.concat(ident.cast("string"), F.lit(f"/{seed}")), 256)


def positions(rows: DataFrame, order: list[Column], out: str = "pos") -> DataFrame:
    """0-based position of every row in a total order, by a range-partitioned sort."""
    return numbered(rows.withColumn("_all", F.lit(0)), ["_all"], order, out).drop("_all")


def shard(pos: Column, shards: int) -> Column:
    return F.pmod(pos, F.lit(shards))


def two_level(pos: Column, ranks: int, workers: int) -> tuple[Column, Column]:
    """(rank, worker): ranks take every n-th row, workers every n-th of their rank's."""
    return F.pmod(pos, F.lit(ranks)), F.pmod(F.floor(pos / ranks), F.lit(workers))


def repeated(rows: DataFrame, times: int, n: int, shards: int) -> DataFrame:
    """Rows ``times`` over, with the first rows again so that all shards get equally many: adds ``copy``. Needs ``pos`` and the row count."""
    pad = (-n * times) % shards
    whole = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else rows.limit(0).withColumn("copy", F.lit(0))
    return whole.union(rows.where(F.col("pos") < pad).withColumn("copy", F.lit(times))) if pad else whole


def head_count(n: Column, fraction: float) -> Column:
    """How many rows a head fraction keeps: at least one."""
    return F.greatest(F.lit(1), F.floor(n * fraction))


def evenly(n: Column, m: Column) -> Column:
    """Array of m indexes spread evenly over 0..n-1, rounded half to even."""
    step = F.when(m > 1, (n - 1) / (m - 1)).otherwise(F.lit(0.0))
    return F.transform(F.sequence(F.lit(0).cast("bigint"), m.cast("bigint") - 1), lambda k: F.bround(k * step, 0).cast("bigint"))


def fraction_bounds(n: Column, fractions: dict[str, float]) -> dict[str, tuple[Column, Column]]:
    """Contiguous [from, to) positions by floor(n * fraction), the last split taking what is left when the fractions add up to 1."""
    out, start = {}, F.lit(0).cast("bigint")
    names = list(fractions)
    whole = abs(sum(fractions.values()) - 1.0) < 1e-9
    for name in names:
        size = F.floor(n * fractions[name])
        end = n if whole and name == names[-1] else start + size
        out[name] = (start, end)
        start = end
    return out


def uniform(ident: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that is a function of the id and the seed."""
    return F.conv(F.substring(sha_key(ident, seed), 1, 12), 16, 10).cast("double") / float(1 << 48)


def weighted_choice(u: Column, weights: dict[str, float]) -> Column:
    """The name whose cumulative share holds u."""
    total, upto, out = sum(weights.values()), 0.0, None
    for name, w in weights.items():
        upto += w
        out = F.when(u < upto / total, name) if out is None else out.when(u < upto / total, name)
    return out.otherwise(list(weights)[-1])


def ratio_cycle(step: Column, ratios: dict[str, int]) -> Column:
    """Source of a step when sources take turns in blocks of their ratio."""
    at, upto, out = F.pmod(step, F.lit(sum(ratios.values()))), 0, None
    for name, r in ratios.items():
        upto += r
        out = F.when(at < upto, name) if out is None else out.when(at < upto, name)
    return out


def allocate_ranks(ratios: dict[str, float], world: int) -> dict[str, int]:
    """Ranks of each source: the floor of its share but one at least, what remains by the largest remainders, too many taken from the most over-served."""
    kept = {k: v for k, v in ratios.items() if v > 0}
    if not kept or world < len(kept):
        raise ValueError("fewer ranks than sources with a positive ratio")
    total = sum(kept.values())
    ideal = {k: v / total * world for k, v in kept.items()}
    got = {k: max(1, int(q)) for k, q in ideal.items()}
    spare = world - sum(got.values())
    by_need = sorted(kept, key=lambda k: got[k] - ideal[k])
    for k in by_need[: max(0, spare)]:
        got[k] += 1
    for _ in range(-spare):
        k = max((x for x in got if got[x] > 1), key=lambda x: (got[x] - ideal[x], got[x]))
        got[k] -= 1
    return got


def allocation_table(weights: DataFrame, name: str, ratio: str, world: int) -> DataFrame:
    """The same as a table (name, ranks, first_rank); the sources are a bounded catalogue ordered by name, so one window over them is one small task."""
    w = weights.where(F.col(ratio) > 0).select(name, F.col(ratio).alias("r"))
    every = Window.partitionBy(F.lit(1))
    ideal = F.col("r") / F.sum("r").over(every) * world
    base = w.withColumn("ideal", ideal).withColumn("base", F.greatest(F.lit(1), F.floor("ideal")))
    spare = F.lit(world) - F.sum("base").over(every)
    rank = F.row_number().over(every.orderBy(F.desc(F.col("ideal") - F.col("base")), name))
    got = base.withColumn("ranks", (F.col("base") + F.when(rank <= spare, 1).otherwise(0)).cast("bigint"))
    first = F.coalesce(F.sum("ranks").over(every.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return got.select(name, "ranks", first.alias("first_rank"))


def trimmed(rows: DataFrame, index: str, start: str, stop: str, drop_first: int, drop_last: int) -> DataFrame:
    """Frames without the first and last ones of their episode."""
    return rows.where((F.col(index) >= F.col(start) + drop_first) & (F.col(index) < F.col(stop) - drop_last))


def smallest(rows: DataFrame, group: list[str], key: Column, k: int, slices: int = 64) -> DataFrame:
    """The k rows of each group with the least key, in two steps: inside hashed slices, then of what is left; no group meets whole."""
    w = Window.partitionBy(*group, "_slice").orderBy("_key")
    some = rows.withColumn("_key", key).withColumn("_slice", F.pmod(F.xxhash64("_key"), F.lit(slices))).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    w = Window.partitionBy(*group).orderBy("_key")
    return some.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_key", "_slice", "_r")


def mass_weights(rows: DataFrame, online: str, kept: str, ratio: float) -> DataFrame:
    """Sampling weights: the kept online rows share ``ratio`` of the mass, the kept others the rest; adds ``weight``, which sums to 1."""
    n = rows.agg(F.sum(F.when(F.col(online) & F.col(kept), 1)).alias("a"), F.sum(F.when(~F.col(online) & F.col(kept), 1)).alias("b"))
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    share = F.when(~F.col(kept), 0.0).when(F.col(online), F.when(b == 0, 1.0).otherwise(ratio) / a).otherwise(F.when(a == 0, 1.0).otherwise(1 - ratio) / b)
    return rows.join(F.broadcast(n), how="cross").withColumn("weight", share).drop("a", "b")


def eligible_tier(edge: Column, tiers: list[int], u: Column) -> Column:
    """One of the tiers not above the edge, by u; the smallest tier where none is."""
    fit = F.filter(F.array(*[F.lit(t) for t in sorted(tiers)]), lambda t: t <= edge)
    n = F.size(fit)
    return F.when(n == 0, F.lit(min(tiers))).otherwise(F.element_at(fit, (F.floor(u * n) + 1).cast("int")))

