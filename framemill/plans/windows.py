"""Queries of window, time-series and segment operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framemill.operators import episodic, lookups, segments
from framemill.plans.base import ENDS, STEPS, steps
from framemill.plans.registry import Registry
from framemill.session import broadcast_if_small, table

R = Registry()

# WIN-01..03, WIN-06, WIN-07


def _delta_sql(deltas: dict[str, int], value: str = "v") -> str:
    cols, joins = [], []
    for n, k in deltas.items():
        joins.append(f"LEFT JOIN steps s_{n} ON s_{n}.ep = s.ep AND s_{n}.i = s.i + ({k})")
        cols.append(f"CASE WHEN s.i + ({k}) < start THEN v0 WHEN s.i + ({k}) >= stop THEN v1 ELSE s_{n}.{value} END AS {n}, s.i + ({k}) < start OR s.i + ({k}) >= stop AS {n}_is_pad")
    return f"WITH {STEPS}, {ENDS} SELECT s.ep, s.i, s.v, {', '.join(cols)} FROM steps s JOIN ends USING (ep) {' '.join(joins)}"


_DELTAS = {"v_m2": -2, "v_0": 0, "v_p3": 3}


@R.query(_delta_sql(_DELTAS))
def delta_window_clamped(spark: SparkSession, d: str) -> DataFrame:
    return episodic.delta_window(steps(spark, d).select("ep", "i", "v"), ["ep"], "i", "v", _DELTAS)


@R.query(f"""WITH {STEPS} SELECT s.ep, s.i,
  CASE WHEN m1.i IS NOT NULL THEN m1.v ELSE s.v END AS m1, m1.i IS NULL AS m1_is_pad,
  CASE WHEN m1.i IS NULL THEN s.v WHEN m2.i IS NULL THEN m1.v ELSE m2.v END AS m2, m1.i IS NULL OR m2.i IS NULL AS m2_is_pad,
  CASE WHEN p1.i IS NOT NULL THEN p1.v ELSE s.v END AS p1, p1.i IS NULL AS p1_is_pad
  FROM steps s LEFT JOIN steps m1 ON m1.ep = s.ep AND m1.i = s.i - 1 LEFT JOIN steps m2 ON m2.ep = s.ep AND m2.i = s.i - 2 LEFT JOIN steps p1 ON p1.ep = s.ep AND p1.i = s.i + 1""")
def delta_window_bounded_fill(spark: SparkSession, d: str) -> DataFrame:
    """WIN-04, WIN-05: going outward, the last frame found stands once one is missing."""
    return episodic.bounded_fill(steps(spark, d).select("ep", "i", "v"), ["ep"], "i", "v", 2, 1).drop("v")


@R.query("""SELECT DISTINCT fps, delta_s, round_even(delta_s * fps, 0)::BIGINT AS frames, abs(delta_s * fps - round_even(delta_s * fps, 0)) / fps <= 0.0001 AS on_grid
  FROM episodes, (SELECT unnest([-0.5, -0.1, 0.0, 0.2, 0.25, 0.5]::DOUBLE[]) AS delta_s) WHERE fps > 0""")
def delta_grid_check(spark: SparkSession, d: str) -> DataFrame:
    """FLT-25, WIN-09: deltas in seconds to frames, and whether they lie on the frame grid."""
    near = F.bround(F.col("delta_s") * F.col("fps"), 0)
    rows = table(spark, d, "episodes").where("fps > 0").select("fps").distinct().withColumn("delta_s", F.explode(F.array(*[F.lit(x) for x in (-0.5, -0.1, 0.0, 0.2, 0.25, 0.5)])))
    return rows.select("fps", "delta_s", near.cast("bigint").alias("frames"), (F.abs(F.col("delta_s") * F.col("fps") - near) / F.col("fps") <= 0.0001).alias("on_grid"))


@R.query(f"""WITH {STEPS} SELECT s.ep, s.i, CASE WHEN p.i IS NULL THEN 0.0 ELSE abs(s.v - p.v) END AS dv FROM steps s LEFT JOIN steps p ON p.ep = s.ep AND p.i = s.i - 1""")
def frame_differences(spark: SparkSession, d: str) -> DataFrame:
    """WIN-19."""
    return _moved(spark, d).select("ep", "i", "dv")


def _moved(spark: SparkSession, d: str) -> DataFrame:
    base = steps(spark, d).select("ep", "i", "v")
    cols = {"pv": episodic.at_offset(F.col("v"), -1), "pn": lambda w: F.count(F.lit(1)).over(w.rangeBetween(-1, -1))}
    near = episodic.windowed(base, ["ep"], "i", 1, 0, cols)
    return near.select("ep", "i", "v", F.when(F.col("pn") == 0, F.lit(0.0)).otherwise(F.abs(F.col("v") - F.col("pv"))).alias("dv"))


_IDLE = f"""{STEPS}, moved AS (SELECT s.ep, s.i, coalesce(CASE WHEN p.i IS NULL THEN 0.0 ELSE abs(s.v - p.v) END < 0.06, false) AS idle FROM steps s LEFT JOIN steps p ON p.ep = s.ep AND p.i = s.i - 1),
  runs AS (SELECT ep, min(i) AS first, count(*) AS length FROM (SELECT ep, i, i - row_number() OVER (PARTITION BY ep ORDER BY i) AS g FROM moved WHERE idle) GROUP BY ep, g)"""


@R.query(f"WITH {_IDLE} SELECT * FROM runs WHERE length >= 3")
def idle_streaks(spark: SparkSession, d: str) -> DataFrame:
    """WIN-20: runs of at least three idle frames."""
    flagged = _moved(spark, d).withColumn("idle", F.coalesce(F.col("dv") < 0.06, F.lit(False)))
    return episodic.running_islands(flagged, ["ep"], "i", "idle", 3)


@R.query(f"""WITH {_IDLE}, b AS (SELECT ep, min(i) AS a, max(i) AS z FROM moved GROUP BY ep), stop AS (SELECT ep, min(i) AS s FROM moved WHERE NOT idle GROUP BY ep)
  SELECT ep, coalesce(s, z + 1) - a AS length FROM b LEFT JOIN stop USING (ep)""")
def initial_idle_frames(spark: SparkSession, d: str) -> DataFrame:
    """WIN-21: only the streak an episode begins with."""
    flagged = _moved(spark, d).withColumn("idle", F.coalesce(F.col("dv") < 0.06, F.lit(False)))
    return episodic.initial_run(flagged, ["ep"], "i", "idle")


_SLIDE = f"""{STEPS}, slid AS (SELECT s.ep, s.i, round(sum(x.a), 6) AS total, max(x.a) - min(x.a) AS spread, count(x.a) AS n
  FROM steps s JOIN steps x ON x.ep = s.ep AND x.i BETWEEN s.i AND s.i + 4 WHERE NOT isnan(x.a) GROUP BY s.ep, s.i)"""


def _slid(spark: SparkSession, d: str) -> DataFrame:
    base = steps(spark, d).select("ep", "i", "a")
    a = F.when(~F.isnan("a"), F.col("a"))
    cols = {
        "total": lambda w: F.round(F.sum(a).over(w.rangeBetween(0, 4)), 6),
        "spread": lambda w: F.max(a).over(w.rangeBetween(0, 4)) - F.min(a).over(w.rangeBetween(0, 4)),
        "n": lambda w: F.count(a).over(w.rangeBetween(0, 4)),
    }
    return episodic.windowed(base, ["ep"], "i", 0, 4, cols).where("n > 0").drop("a")


@R.query(f"WITH {_SLIDE} SELECT * FROM slid WHERE n > 0")
def sliding_statistics(spark: SparkSession, d: str) -> DataFrame:
    """WIN-22."""
    return _slid(spark, d)


@R.query(f"WITH {_SLIDE} SELECT ep, arg_max(i, (spread, -i)) AS i, max(spread) AS spread FROM slid WHERE n = 5 GROUP BY ep HAVING max(spread) > 0")
def best_segment(spark: SparkSession, d: str) -> DataFrame:
    """FLT-13, SRT-06: the window with the highest score of each episode, the first of equals."""
    best = F.max(F.struct("spread", (-F.col("i")).alias("m"))).alias("b")
    return _slid(spark, d).where("n = 5").groupBy("ep").agg(best).select("ep", (-F.col("b.m")).alias("i"), F.col("b.spread").alias("spread")).where("spread > 0")


_PROGRESS = f"""{STEPS}, ends AS (SELECT ep, min(i) AS start, max(i) + 1 AS stop FROM steps GROUP BY ep),
  p AS (SELECT ep, i, (i - start) / (stop - start)::DOUBLE AS progress, stop FROM steps JOIN ends USING (ep)),
  dl AS (SELECT p.ep, p.i, q.progress - p.progress AS delta FROM p LEFT JOIN p q ON q.ep = p.ep AND q.i = least(p.i + 10, p.stop - 1)),
  m AS (SELECT avg(delta) AS mu, stddev_pop(delta) AS sd FROM dl),
  w AS (SELECT ep, i, CASE WHEN delta IS NULL THEN 1.0 WHEN delta > 0.2 THEN 1.0 WHEN delta >= 0 THEN least(1.0, greatest(0.0, (delta - (mu - 2 * sd)) / (4 * sd + 0.000001))) ELSE 0.0 END AS weight FROM dl, m)"""


def _weights(spark: SparkSession, d: str) -> DataFrame:
    base = steps(spark, d).select("ep", "i")
    ends = broadcast_if_small(episodic.bounds(base, ["ep"], "i"), 64)
    base = base.join(ends, "ep").select("ep", "i", ((F.col("i") - F.col("start")) / (F.col("stop") - F.col("start"))).alias("progress"))
    return episodic.progress_weights(base, ["ep"], "i", "progress", 10, 0.2)


@R.query(f"WITH {_PROGRESS} SELECT ep, i, round(weight, 6) AS weight FROM w")
def progress_weights(spark: SparkSession, d: str) -> DataFrame:
    """JON-11, WIN-23."""
    return _weights(spark, d).select("ep", "i", F.round("weight", 6).alias("weight"))


@R.query(f"WITH {_PROGRESS} SELECT i % 64 AS batch, round(min(weight) * count(*) / sum(weight), 5) AS lowest, round(max(weight) * count(*) / sum(weight), 5) AS highest FROM w GROUP BY 1")
def batch_normalised_weights(spark: SparkSession, d: str) -> DataFrame:
    """WIN-24: weights of a batch scaled to sum to its size; the aggregate is joined back by arithmetic, not by rows."""
    w = _weights(spark, d).groupBy((F.col("i") % 64).alias("batch")).agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"), F.sum("weight").alias("s"), F.count(F.lit(1)).alias("n"))
    scale = F.col("n") / F.col("s")
    return w.select("batch", F.round(F.col("lo") * scale, 5).alias("lowest"), F.round(F.col("hi") * scale, 5).alias("highest"))


@R.query(f"WITH {STEPS} SELECT ep, min(i) AS start, max(i) + 1 AS stop, count(*) AS n FROM steps GROUP BY ep")
def episode_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """WIN-25."""
    return episodic.bounds(steps(spark, d), ["ep"], "i", n=F.count(F.lit(1)))


@R.query("""SELECT episode_index, n AS length, CAST(sum(n) OVER (ORDER BY episode_index) - n AS BIGINT) AS from_index, CAST(sum(n) OVER (ORDER BY episode_index) AS BIGINT) AS to_index
  FROM (SELECT episode_index, coalesce(num_frames, 0) AS n FROM episodes)""")
def cumulative_offsets(spark: SparkSession, d: str) -> DataFrame:
    """WIN-26, SNK-04: running totals of episode lengths."""
    from framemill.operators.ordering import running_sum

    eps = table(spark, d, "episodes").select("episode_index", F.coalesce("num_frames", F.lit(0)).alias("length"))
    cum = running_sum(eps, "length", [F.col("episode_index")], "from_index", "offsets")
    return cum.select("episode_index", "length", "from_index", (F.col("from_index") + F.col("length")).alias("to_index"))


@R.query(f"""WITH {STEPS}, b AS (SELECT ep, i // 16 AS block, arg_min(a, i) AS a0 FROM (SELECT * FROM steps WHERE a IS NOT NULL AND NOT isnan(a)) GROUP BY 1, 2)
  SELECT s.ep, s.i, block, s.a - a0 AS a_rel FROM (SELECT * FROM steps WHERE a IS NOT NULL AND NOT isnan(a)) s JOIN b ON b.ep = s.ep AND b.block = s.i // 16""")
def block_anchor_encode(spark: SparkSession, d: str) -> DataFrame:
    """WIN-18."""
    base = steps(spark, d).where("a is not null and not isnan(a)").select("ep", "i", "a")
    return episodic.block_anchor(base, ["ep"], "i", 16, ["a"]).select("ep", "i", "block", "a_rel")


@R.query(f"WITH {STEPS} SELECT ep, CASE WHEN i = 0 THEN 0 ELSE 1 + (i - 1) // 8 END AS block, count(*) AS n FROM steps WHERE i >= 0 GROUP BY 1, 2")
def frame_block_ids(spark: SparkSession, d: str) -> DataFrame:
    """WIN-17, WIN-34."""
    return steps(spark, d).where("i >= 0").groupBy("ep", segments.block_id(F.col("i"), 8).alias("block")).agg(F.count(F.lit(1)).alias("n"))


@R.query(f"""WITH {STEPS}, b AS (SELECT DISTINCT ep, CASE WHEN i = 0 THEN 0 ELSE 1 + (i - 1) // 8 END AS block FROM steps WHERE i >= 0)
  SELECT q.ep, q.block AS q_block, k.block AS k_block FROM b q JOIN b k ON k.ep = q.ep AND k.block BETWEEN q.block - 2 AND q.block""")
def block_causal_visibility(spark: SparkSession, d: str) -> DataFrame:
    """WIN-35: blocks that a block sees."""
    b = steps(spark, d).where("i >= 0").select("ep", segments.block_id(F.col("i"), 8).alias("block")).distinct()
    return segments.visible_blocks(b.withColumnRenamed("block", "q_block"), b.withColumnRenamed("block", "k_block"), ["ep"], 2).select("ep", "q_block", "k_block")


@R.query("""SELECT episode_index, fps, ((num_frames - 1) // 4) * 4 + 1 AS kept, CAST(greatest(2, ceil(fps / 12)) AS BIGINT) AS stride,
  CAST(greatest(0, ceil((num_frames - 17) / 3.0)) AS BIGINT) AS n_starts FROM episodes WHERE num_frames > 0 AND fps IS NOT NULL""")
def episode_spans(spark: SparkSession, d: str) -> DataFrame:
    """WIN-12, WIN-28, WIN-33."""
    e = table(spark, d, "episodes").where("num_frames > 0 and fps is not null")
    n = F.col("num_frames")
    return e.select("episode_index", "fps", segments.truncated(n, 4).alias("kept"), segments.fps_stride(F.col("fps"), 2, 12).alias("stride"), segments.span_starts(n, 17, 3).alias("n_starts"))


_PLAN = """WITH e AS (SELECT episode_index, num_frames, greatest(0, num_frames - 1) AS avail, (greatest(0, num_frames - 1) // 4) * 4 AS whole FROM episodes WHERE num_frames IS NOT NULL),
  l AS (SELECT episode_index, unnest(list_distinct(list_append(range(0, avail - 60 + 1, 48), avail - 60))) AS start, 60 AS steps FROM e WHERE whole > 0 AND avail >= 60)
  SELECT episode_index, start, CAST(steps AS BIGINT) AS steps FROM l
  UNION ALL SELECT episode_index, 0, whole FROM e WHERE whole > 0 AND avail < 60
  UNION ALL SELECT episode_index, avail - whole, whole FROM e WHERE whole > 0 AND avail < 60 AND avail > whole"""


@R.query(_PLAN)
def segment_plan(spark: SparkSession, d: str) -> DataFrame:
    """WIN-10, with the tails of short episodes kept."""
    e = table(spark, d, "episodes").where("num_frames is not null").select("episode_index", "num_frames")
    return segments.segment_plan(e, "num_frames", 60, 12, 4, preserve_tail=True).drop("num_frames")


@R.query("""WITH e AS (SELECT episode_index, fps, 0 AS a, num_frames - 1 AS z, num_frames AS n, CAST(floor(fps * 4.0) AS BIGINT) AS most, CAST(floor(fps * 0.5) AS BIGINT) AS ov FROM episodes WHERE num_frames > 0 AND fps IS NOT NULL),
  c AS (SELECT *, CASE WHEN n <= most THEN 1 ELSE CAST(ceil((n - ov) / (most - ov)::DOUBLE) AS BIGINT) END AS k FROM e),
  w AS (SELECT *, unnest(range(0, k)) AS w, (n + (k - 1) * ov) // k AS base, (n + (k - 1) * ov) % k AS extra FROM c)
  SELECT episode_index, w AS "window", a + w * (base - ov) + least(w, extra) AS win_start, a + w * (base - ov) + least(w, extra) + base + CASE WHEN w < extra THEN 1 ELSE 0 END - 1 AS win_end FROM w""")
def balanced_windows(spark: SparkSession, d: str) -> DataFrame:
    """WIN-11."""
    e = table(spark, d, "episodes").where("num_frames > 0 and fps is not null").select("episode_index", "fps", F.lit(0).cast("bigint").alias("a"), (F.col("num_frames") - 1).alias("z"))
    return segments.balanced_windows(e, "a", "z", "fps", 4.0, 0.5).select("episode_index", "window", "win_start", "win_end")


@R.query("""WITH e AS (SELECT episode_index, num_frames AS n, num_frames // 3 AS s, least(num_frames, num_frames // 3 + 10) AS t FROM episodes WHERE num_frames > 0),
  x AS (SELECT *, least(n, s + CAST(ceil(greatest(1, t - s - 1) / 8.0) AS BIGINT) * 8 + 1) AS stop, CAST(ceil(greatest(1, t - s - 1) / 8.0) AS BIGINT) * 8 + 1 AS need FROM e)
  SELECT episode_index, greatest(0, stop - need) AS start, stop FROM x""")
def subtask_bounds(spark: SparkSession, d: str) -> DataFrame:
    """WIN-14."""
    n = F.col("num_frames")
    s = F.floor(n / 3)
    start, stop = segments.subtask_bounds(s, F.least(n, s + 10), n, 8)
    return table(spark, d, "episodes").where("num_frames > 0").select("episode_index", start.alias("start"), stop.alias("stop"))


@R.query(f"""WITH {STEPS}, ends AS (SELECT ep, max(i) AS z FROM steps GROUP BY ep) SELECT s.ep, s.i, CASE WHEN NOT isnan(t.a) THEN t.a END AS target FROM steps s JOIN ends USING (ep) LEFT JOIN steps t ON t.ep = s.ep AND t.i = s.i + 5 WHERE s.i + 5 <= z""")
def offset_targets(spark: SparkSession, d: str) -> DataFrame:
    """WIN-16: targets some frames ahead, null where the frame is missing or its number is NaN; starts beyond the last target are left out."""
    base = steps(spark, d).select("ep", "i", "a")
    ends = broadcast_if_small(base.groupBy("ep").agg(F.max("i").alias("z")), 64)
    ahead = episodic.windowed(base, ["ep"], "i", 0, 5, {"target": episodic.at_offset(F.col("a"), 5)})
    return ahead.join(ends, "ep").where("i + 5 <= z").select("ep", "i", F.when(~F.isnan("target"), F.col("target")).alias("target"))


@R.query(f"""WITH {STEPS}, p AS (SELECT s.ep, s.i, s.ts - q.ts AS gap, e.fps FROM steps s JOIN steps q ON q.ep = s.ep AND q.i = s.i - 1 JOIN episodes e ON e.episode_index = s.ep)
  SELECT ep, count(*) AS n, count(*) FILTER (WHERE abs(gap - 1 / fps) > 0.00001 + 0.0001 / fps) AS uneven FROM p WHERE gap IS NOT NULL GROUP BY ep""")
def uniform_sampling_check(spark: SparkSession, d: str) -> DataFrame:
    """FLT-26: time steps that are not 1 / fps."""
    near = episodic.windowed(steps(spark, d).select("ep", "i", "ts"), ["ep"], "i", 1, 0, {"pt": episodic.at_offset(F.col("ts"), -1)})
    fps = broadcast_if_small(table(spark, d, "episodes").select(F.col("episode_index").alias("ep"), "fps"), 64)
    gap = F.col("ts") - F.col("pt")
    off = F.abs(gap - 1 / F.col("fps")) > 0.00001 + 0.0001 / F.col("fps")
    return near.join(fps, "ep").where(gap.isNotNull()).groupBy("ep").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(off, 1)).alias("uneven"))


@R.query(f"""WITH {STEPS}, ends AS (SELECT ep, min(i) AS a, max(i) AS z FROM steps GROUP BY ep), k AS (SELECT ep, a, z, unnest(range(0, 9)) AS k FROM ends)
  SELECT ep, k, least(z, a + CAST(floor(k * fps / 4.0 + 0.5 - 1e-9) AS BIGINT)) AS i FROM k JOIN episodes ON episode_index = ep WHERE fps IS NOT NULL""")
def resample_target_rate(spark: SparkSession, d: str) -> DataFrame:
    """Rows at 4 per second by index and fps alone, as the SQL says it; timestamps are not read. WIN-32 is ``resample_nearest_time``."""
    ends = episodic.bounds(steps(spark, d), ["ep"], "i").withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(8).cast("bigint"))))
    e = broadcast_if_small(table(spark, d, "episodes").where("fps is not null").select(F.col("episode_index").alias("ep"), "fps"), 64)
    near = F.floor(F.col("k") * F.col("fps") / 4.0 + 0.5 - 1e-9)
    return ends.join(e, "ep").select("ep", "k", F.least(F.col("stop") - 1, F.col("start") + near).alias("i"))


@R.query(f"""WITH {STEPS}, fps AS (SELECT episode_index AS ep, max(fps) AS fps FROM episodes GROUP BY 1),
  timed AS (SELECT ep, i, CAST(floor(t * 1000000 + 0.5) AS BIGINT) AS us FROM (SELECT ep, i, coalesce(CASE WHEN NOT isnan(ts) THEN ts END, i / fps) AS t FROM steps LEFT JOIN fps USING (ep)) WHERE t IS NOT NULL), first AS (SELECT ep, min(us) AS t0 FROM timed GROUP BY ep),
  k AS (SELECT ep, t0, unnest(range(0, 9)) AS k FROM first), near AS (SELECT k.ep, k, i, row_number() OVER (PARTITION BY k.ep, k ORDER BY abs(us - t0 - k * 250000), us, i) AS place FROM k JOIN timed USING (ep))
  SELECT ep, k, i FROM near WHERE place = 1""")
def resample_nearest_time(spark: SparkSession, d: str) -> DataFrame:
    """WIN-32: rows nearest in time to target times at 4 per second from the first timestamp, ties to the earlier row, clamped to the last.

    Times are whole microseconds; a row without a timestamp stands at its index over fps. Of each target the rows within half a second are looked up by time;
    targets with none there, in a gap or past the end, take the nearer of the last row before and the first after.
    """
    fps = broadcast_if_small(table(spark, d, "episodes").groupBy(F.col("episode_index").alias("ep")).agg(F.max("fps").alias("fps")), 64)
    time = F.coalesce(F.when(~F.isnan("ts"), F.col("ts")), F.col("i") / F.col("fps"))
    us = F.floor(time * 1_000_000 + 0.5).cast("bigint")
    timed = steps(spark, d).join(fps, "ep", "left").select("ep", "i", us.alias("us")).where("us is not null")
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(8).cast("bigint")))
    targets = timed.groupBy("ep").agg(F.min("us").alias("t0")).withColumn("k", k).select("ep", "k", (F.col("t0") + F.col("k") * 250_000).alias("at"))
    near = lookups.asof_nearest(targets, timed, ["ep"], "at", "us", 500_000, ["us", "i"], ["ep", "k"], strict=False)
    rest = near.where("gap is null").select("ep", "k", "at")
    gap = F.abs(F.col("us") - F.col("at"))
    far = rest.join(timed, "ep").groupBy("ep", "k").agg(F.min(F.struct(gap.alias("g"), "us", "i")).alias("best")).select("ep", "k", "best.i")
    return near.where("gap is not null").select("ep", "k", F.col("i_near").alias("i")).unionByName(far)


@R.query("""SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i FROM events""")
def frame_index_assign(spark: SparkSession, d: str) -> DataFrame:
    """SNK-01: numbers of rows in the order of their episode, for episodes of any length."""
    rows = table(spark, d, "events").select("event_id", "user_id", "ts")
    return episodic.numbered(rows, ["user_id"], [F.col("ts"), F.col("event_id")]).select("event_id", "i")
