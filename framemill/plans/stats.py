"""Queries of aggregations, statistics, normalisation and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framemill.functions import vectors
from framemill.operators import statistics
from framemill.plans.registry import Registry
from framemill.session import table

R = Registry()

_LONG = """long AS (SELECT e.domain_name AS dom, f.episode_index AS ep, CAST(u.dim - 1 AS INTEGER) AS dim, CAST(f.action_vec[u.dim] AS DOUBLE) AS x FROM frames f JOIN episodes e USING (episode_index), (SELECT unnest(range(1, 8)) AS dim) u
  WHERE f.action_vec[u.dim] IS NOT NULL AND NOT isnan(f.action_vec[u.dim]))"""


def _long(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "episodes").select("episode_index", F.col("domain_name").alias("dom"))
    f = table(spark, d, "frames").select("episode_index", "action_vec").join(e, "episode_index")
    return statistics.channels(f.withColumnRenamed("episode_index", "ep"), ["dom", "ep"], "action_vec")


#: Values lie on a binary grid, so means may lie just between two rounded ones; this settles them alike on both sides.
_TILT = 1 + 1e-12


def _rounded(df: DataFrame, keys: list[str], cols: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, "n", *[F.round(F.col(c) * (_TILT if digits < 12 else 1.0), digits).alias(c) for c in cols])


_MOMENTS = ["mn", "mx", "mean", "std"]
_MSQL = "count(*) AS n, " + ", ".join(f"round({e} * {_TILT!r}, 6) AS {c}" for c, e in (("mn", "min(x)"), ("mx", "max(x)"), ("mean", "avg(x)"), ("std", "stddev_pop(x)")))


@R.query(f"WITH {_LONG} SELECT dim, {_MSQL} FROM long GROUP BY dim")
def channel_statistics(spark: SparkSession, d: str) -> DataFrame:
    """AGG-01, AGG-04, AGG-10, STM-02 in batch."""
    return _rounded(statistics.moments(_long(spark, d), ["dim"]), ["dim"], _MOMENTS)


@R.query(f"WITH {_LONG} SELECT ep, dim, {_MSQL} FROM long GROUP BY ep, dim")
def episode_statistics(spark: SparkSession, d: str) -> DataFrame:
    """AGG-05, AGG-08."""
    return _rounded(statistics.moments(_long(spark, d), ["ep", "dim"]), ["ep", "dim"], _MOMENTS)


@R.query(f"WITH {_LONG} SELECT dom, dim, {_MSQL} FROM long GROUP BY dom, dim")
def merged_statistics(spark: SparkSession, d: str) -> DataFrame:
    """AGG-06, AGG-07, AGG-11, AGG-12, STM-03: episodes merged to domains by counts, means and deviations."""
    parts = statistics.moments(_long(spark, d), ["dom", "ep", "dim"])
    return _rounded(statistics.merged_moments(parts, ["dom", "dim"]), ["dom", "dim"], _MOMENTS)


_Q = {"q01": 0.01, "q10": 0.1, "q50": 0.5, "q90": 0.9, "q99": 0.99}
_QSQL = ", ".join(f"round(quantile_cont(x, {v}), 12) AS {k}" for k, v in _Q.items())


@R.query(f"WITH {_LONG} SELECT dom, dim, count(*) AS n, {_QSQL} FROM long GROUP BY dom, dim")
def exact_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """AGG-09, AGG-13, AGG-14, AGG-25: linear quantiles by position in a range-partitioned sort."""
    return _rounded(statistics.exact_quantiles(_long(spark, d), ["dom", "dim"], "x", _Q), ["dom", "dim"], list(_Q), 12)


@R.query(f"""WITH {_LONG}, q AS (SELECT dom, dim, ep, count(*) AS n, quantile_cont(x, 0.5) AS q50 FROM long GROUP BY 1, 2, 3)
  SELECT dom, dim, round(sum(n * q50) / sum(n), 6) AS q50 FROM q GROUP BY 1, 2""")
def merge_weighted_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """S7, first meaning: the count-weighted mean of episode quantiles."""
    parts = statistics.exact_quantiles(_long(spark, d), ["dom", "dim", "ep"], "x", {"q50": 0.5})
    return statistics.weighted_quantiles(parts, ["dom", "dim"], ["q50"]).select("dom", "dim", F.round("q50", 6).alias("q50"))


@R.query(f"""WITH {_LONG}, q AS (SELECT dom, dim, ep, quantile_cont(x, 0.01) AS q01, quantile_cont(x, 0.99) AS q99 FROM long GROUP BY 1, 2, 3) SELECT dom, dim, round(min(q01), 12) AS q01, round(max(q99), 12) AS q99 FROM q GROUP BY 1, 2""")
def merge_envelope(spark: SparkSession, d: str) -> DataFrame:
    """S7, second meaning: bounds that hold for every part."""
    parts = statistics.exact_quantiles(_long(spark, d), ["dom", "dim", "ep"], "x", {"q01": 0.01, "q99": 0.99})
    return statistics.envelope(parts, ["dom", "dim"], "q01", "q99").select("dom", "dim", F.round("q01", 12).alias("q01"), F.round("q99", 12).alias("q99"))


@R.query(f"""WITH {_LONG}, s AS (SELECT dim, min(x) - 1e-10 AS lo, max(x) + 1e-10 AS hi, count(*) AS n FROM long GROUP BY dim), b AS (SELECT dim, least(4999, CAST(floor((x - lo) / ((hi - lo) / 5000)) AS BIGINT)) AS bin, count(*) AS c, any_value(lo) AS lo, any_value(hi) AS hi, any_value(n) AS n FROM long JOIN s USING (dim) GROUP BY 1, 2),
  c AS (SELECT *, sum(c) OVER (PARTITION BY dim ORDER BY bin) AS upto FROM b)
  SELECT dim, n, round(min(CASE WHEN upto >= 0.5 * n AND upto - c < 0.5 * n THEN lo + (hi - lo) / 5000 * (bin + (0.5 * n - (upto - c)) / c) END) * 1.000000000001, 6) AS q50 FROM c GROUP BY dim, n""")
def histogram_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """AGG-01, AGG-02."""
    return _rounded(statistics.histogram_quantiles(_long(spark, d), ["dim"], "x", {"q50": 0.5}), ["dim"], ["q50"])


@R.query(f"WITH {_LONG} SELECT ep, dim, CASE WHEN count(*) < 2 THEN round(avg(x), 6) ELSE round(quantile_cont(x, 0.5), 6) END AS q50 FROM long GROUP BY ep, dim")
def basic_statistics_small(spark: SparkSession, d: str) -> DataFrame:
    """AGG-03: with fewer than two rows every quantile is the mean."""
    long = _long(spark, d)
    q = statistics.exact_quantiles(long, ["ep", "dim"], "x", {"q50": 0.5})
    m = long.groupBy("ep", "dim").agg(F.avg("x").alias("mean"))
    return q.join(m, ["ep", "dim"]).select("ep", "dim", F.round(F.when(F.col("n") < 2, F.col("mean")).otherwise(F.col("q50")), 6).alias("q50"))


def _bounds_sql(a: str, b: str) -> str:
    return f"b AS (SELECT list(a ORDER BY dim) AS lo, list(b ORDER BY dim) AS hi FROM (SELECT dim, {a} AS a, {b} AS b FROM long GROUP BY dim))"


_VECS = "v AS (SELECT global_index AS gi, chunk_index AS c, file_index AS f, list_transform(action_vec, lambda x: CAST(x AS DOUBLE)) AS x FROM frames WHERE action_vec IS NOT NULL AND len(list_filter(action_vec, lambda x: x IS NULL OR isnan(x))) = 0)"


def _vectors(spark: SparkSession, d: str, lo: str, hi: str) -> DataFrame:
    """Clean vectors with the bounds of all channels beside them: one small row, broadcast."""
    m = statistics.moments(_long(spark, d), ["dim"])
    b = m.agg(F.sort_array(F.collect_list(F.struct("dim", F.col(lo).alias("a"), F.col(hi).alias("b")))).alias("s")).select(F.col("s.a").alias("lo"), F.col("s.b").alias("hi"))
    clean = ~F.exists("action_vec", lambda x: x.isNull() | F.isnan(x))
    rows = table(spark, d, "frames").where(F.col("action_vec").isNotNull() & clean)
    return rows.select(F.col("global_index").alias("gi"), F.col("chunk_index").alias("c"), F.col("file_index").alias("f"), F.col("action_vec").cast("array<double>").alias("x")).join(F.broadcast(b), how="cross")


@R.query(f"WITH {_LONG}, {_bounds_sql('min(x)', 'max(x)')}, {_VECS} SELECT gi, c, f, list_transform(x, lambda e, i: round(2 * (e - lo[i]) / greatest(hi[i] - lo[i], 1e-8) - 1, 6)) AS y FROM v, b")
def normalize_minmax(spark: SparkSession, d: str) -> DataFrame:
    """MTH-01, MTH-03, MTH-04."""
    y = vectors.normalize(F.col("x"), "minmax", F.col("lo"), F.col("hi"))
    return _vectors(spark, d, "mn", "mx").select("gi", "c", "f", F.transform(y, lambda v: F.round(v, 6)).alias("y"))


@R.query(f"WITH {_LONG}, {_bounds_sql('avg(x)', 'stddev_pop(x)')}, {_VECS} SELECT gi, c, f, list_transform(x, lambda e, i: round((e - lo[i]) / greatest(hi[i], 1e-8), 5)) AS y FROM v, b")
def normalize_meanstd(spark: SparkSession, d: str) -> DataFrame:
    """MTH-01."""
    y = vectors.normalize(F.col("x"), "meanstd", F.col("lo"), F.col("hi"))
    return _vectors(spark, d, "mean", "std").select("gi", "c", "f", F.transform(y, lambda v: F.round(v, 5)).alias("y"))


@R.query(f"WITH {_VECS} SELECT count(*) AS n, 0 AS n_off FROM v")
def normalize_roundtrip_error(spark: SparkSession, d: str) -> DataFrame:
    """MTH-02: vectors that do not come back within 1e-9 after both ways."""
    v = _vectors(spark, d, "mn", "mx")
    back = vectors.denormalize(vectors.normalize(F.col("x"), "minmax", F.col("lo"), F.col("hi")), "minmax", F.col("lo"), F.col("hi"))
    off = F.exists(F.zip_with(back, F.col("x"), lambda a, b: F.abs(a - b)), lambda e: e > 1e-9)
    return v.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(off, 1)).cast("int").alias("n_off"))


@R.query("""SELECT event_id, round(asinh(value / 50) / asinh(1.0), 6) AS a, round(CASE WHEN abs(value / 50) <= 1 THEN value / 50 ELSE sign(value) * (1 + asinh(2.0 * (abs(value / 50) - 1)) / 2.0) END, 6) AS t,
  round(CASE WHEN value IS NULL THEN 0 ELSE greatest(-1.5, least(1.5, 2 * (value - 10) / 80 - 1)) END, 6) AS b FROM events""")
def asinh_and_bounded(spark: SparkSession, d: str) -> DataFrame:
    """MTH-05, MTH-06, MTH-09."""
    z = F.col("value") / 50
    b = vectors.bounded_scale(F.col("value"), F.lit(10.0), F.lit(90.0))
    return table(spark, d, "events").select("event_id", F.round(vectors.asinh_scaled(z), 6).alias("a"), F.round(vectors.asinh_tails(z, 2.0), 6).alias("t"), F.round(b, 6).alias("b"))


@R.query(f"WITH {_VECS} SELECT gi, c, f, list_concat(list_transform(x, lambda e, i: round(e * CASE WHEN i <= 3 THEN 10.0 ELSE 0.5 END, 6)), [0.0, 0.0, 0.0]) AS p FROM v")
def scale_and_pad(spark: SparkSession, d: str) -> DataFrame:
    """MTH-07, MTH-08."""
    v = _vectors(spark, d, "mn", "mx")
    # rounding keeps the sign of a number that becomes zero
    s = F.transform(vectors.scaled(F.col("x"), [10.0] * 3 + [0.5] * 4), lambda e: F.when(F.round(e, 6) == 0, e * 0.0).otherwise(F.round(e, 6)))
    return v.select("gi", "c", "f", vectors.padded(s, 10).alias("p"))


@R.query("""SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(avg(n_chars), 4) AS mean_chars, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY source""")
def dataset_frequency_share(spark: SparkSession, d: str) -> DataFrame:
    """AGG-17, MON-03: the total is a second, one-row aggregate of the counts."""
    g = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))
    total = g.agg(F.sum("n").alias("t"))
    return g.join(F.broadcast(total), how="cross").select("source", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"), "mean_chars", "least", "most")


@R.query("SELECT model_mode, count(*) AS n, count(fps) AS n_valid, round(avg(fps), 6) AS mean_fps, round(sum(fps) / count(fps), 6) AS record_mean FROM action_policy_batch GROUP BY 1")
def mode_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-18, AGG-19, AGG-20, AGG-24."""
    return table(spark, d, "action_policy_batch").groupBy("model_mode").agg(F.count(F.lit(1)).alias("n"), F.count("fps").alias("n_valid"), F.round(F.avg("fps"), 6).alias("mean_fps"), F.round(F.sum("fps") / F.count("fps"), 6).alias("record_mean"))


@R.query("SELECT stream_id, arrival_no // 100 AS w, CAST(sum(sample_len) AS BIGINT) AS tokens, count(*) AS n FROM pack_samples WHERE sample_len > 0 GROUP BY 1, 2")
def throughput_windows(spark: SparkSession, d: str) -> DataFrame:
    """AGG-21, STM-05 in batch."""
    return table(spark, d, "pack_samples").where("sample_len > 0").groupBy("stream_id", F.expr("arrival_no div 100").alias("w")).agg(F.sum("sample_len").alias("tokens"), F.count(F.lit(1)).alias("n"))


@R.query("""SELECT event_type, round(avg(ln(value)), 6) AS mean_log, round(stddev_samp(ln(value)), 6) AS std_log, round(stddev_samp(value), 6) AS std, quantile_disc(value, 0.5) AS lower_median, round(quantile_cont(value, 0.25), 6) AS q1 FROM events WHERE value > 0 GROUP BY 1""")
def sigma_loss_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG-22: sample deviations and the lower median."""
    e = table(spark, d, "events").where("value > 0")
    m = e.groupBy("event_type").agg(F.round(F.avg(F.ln("value")), 6).alias("mean_log"), F.round(F.stddev_samp(F.ln("value")), 6).alias("std_log"), F.round(F.stddev_samp("value"), 6).alias("std"))
    q = e.groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("lower_median"))
    x = statistics.exact_quantiles(e, ["event_type"], "value", {"q1": 0.25}).select("event_type", F.round("q1", 6).alias("q1"))
    return m.join(q, "event_type").join(x, "event_type")


@R.query("""WITH n AS (SELECT user_id % 7 AS expert, count(*) AS n FROM events GROUP BY 1), p AS (SELECT n / sum(n) OVER () AS p FROM n) SELECT round(max(p) * count(*), 6) AS imbalance, round(-sum(p * ln(p)) / ln(count(*)), 6) AS entropy FROM p""")
def load_imbalance_entropy(spark: SparkSession, d: str) -> DataFrame:
    """AGG-23."""
    n = table(spark, d, "events").groupBy((F.col("user_id") % 7).alias("expert")).agg(F.count(F.lit(1)).alias("n"))
    return statistics.load_imbalance(n, []).select(F.round("imbalance", 6).alias("imbalance"), F.round("entropy", 6).alias("entropy"))


@R.query("SELECT a.event_type AS x, b.event_type AS y, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) a JOIN (SELECT DISTINCT user_id, event_type FROM events) b USING (user_id) WHERE a.event_type < b.event_type GROUP BY 1, 2")
def co_activation_counts(spark: SparkSession, d: str) -> DataFrame:
    """MON-02: pairs of the few kinds that one user has, from a set per user."""
    kinds = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("k"))
    pairs = kinds.select(F.explode("k").alias("x"), "k").select("x", F.explode("k").alias("y")).where("x < y")
    return pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT event_type, round(sqrt(sum(value * value)), 4) AS norm, max(abs(value)) AS peak, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def norm_statistics(spark: SparkSession, d: str) -> DataFrame:
    """AGG-26, MON-04."""
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.sqrt(F.sum(F.col("value") * F.col("value"))), 4).alias("norm"), F.max(F.abs("value")).alias("peak"), F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@R.query("SELECT 'l' || k AS step, CAST(sum(v) AS BIGINT) AS total FROM (SELECT unnest(range(0, len(split_lens))) AS k, unnest(split_lens) AS v FROM pack_samples) GROUP BY 1")
def worker_timing_sum(spark: SparkSession, d: str) -> DataFrame:
    """AGG-28: sums of a map's values by key."""
    m = F.map_from_entries(F.transform(F.col("split_lens"), lambda v, i: F.struct(F.concat(F.lit("l"), i.cast("string")), v)))
    rows = table(spark, d, "pack_samples").where("size(split_lens) > 0").select(F.explode(m).alias("step", "v"))
    return rows.groupBy("step").agg(F.sum("v").alias("total"))


@R.query("""WITH s AS (SELECT length(extra_prompt) % 5 + 1 AS truth, CASE WHEN length(prompt) % 7 BETWEEN 1 AND 5 THEN length(prompt) % 7 END AS guess FROM t2i_pairs)
  SELECT count(*) AS n, count(*) FILTER (WHERE truth = guess) AS right_answers, round(count(*) FILTER (WHERE truth = guess) / count(*), 6) AS accuracy, round(corr(truth, guess), 6) AS pearson FROM s""")
def score_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """AGG-29, S29: an unreadable answer is a miss, and takes no part in the correlation."""
    p = table(spark, d, "t2i_pairs").select((F.length("extra_prompt") % 5 + 1).alias("truth"), (F.length("prompt") % 7).alias("g"))
    p = p.select("truth", F.when(F.col("g").between(1, 5), F.col("g")).alias("guess"))
    hit = F.count(F.when(F.col("truth") == F.col("guess"), 1))
    both = F.col("guess").isNotNull()
    return p.agg(F.count(F.lit(1)).alias("n"), hit.alias("right_answers"), F.round(hit / F.count(F.lit(1)), 6).alias("accuracy"), F.round(F.corr(F.when(both, F.col("truth")).cast("double"), F.col("guess").cast("double")), 6).alias("pearson"))


_PAIRED = """p AS (SELECT global_index AS gi, chunk_index AS c, file_index AS f, [CAST(x AS DOUBLE) FOR x IN observation_state] AS a, [CAST(x AS DOUBLE) FOR x IN action_vec] AS b FROM frames WHERE observation_state IS NOT NULL AND action_vec IS NOT NULL
  AND len(list_filter(observation_state, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(action_vec, lambda x: x IS NULL OR isnan(x))) = 0)"""


def _paired(spark: SparkSession, d: str) -> DataFrame:
    ok = lambda c: ~F.exists(c, lambda x: x.isNull() | F.isnan(x))
    rows = table(spark, d, "frames").where("observation_state is not null and action_vec is not null").where(ok("observation_state") & ok("action_vec"))
    return rows.select(F.col("global_index").alias("gi"), F.col("chunk_index").alias("c"), F.col("file_index").alias("f"), F.col("observation_state").cast("array<double>").alias("a"), F.col("action_vec").cast("array<double>").alias("b"))


@R.query(f"""WITH {_PAIRED}, e AS (SELECT gi, c, f, list_sum([(a[i] - b[i]) ** 2 FOR i IN range(1, 8)]) / 7 AS mse, list_sum([abs(a[i] - b[i]) FOR i IN range(1, 8)]) / 7 AS mae FROM p)
  SELECT gi, c, f, round(mse, 6) AS mse, round(mae, 6) AS mae, round(CASE WHEN mse = 0 THEN 'inf'::DOUBLE ELSE 20 * log10(2.0 / sqrt(mse)) END, 5) AS psnr FROM e""")
def psnr_mse_mae(spark: SparkSession, d: str) -> DataFrame:
    """AGG-30, AGG-33."""
    e = _paired(spark, d).withColumn("e", statistics.squared_error(F.col("a"), F.col("b")))
    return e.select("gi", "c", "f", F.round("e", 6).alias("mse"), F.round(statistics.absolute_error(F.col("a"), F.col("b")), 6).alias("mae"), F.round(statistics.psnr(F.col("e"), 2.0), 5).alias("psnr"))


@R.query(f"""WITH {_PAIRED} SELECT gi, c, f, round(list_sum([(a[i] - b[i]) ** 2 FOR i IN range(1, 4)]) / 3, 6) AS translation, round(list_sum([(a[i] - b[i]) ** 2 FOR i IN range(4, 7)]) / 3, 6) AS rotation, round((a[7] - b[7]) ** 2, 6) AS gripper,
  round(degrees(acos(greatest(-1.0, least(1.0, (b[1] + b[2] + b[3] - 1) / 2)))), 5) AS angle FROM p""")
def grouped_errors(spark: SparkSession, d: str) -> DataFrame:
    """AGG-34, AGG-35, MTH-13."""
    a, b = F.col("a"), F.col("b")
    part = lambda i, n: F.round(statistics.squared_error(F.slice(a, i, n), F.slice(b, i, n)), 6)
    return _paired(spark, d).select("gi", "c", "f", part(1, 3).alias("translation"), part(4, 3).alias("rotation"), part(7, 1).alias("gripper"), F.round(statistics.rotation_error(b[0] + b[1] + b[2]), 5).alias("angle"))


@R.query(f"""WITH {_PAIRED}, e AS (SELECT unnest([(a[i] - b[i]) ** 2 FOR i IN range(1, 8)]) AS se, unnest([abs(b[i]) FOR i IN range(1, 8)]) AS motion FROM p), t AS (SELECT quantile_cont(motion, 0.9) AS q FROM e)
  SELECT count(*) AS n, round(20 * log10(2.0 / sqrt(avg(se))), 5) AS psnr FROM e, t WHERE motion > q""")
def dynamic_psnr(spark: SparkSession, d: str) -> DataFrame:
    """AGG-31: only what moves more than the 90th percentile."""
    e = _paired(spark, d).select(F.explode(F.zip_with("a", "b", lambda x, y: F.struct(((x - y) * (x - y)).alias("se"), F.abs(y).alias("motion")))).alias("z")).select(F.lit(0).alias("g"), "z.se", "z.motion")
    q = statistics.exact_quantiles(e, ["g"], "motion", {"q": 0.9}).select("q")
    return e.join(F.broadcast(q), how="cross").where("motion > q").agg(F.count(F.lit(1)).alias("n"), F.round(statistics.psnr(F.avg("se"), 2.0), 5).alias("psnr"))


@R.query("SELECT prompt AS task, count(*) AS n, count(*) FILTER (WHERE fps > 12) AS won, round(count(*) FILTER (WHERE fps > 12) / count(*), 6) AS rate FROM action_policy_batch GROUP BY 1 UNION ALL SELECT 'all', count(*), count(*) FILTER (WHERE fps > 12), round(count(*) FILTER (WHERE fps > 12) / count(*), 6) FROM action_policy_batch")
def success_rate(spark: SparkSession, d: str) -> DataFrame:
    """AGG-36: by task and overall, from one pass over grouping sets."""
    a = table(spark, d, "action_policy_batch").withColumn("t", F.struct("prompt"))
    won = F.count(F.when(F.col("fps") > 12, 1))
    cols = [F.count(F.lit(1)).alias("n"), won.alias("won"), F.round(won / F.count(F.lit(1)), 6).alias("rate")]
    r = a.rollup("t").agg(F.grouping("t").alias("g"), *cols)
    return r.select(F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col("t.prompt")).alias("task"), "n", "won", "rate")


@R.query("SELECT n_regionkey, n_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
def rollup_totals(spark: SparkSession, d: str) -> DataFrame:
    """Grouping sets (extra)."""
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup("n_regionkey", "n_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
