"""Samples: sizes, distinct frames, and equal chances however often and in how large files a frame is stored."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from framemill.llm import reservoir

T = datetime(2025, 1, 1)
FRAMES = "global_index bigint, episode_index bigint, frame_index bigint, timestamp_s double, chunk_index bigint, file_index bigint, ingested_at timestamp, domain string, i int, rec string"
META = "domain_name string, reservoir_size bigint, max_samples bigint, num_samples_stats bigint, sampling_seed bigint"


def frame(e, i, f, at=0, gi=0, ts=None):
    return (gi, e, i, ts, 0, f, T + timedelta(seconds=at), "clash", 1, "r")


@pytest.fixture(scope="module")
def tables(spark):
    rows = []
    for i in range(40):  # file 0 holds one frame, file 1 holds the rest; odd ones are stored again and again
        rows.append(frame(1, i, 0 if i == 0 else 1))
        rows += [frame(1, i, 2 + k, at=10 + k) for k in range(i % 2 * 5)]
    rows += [frame(2, i, 9) for i in range(10)] + [frame(3, None, 11, gi=i) for i in range(4)] + [frame(None, 3, 11)]
    frames = spark.createDataFrame(rows, FRAMES).cache()
    eps = spark.createDataFrame([(1, "a", 10.0), (2, "b", 10.0), (3, "c", None), (4, "d", 5.0)], "episode_index bigint, domain_name string, fps double")
    return frames, eps


def drawn(spark, tables, meta):
    return reservoir.draw(*tables, spark.createDataFrame(meta, META)).collect()


def test_sizes(spark, tables):
    meta = [("a", 15, None, 3, 1), ("b", 50, None, None, None), ("c", 3, 2, None, 0), ("d", 5, None, None, 0), ("x", 5, None, None, 0), (None, 5, None, None, 0)]
    got = drawn(spark, tables, meta)
    n = Counter(r["domain_name"] for r in got)
    assert n == {"a": 15, "b": 10, "c": 2}
    assert all(r["num_samples_stats"] == n[r["domain_name"]] for r in got)
    assert len({(r["episode_index"], r["frame_index"]) for r in got if r["domain_name"] == "a"}) == 15
    assert {(r["file_index"]) for r in got if r["domain_name"] == "a"} <= {0, 1}
    again = drawn(spark, tables, meta)
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_nothing_wanted(spark, tables):
    assert drawn(spark, tables, [("a", 0, None, None, 0), ("b", None, None, None, 0)]) == []
    assert drawn(spark, tables, []) == []
    assert reservoir.draw(tables[0].limit(0), tables[1], spark.createDataFrame([("a", 5, None, None, 0)], META)).collect() == []


@pytest.mark.parametrize("k", [8, 30])
def test_equal_chances(spark, k):
    """One domain for each of many seeds: how often each of 20 frames comes out."""
    seeds = range(300)
    rows = [frame(e, i, e * 10 + (0 if i == 0 else 1 + i % 2)) for e in seeds for i in range(40)] + [frame(e, 7, e * 10 + 5, at=9) for e in seeds for _ in range(6)]
    eps = spark.createDataFrame([(e, f"d{e}", 10.0) for e in seeds], "episode_index bigint, domain_name string, fps double")
    meta = spark.createDataFrame([(f"d{e}", k, None, None, e) for e in seeds], META)
    got = reservoir.draw(spark.createDataFrame(rows, FRAMES), eps, meta).groupBy("frame_index").count().collect()
    n = {r["frame_index"]: r["count"] for r in got}
    mean = 300 * k / 40
    chi = sum((n.get(i, 0) - mean) ** 2 / (mean * (1 - k / 40)) for i in range(40))
    assert sum(n.values()) == 300 * k and chi < 75  # 39 degrees of freedom, p about 0.0005


@pytest.mark.parametrize("proposals,k", [(1, 12), (200, 12), (4, 12)])
def test_both_stages_draw_alike(spark, monkeypatch, proposals, k):
    """Row groups of very different sizes; few proposals leave the domains to the second stage, many do not."""
    monkeypatch.setattr(reservoir, "PROPOSALS", proposals)
    monkeypatch.setattr(reservoir, "LEAST_PROPOSALS", 10)
    seeds = range(250)
    rows = [frame(e, i, 0) for e in seeds for i in range(30)] + [frame(e, 7, 5, at=9) for e in seeds for _ in range(4)]
    parts = spark.createDataFrame(rows, FRAMES).repartitionByRange(6, F.when(F.col("frame_index") < 20, 0).otherwise(F.col("frame_index")))
    eps = spark.createDataFrame([(e, f"d{e}", 10.0) for e in seeds], "episode_index bigint, domain_name string, fps double")
    meta = spark.createDataFrame([(f"d{e}", k, None, None, e) for e in seeds], META)
    got = reservoir.draw(parts, eps, meta).collect()
    n = Counter(r["frame_index"] for r in got)
    mean = 250 * k / 30
    chi = sum((n[i] - mean) ** 2 / (mean * (1 - k / 30)) for i in range(30))
    assert len(got) == 250 * k == len({(r["episode_index"], r["frame_index"]) for r in got}) and chi < 62  # 29 degrees of freedom, p about 0.0004
    assert all(r["draw_no"] is not None and r["num_samples_stats"] == k for r in got)
    tried = max(10, proposals * 250 * k)
    first = sum(r["draw_no"] < tried for r in got)
    assert first == len(got) if proposals == 200 else first < len(got)


def test_row_groups_are_those_of_the_files(spark, tmp_path):
    spark.createDataFrame([frame(1, i, 0) for i in range(1000)], FRAMES).repartition(3).write.parquet(f"{tmp_path}/a b%c.parquet")
    frames = spark.read.parquet(f"{tmp_path}/a b%c.parquet")
    got = reservoir.row_groups(frames).collect()
    assert sum(r["n"] for r in got) == 1000 and sorted(r["gno"] for r in got) == list(range(len(got)))
    eps = spark.createDataFrame([(1, "a", 10.0)], "episode_index bigint, domain_name string, fps double")
    assert len(reservoir.draw(frames, eps, spark.createDataFrame([("a", 50, None, None, 0)], META)).collect()) == 50


def test_records(spark, tables):
    full = reservoir.draw(*tables, spark.createDataFrame([("a", 20, None, None, 3)], META), records=True).collect()
    assert len(full) == 20 and all(r["record"]["rec"] == "r" for r in full)
