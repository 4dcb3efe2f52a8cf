"""Components against union-find, and splits that keep them whole."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from framemill.llm import components, splits

T = datetime(2025, 1, 1)
SCHEMA = "record_id bigint, episode_index bigint, ref_episode_index bigint, domain_name string, recording_id string, component string, unit int, v bigint"


def roots(vertices, edges):
    parent = {v: v for v in vertices}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in vertices}


@pytest.mark.parametrize("limit,hub", [(10, 50_000), (10, 5), (1_000_000, 20)])
def test_components(spark, monkeypatch, limit, hub):
    monkeypatch.setattr(components, "MERGE_EDGES", limit)
    monkeypatch.setattr(components, "HUB_LINKS", hub)
    rng = random.Random(limit)
    n = 300
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(160, n), rng.randrange(160, n)) for _ in range(90)]
    got = components.connected(
        spark.createDataFrame([(v,) for v in [*range(n), 5, None]], "v bigint"),
        spark.createDataFrame([*edges, (7, 7), (None, 3), edges[0]], "a bigint, b bigint"),
    )
    assert {r["v"]: r["component"] for r in got.collect()} == roots(range(n), edges)


def test_no_edges(spark):
    v, e = spark.createDataFrame([(3,)], "v bigint"), spark.createDataFrame([], "a bigint, b bigint")
    assert [tuple(r) for r in components.connected(v, e).collect()] == [(3, 3)]
    assert components.connected(v.limit(0), e).collect() == []


def test_names_and_numbers(spark):
    df = spark.createDataFrame([(" Fern_Yoke\t", "REC-0000012 "), ("fern-yoke", "rec_12"), ("FERN YOKE", "Rec 012"), (None, None), ("--", ""), ("a", "x1-2"), ("a", "x01-02"), ("a", "none")], "d string, r string")
    rows = [tuple(x) for x in df.select(splits.folded_name(F.col("d")), splits.folded_number(F.col("r"))).collect()]
    assert rows[:3] == [("fernyoke", "12")] * 3
    assert rows[3] == (None, None) and rows[4] == (None, None)
    assert rows[5][1] == rows[6][1] and rows[7][1] == "none"


def records(spark, rows):
    return spark.createDataFrame([(i, e, r, d, rec, "clash", 1, 2) for i, (e, r, d, rec) in enumerate(rows)], SCHEMA)


def test_ties(spark):
    rows = [(1, None, "dom", "rec-1"), (2, None, "DOM ", "REC 001"), (3, None, "other", "rec-1"), (4, 3, None, None), (5, None, None, "rec-1"), (6, None, "dom", None), (None, 7, "dom", "rec-1"), (8, 8, "dom", "rec-9")]
    got = {tuple(r) for r in splits.tied_pairs(splits.episode_components(records(spark, rows))).collect()}
    assert got == {(1, 2), (3, 4)}


def test_splits_are_whole(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(400), rng.randrange(400) if rng.random() < 0.1 else None, rng.choice("abc"), f"rec-{rng.randrange(300)}" if rng.random() < 0.3 else None) for _ in range(1500)]
    rows += [(999, None, "hot", None)] * 700 + [(None, None, None, None)] * 20
    df = records(spark, rows)
    got = splits.split(df.union(df.limit(50))).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        if r["component"] is not None:
            by.setdefault(r["component"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by.values())
    share = {s: sum(r["split"] == s for r in got) / len(got) for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.8) < 0.06 and share["validation"] > 0.05 and share["test"] > 0.05
    assert splits.split(df.limit(0)).collect() == []
