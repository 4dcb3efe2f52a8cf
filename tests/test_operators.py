"""Operators against brute force on small inputs: nulls, ties, gaps, empty tables, hot groups."""

import difflib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from framemill.operators import batching, curation, editing, episodic, lookups, sampling, segments, statistics
from framemill.operators.ordering import running_sum


def test_running_sum(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), rng.choice([None, 1, 5]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v int, i int")
    got = running_sum(df, "v", [F.col("k"), F.col("i")], "before", partitions=7).collect()
    want, total = {}, 0
    for k, v, i in sorted(rows, key=lambda r: (r[0], r[2])):
        want[i] = total
        total += v or 0
    assert {r["i"]: r["before"] for r in got} == want
    assert running_sum(df.limit(0), "v", [F.col("k")], "before").collect() == []


def test_numbered_hot_and_null_keys(spark):
    rows = [(1 if i % 3 else (None if i % 2 else 2), i * 7 % 101, i) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, o int, i int")
    got = {r["i"]: r["n"] for r in episodic.numbered(df, ["k"], [F.col("o"), F.col("i")], "n").collect()}
    for key in (1, 2, None):
        mine = sorted((o, i) for k, o, i in rows if k == key)
        assert [got[i] for _, i in mine] == list(range(len(mine)))


def _series(spark, eps):
    return spark.createDataFrame([(e, i, float(v)) for e, vals in eps.items() for i, v in vals.items()], "ep bigint, i bigint, v double")


def test_delta_window_with_gaps_and_blocks(spark):
    rng = random.Random(2)
    eps = {e: {i: rng.random() for i in range(3, 60) if rng.random() > 0.1} for e in range(5)}
    got = episodic.delta_window(_series(spark, eps), ["ep"], "i", "v", {"a": -7, "b": 4}, block=8).collect()
    assert len(got) == sum(map(len, eps.values()))
    for r in got:
        vals = eps[r["ep"]]
        lo, hi = min(vals), max(vals)
        for name, k in (("a", -7), ("b", 4)):
            t = r["i"] + k
            assert r[name] == vals.get(min(max(t, lo), hi))
            assert r[f"{name}_is_pad"] == (t < lo or t > hi)


def test_bounded_fill(spark):
    eps = {1: {0: 10, 1: 11, 3: 13, 4: 14}}
    got = {r["i"]: r for r in episodic.bounded_fill(_series(spark, eps), ["ep"], "i", "v", 2, 2, block=2).collect()}
    assert (got[4]["m1"], got[4]["m1_is_pad"], got[4]["m2"], got[4]["m2_is_pad"]) == (13, False, 13, True)
    assert (got[1]["p1"], got[1]["p1_is_pad"], got[1]["p2"], got[1]["p2_is_pad"]) == (11, True, 11, True)


@pytest.mark.parametrize("block", [4, 1000])
def test_islands_reach_over_blocks(spark, block):
    rng = random.Random(3)
    flags = {e: [rng.random() < 0.8 for _ in range(70)] for e in range(4)}
    df = spark.createDataFrame([(e, i, f) for e, fs in flags.items() for i, f in enumerate(fs)], "ep int, i bigint, f boolean")
    got = {(r["ep"], r["first"], r["length"]) for r in episodic.running_islands(df, ["ep"], "i", "f", 3, block).collect()}
    want = set()
    for e, fs in flags.items():
        for m in re.finditer("1{3,}", "".join("1" if f else "0" for f in fs)):
            want.add((e, m.start(), m.end() - m.start()))
    assert got == want


def test_segment_plan_cases(spark):
    def plan(n, most, over, block, tail=False):
        df = spark.createDataFrame([(n,)], "n bigint")
        return sorted((r["start"], r["steps"]) for r in segments.segment_plan(df, "n", most, over, block, tail).collect())

    assert plan(61, 20, 0, 4) == [(0, 20), (20, 20), (40, 20)]
    assert plan(60, 20, 0, 4) == [(0, 20), (20, 20), (39, 20)]
    assert plan(4, 20, 5, 4) == []
    assert plan(12, 20, 5, 4) == [(0, 8)]
    assert plan(12, 20, 5, 4, tail=True) == [(0, 8), (3, 8)]
    assert plan(30, 20, 5, 4) == [(0, 20), (9, 20)]


def test_balanced_windows_cover(spark):
    df = spark.createDataFrame([(0, z, 10.0) for z in (0, 19, 20, 21, 47, 200)], "a bigint, z bigint, fps double")
    rows = segments.balanced_windows(df, "a", "z", "fps", 2.0, 0.5).collect()
    for z in (0, 19, 20, 21, 47, 200):
        w = sorted((r["win_start"], r["win_end"]) for r in rows if r["z"] == z)
        assert w[0][0] == 0 and w[-1][1] == z
        sizes = [b - a + 1 for a, b in w]
        assert max(sizes) <= 20 and max(sizes) - min(sizes) <= 1
        assert all(b1 - a2 + 1 == 5 for (_, b1), (a2, _) in zip(w, w[1:]))


@pytest.mark.parametrize("strict", [True, False])
def test_asof_nearest(spark, strict):
    rng = random.Random(4)
    left = [(i, rng.randrange(3), rng.randrange(0, 300)) for i in range(80)] + [(99, 7, 5), (98, None, 5)]
    right = [(rng.randrange(3), rng.randrange(-20, 320), j) for j in range(60)]
    ldf = spark.createDataFrame(left, "id int, k int, t bigint")
    rdf = spark.createDataFrame([*right, (1, None, 500)], "k int, rt bigint, j int")
    got = {r["id"]: (r["gap"], r["rt_near"]) for r in lookups.asof_nearest(ldf, rdf, ["k"], "t", "rt", 10, ["j"], ["id"], strict).collect()}
    for i, k, t in left:
        near = [(abs(rt - t), rt) for rk, rt, _ in right if rk == k and (abs(rt - t) < 10 if strict else abs(rt - t) <= 10)]
        assert got[i] == (min(near) if near else (None, None))


def test_asof_backward(spark):
    left = spark.createDataFrame([(1, 1, 100), (2, 1, 5), (3, 2, 50)], "id int, k int, t bigint")
    right = spark.createDataFrame([(1, 90, "a"), (1, 95, "b"), (1, 101, "c"), (2, 1, "d")], "k int, rt bigint, p string")
    got = {r["id"]: r["p_asof"] for r in lookups.asof_backward(left, right, ["k"], "t", "rt", 20, ["p"], ["id"]).collect()}
    assert got == {1: "b", 2: None, 3: None}


def test_range_lookup(spark):
    ranges = spark.createDataFrame([(0, 10, "a"), (10, 500, "b"), (700, 700, "empty")], "lo bigint, hi bigint, n string")
    points = spark.createDataFrame([(p,) for p in (0, 9, 10, 499, 500, 700)], "p bigint")
    got = {r["p"]: r["n"] for r in lookups.range_lookup(points, ranges, "p", "lo", "hi", 16).collect()}
    assert got == {0: "a", 9: "a", 10: "b", 499: "b"}


def test_first_found_and_remap(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, n string")
    files = spark.createDataFrame([("y.a",), ("y.b",), ("x.b",), ("x.b",)], "path string")
    got = {r["id"]: r["hit"] for r in lookups.first_found(rows, files, [F.concat("n", F.lit(".a")), F.concat("n", F.lit(".b"))], "hit", "id").collect()}
    assert got == {1: "x.b", 2: "y.a", 3: None}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    data = {g: np.round(rng.normal(size=n), 2).tolist() for g, n in (("a", 1), ("b", 2), ("c", 501))}
    df = spark.createDataFrame([(g, x) for g, xs in data.items() for x in xs] + [("c", None)], "g string, x double").repartition(5)
    got = {r["g"]: r for r in statistics.exact_quantiles(df, ["g"], "x", {"q1": 0.25, "q9": 0.9}).collect()}
    for g, xs in data.items():
        assert got[g]["q1"] == pytest.approx(np.quantile(xs, 0.25)) and got[g]["q9"] == pytest.approx(np.quantile(xs, 0.9))


def test_histogram_quantiles_are_within_a_bin(spark):
    xs = np.random.default_rng(6).normal(size=2000)
    df = spark.createDataFrame([(0, float(x)) for x in xs], "g int, x double")
    got = statistics.histogram_quantiles(df, ["g"], "x", {"q": 0.9}).first()["q"]
    assert abs(got - np.quantile(xs, 0.9)) < 2 * (xs.max() - xs.min()) / statistics.BINS + 0.01


def test_merged_moments(spark):
    xs = np.random.default_rng(7).normal(size=(10, 30))
    parts = spark.createDataFrame([(0, 30, float(x.min()), float(x.max()), float(x.mean()), float(x.std())) for x in xs], "g int, n bigint, mn double, mx double, mean double, std double")
    r = statistics.merged_moments(parts, ["g"]).first()
    assert (r["n"], r["mean"], r["std"], r["mn"]) == (300, pytest.approx(xs.mean()), pytest.approx(xs.std()), xs.min())


def test_ssim_and_boxes():
    a = np.random.default_rng(8).random((16, 20))
    assert statistics.ssim(a, a) == pytest.approx(1) and statistics.ssim(a, 1 - a) < 0.2
    boxes = [(0, 0, 9, 9, 0.9), (1, 1, 9, 9, 0.8), (50, 50, 60, 60, 0.7), (0, 0, 1, 1, 0.01)]
    assert curation.kept_boxes(boxes, 0.1, 0.4, 10, 10) == [0, 2]
    # 10 ** 0.75 is 5.6
    assert list(statistics.evenly_spaced(10, 4, 6)) == [0, 2, 4, 7, 9]
    assert list(statistics.evenly_spaced(3)) == [0, 1, 2] and len(statistics.evenly_spaced(0)) == 0


def test_sequential_packing_keeps_the_order_of_what_waits():
    batches, dropped = batching.sequential([5, 9, 4, 10, 1], 10, 10)
    # 5 and 4 fit under 10; 9, 10 and 1 wait; 10 fits nowhere
    assert batches == [[0, 2], [1], [4]]
    assert dropped == [3]
    rng = random.Random(9)
    sizes = [rng.randrange(1, 40) for _ in range(300)]
    batches, dropped = batching.sequential(sizes, 50, 3)
    assert sorted(i for b in batches for i in b) == list(range(300)) and not dropped
    assert all(sum(sizes[i] for i in b) < 50 and b == sorted(b) for b in batches)
    assert batching.sequential([50], 50) == ([], [0])


def test_pool_packing():
    rng = random.Random(10)
    sizes = [rng.randrange(1, 3000) for _ in range(200)] + [7000]
    kinds = [rng.choice("ab") for _ in sizes]
    batches = batching.pooled(sizes, kinds, 8000)
    assert sorted(i for b in batches for i in b) == list(range(201))
    for b in batches:
        assert len({kinds[i] for i in b}) == 1
        longest = max(sizes[i] for i in b)
        assert len(b) == 1 or longest * len(b) <= 8000
    assert [200] in batches


def test_greedy_packing_drops_nothing():
    assert batching.greedy([3, 4, 20, 1], 7) == [[0, 1], [2], [3]]
    assert batching.greedy([], 7) == []


def test_rank_allocation(spark):
    assert sampling.allocate_ranks({"a": 1, "b": 1, "c": 0}, 3) in ({"a": 2, "b": 1}, {"a": 1, "b": 2})
    assert sampling.allocate_ranks({"a": 98, "b": 1, "c": 1}, 4) == {"a": 2, "b": 1, "c": 1}
    with pytest.raises(ValueError):
        sampling.allocate_ranks({"a": 1, "b": 1}, 1)
    got = sampling.allocation_table(spark.createDataFrame([("a", 3.0), ("b", 1.0)], "n string, r double"), "n", "r", 8).collect()
    assert {r["n"]: (r["ranks"], r["first_rank"]) for r in got} == {"a": (6, 0), "b": (2, 6)}


def test_fuzzy_match_against_brute_force(spark):
    rng = random.Random(11)
    words = ["alpha beta", "gammadelta"]
    texts = []
    for i in range(60):
        t = list(rng.choice(["one alpha beta two", "gammadelta", "alpha  BETA", "nothing here", ""]))
        if t and rng.random() < 0.5:
            t[rng.randrange(len(t))] = rng.choice("abcx ")
        texts.append((i, "".join(t)))
    got = {(r["id"], r["word"]) for r in curation.fuzzy_match(spark.createDataFrame([*texts, (99, None)], "id bigint, t string"), "id", "t", words).collect()}
    want = set()
    for i, t in texts:
        tokens = t.lower().split()
        for w in words:
            n = len(w.split())
            for k in range(len(tokens) - n + 1):
                if difflib.SequenceMatcher(None, " ".join(tokens[k : k + n]), w, autojunk=False).ratio() >= (len(w) - 1) / len(w):
                    want.add((i, w))
    assert got == want


def test_reasons_and_violations(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 50)], "id int, v int")
    r = curation.first_reason([("missing", F.col("v").isNull()), ("large", F.col("v") > 10)])
    assert {x["id"]: x["r"] for x in df.select("id", r.alias("r")).collect()} == {1: "missing", 2: None, 3: "large"}
    broken = curation.violations(df, {"small": F.col("v") < 10}, ["id"]).collect()
    assert sorted(x["id"] for x in broken) == [1, 3]


def test_smallest_of_hot_groups(spark):
    df = spark.createDataFrame([("a", i) for i in range(2000)] + [("b", 1), (None, 2)], "g string, i int")
    got = sampling.smallest(df, ["g"], sampling.sha_key(F.col("i")), 10, slices=8).collect()
    import hashlib

    want = sorted(range(2000), key=lambda i: hashlib.sha256(f"{i}/0".encode()).hexdigest())[:10]
    assert sorted(r["i"] for r in got if r["g"] == "a") == sorted(want) and len(got) == 12


def test_mass_weights_without_one_side(spark):
    df = spark.createDataFrame([(False, True), (False, True), (False, False)], "o boolean, k boolean")
    assert sorted(r["weight"] for r in sampling.mass_weights(df, "o", "k", 0.3).collect()) == [0.0, 0.5, 0.5]


def test_editing(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "task_index bigint, task string")
    b = spark.createDataFrame([(0, "y"), (1, "z")], "task_index bigint, task string")
    got = {r["task"]: r["task_index"] for r in editing.task_union([a, b], "task", "task_index").collect()}
    assert got == {"x": 0, "y": 1, "z": 2}
    fresh = editing.new_tasks(a, spark.createDataFrame([("q",), ("x",), (None,), ("b",)], "task string"), "task", "task_index")
    assert {r["task"]: r["task_index"] for r in fresh.collect()} == {"b": 2, "q": 3}
    assert editing.union_common([a.withColumn("only", F.lit(1)), b]).columns == ["task_index", "task", "dataset_index"]
