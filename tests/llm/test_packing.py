"""Containers: everything once, nothing over capacity, few of them."""

import random
from datetime import datetime

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from framemill.llm import packing

SCHEMA = "sample_id bigint, stream_id int, arrival_no bigint, split_lens array<int>, sample_len int, arrived_at timestamp, block string, pieces int, length double"
T = datetime(2025, 1, 1)


def row(sid, stream, lens, n, no=0):
    return (sid, stream, no, lens, n, T, "clash", 3, 1.5)


def run(spark, rows, caps=((1, 10), (2, 100))):
    samples = spark.createDataFrame(rows, SCHEMA)
    budgets = spark.createDataFrame(list(caps), "stream_id int, sequence_length int")
    return packing.pack(samples, budgets, block_items=64).collect(), packing.unpacked(samples, budgets).collect()


def test_lengths_and_pieces(spark):
    rows = [
        row(1, 1, [3, 4], 99), row(1, 1, [3, 4], 99), row(2, 1, None, 25), row(3, 1, [], 10), row(4, 1, [0], 8), row(5, 1, None, None),
        row(6, 1, None, -1), row(7, 3, [4], 4), row(8, None, [4], 4), row(9, 1, [None, 2], 5), row(10, 1, [20], 1), row(None, 1, [3], 3), row(None, 1, [3], 3), row(None, 1, [2], 2),
    ]
    made, rest = run(spark, rows)
    held = sorted((i is None, i or 0, n, k, of) for r in made for i, n, k, of in zip(r["sample_ids"], r["sample_lens"], r["piece_nos"], r["piece_counts"]))
    assert held == sorted([(False, 1, 7, 0, 1), (False, 2, 10, 0, 3), (False, 2, 10, 1, 3), (False, 2, 5, 2, 3), (False, 3, 10, 0, 1), (False, 4, 0, 0, 1), (False, 9, 2, 0, 1), (False, 10, 10, 0, 2), (False, 10, 10, 1, 2), (True, 0, 3, 0, 1), (True, 0, 2, 0, 1)])
    assert all(r["used"] + r["unused"] == r["sequence_length"] and r["used"] == sum(r["sample_lens"]) for r in made)
    assert sorted((r["sample_id"], r["reason"]) for r in rest) == [(5, "no length"), (6, "no length"), (7, "no capacity"), (8, "no capacity")]


def test_no_samples(spark):
    assert run(spark, []) == ([], [])


def test_a_hot_stream_is_cut_into_blocks(spark):
    rng = random.Random(1)
    rows = [row(i, 2, None, rng.randrange(1, 60)) for i in range(700)] + [row(i, 1, None, 4) for i in range(700, 710)]
    made, _ = run(spark, rows)
    assert len({r["block"] for r in made if r["stream_id"] == 2}) > 8
    ids = [i for r in made for i in r["sample_ids"]]
    assert sorted(ids) == list(range(710))
    total = sum(r[4] for r in rows if r[1] == 2)
    n = sum(r["stream_id"] == 2 for r in made)
    assert n <= total / 100 + len({r["block"] for r in made}) + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(50, 90))
def test_search_never_loses_to_best_fit(sizes, cap):
    sizes = np.array(sorted(sizes, reverse=True), dtype=np.int64)
    first, best = packing.best_fit(sizes, cap), packing.search(sizes, cap)
    assert sorted(i for b in best for i in b) == list(range(len(sizes)))
    assert all(sizes[b].sum() <= cap for b in best)
    assert len(best) <= len(first)


def test_search_finds_an_exchange():
    # best fit leaves 4 4 | 3 3 3 | 3; exchanging a 4 for a 3 empties the last one
    sizes = np.array([4, 4, 3, 3, 3, 3], dtype=np.int64)
    assert len(packing.best_fit(sizes, 10)) == 3 and len(packing.search(sizes, 10)) == 2


def change(own, other, cap):
    """The best change between one container and another that is fuller."""
    sizes = np.array([*own, *other], dtype=np.int64)
    home = np.array([0] * len(own) + [1] * len(other))
    fill = np.array([sum(own), sum(other)], dtype=np.int64)
    got = packing.best_change(0, sizes, home, fill, np.array([len(own), len(other)]), cap)
    return got and (sizes[got[1]].tolist(), sizes[got[2]].tolist())


def test_kinds_of_change():
    assert change([5, 3], [4, 4], 9) == ([5], [4])
    assert sorted(change([3, 3], [5, 4], 10)[0]) == [3, 3]
    assert change([3, 1], [9], 10) == ([1], [])
    assert change([3, 3], [9], 10) is None
    assert change([3], [2], 10) is None


def test_exact_filling_of_planted_containers():
    """Containers cut into pieces can all be filled again; best fit needs one more."""
    rng = random.Random(5)
    sizes = []
    for _ in range(120):
        cuts = sorted(rng.sample(range(1, 1000), 3))
        sizes += [b - a for a, b in zip([0, *cuts], [*cuts, 1000])]
    sizes = np.array(sorted(sizes, reverse=True), dtype=np.int64)
    assert len(packing.best_fit(sizes, 1000)) == 121 and len(packing.search(sizes, 1000)) == 120


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(50, 90))
def test_exact_filling_holds_everything_once(sizes, cap):
    sizes = np.array(sizes, dtype=np.int64)
    bins = packing.exact_fit(sizes, cap)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sizes[b].sum() <= cap for b in bins)


def test_all_pairs_of_many_small_pieces_are_tried():
    """Of 2,000 pieces only one pair, far apart in size, exchanges for the 500 with a gain."""
    own = [3] * 1998 + [100, 401]
    sizes = np.array([*own, 500, 99_499], dtype=np.int64)
    home = np.array([0] * 2000 + [1, 1])
    fill = np.array([sum(own), 99_999], dtype=np.int64)
    give, take = packing.best_change(0, sizes, home, fill, np.array([2000, 2]), 100_000)[1:]
    assert sorted(sizes[give].tolist()) == [100, 401] and sizes[take].tolist() == [500]


def test_many_hopeless_containers_before_a_useful_one():
    """A hundred emptier containers can give nothing; the next one can, and the search goes on to it."""
    bins = [[60] for _ in range(100)] + [[41, 30], [90]]
    sizes = np.array([s for b in bins for s in b], dtype=np.int64)
    at = np.cumsum([0] + [len(b) for b in bins])
    start = [list(range(a, b)) for a, b in zip(at, at[1:])]
    made = [sorted(sizes[b].tolist()) for b in packing.improved(start, sizes, 100)]
    assert [90] not in made or [30, 60] in made


def test_emptiest_containers_of_blocks_are_packed_together(spark):
    rng = random.Random(2)
    rows = [row(i, 2, None, rng.randrange(1, 60)) for i in range(1500)]
    made, _ = run(spark, rows)
    total = sum(r[4] for r in rows)
    assert sorted(i for r in made for i in r["sample_ids"]) == list(range(1500))
    assert len({(r["stream_id"], r["block"], r["container"]) for r in made}) == len(made) <= -(-total // 100) + 2
