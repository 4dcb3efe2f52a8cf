"""Budgets, subset sums and mixtures."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framemill.llm import mixing
from framemill.llm.tokens import counter


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=4), st.integers(0, 60))
def test_fit_is_the_best_sum(pool, budget):
    lengths, counts = np.array(list(pool)), np.array(list(pool.values()))
    take = mixing.fit(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    best = max(s for s in (sum(k * n for k, n in zip(ks, lengths)) for ks in itertools.product(*[range(c + 1) for c in counts])) if s <= budget)
    assert int((take * lengths).sum()) == best


def test_fit_of_many(monkeypatch):
    rng = np.random.default_rng(1)
    lengths, counts = np.unique(rng.integers(20, 900, 600)), None
    counts = rng.integers(1, 40, len(lengths))
    total = int((lengths * counts).sum())
    for budget in (total // 3, total // 2 + 7, total - 5, total + 9):
        take = mixing.fit(lengths, counts, budget)
        got = int((take * lengths).sum())
        assert got == min(budget, total) or (budget > total - 20 and got <= budget)
        assert (take <= counts).all()
    half = mixing.fit(lengths, counts, total // 2)
    assert abs((half * lengths).sum() / half.sum() - (counts * lengths).sum() / counts.sum()) < 5  # no bias by length


def test_plan():
    got = mixing.plan({"a": 100, "b": 10, "d": 50}, {"a": (0.5, 1), "b": (0.25, 2), "c": (0.25, 9), "e": (0.0, 1)})
    assert got == {"a": 40, "b": 20}
    assert mixing.plan({"a": 100, "b": 10}, {"a": (1.0, 1), "b": (1.0, 1)}, total=60) == {"a": 30, "b": 10}
    assert mixing.plan({}, {"a": (1.0, 1)}) == {} and mixing.plan({"a": 5}, {}) == {}


DOCS = "doc_id bigint, text string, lang string, source string, n_tokens int, uses string, g int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "clash", 2) for i, (t, s) in enumerate(rows)], DOCS)


def test_a_mixture(spark):
    rows = [(" word" * (1 + i % 9), "Big_Source" if i % 2 else "big-source ") for i in range(300)] + [(" word" * 5, "small") for _ in range(10)] + [(" word", None), ("", "small"), (None, "small"), (" word", "untargeted")]
    df = docs(spark, rows)
    targets = spark.createDataFrame([("big_source", 0.5, 1), ("SMALL", 0.5, 3), ("absent", 0.5, 1), ("no_weight", None, 2)], "source string, target_weight double, max_repeats int")
    made = mixing.mix(df.union(df.limit(3)), targets).collect()
    assert len({r["doc_id"] for r in made}) == len(made)
    tokens = {s: sum(r["n_tokens"] * r["uses"] for r in made if r["source"] == s) for s in ("big_source", "small")}
    assert tokens == {"big_source": 150, "small": 150}
    assert max(r["uses"] for r in made if r["source"] == "small") == 3 and max(r["uses"] for r in made if r["source"] == "big_source") == 1
    report = {r["source"]: r for r in mixing.shares(df, targets).collect()}
    assert report["small"]["share"] == pytest.approx(0.5) and report["absent"]["n_docs"] == 0 and report["untargeted"]["share"] == 0
    assert report[None]["n_docs"] == 1


def test_empty_tables(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_weight double, max_repeats int")
    assert mixing.mix(docs(spark, []), targets).collect() == []
    assert mixing.mix(docs(spark, [("x", "a")]), targets.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"])
def test_tokenizers(name):
    count = counter(f"/opt/tokenizers/{name}")
    got = count(["a small robot", "", "<|endoftext|>", "x" * 100_000])
    assert got[0] in (3, 4, 5) and got[1] == 0 and got[2] > 1 and got[3] > 1000


def test_the_two_byte_vocabularies_agree():
    texts = ["Some text, 12.5 m\n\n", "在厨房里", "naïve café — “x”"]
    assert counter("/opt/tokenizers/byte_bpe_50k.tiktoken")(texts) == counter("/opt/tokenizers/byte_bpe_50k.json")(texts)
