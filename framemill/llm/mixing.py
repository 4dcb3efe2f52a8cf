"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framemill.llm.tokens import TOKENIZER, with_token_counts
from framemill.operators.ordering import running_sum
from framemill.session import broadcast_if_small, stored

#: Largest remaining budget, in longest documents, that the dynamic programme fits.
WINDOW = 8


def folded_source(source: Column) -> Column:
    """A source's name without case, outer blanks and differing separators; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "_"), F.lit(""))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = 0) -> np.ndarray:
    """How many documents of each length to take so that their tokens come as near to ``budget`` as can be, from below.

    ``lengths`` are distinct and positive, ``counts`` the documents there are. The bulk takes the same share of every
    length, so that long and short documents keep their proportion; single documents of lengths in
    seeded order follow, until a bounded-knapsack dynamic programme over exact sums (a bit for every
    reachable sum) fills the rest.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.astype(np.int64).copy()
    if budget <= 0 or not len(lengths):
        return take
    longest = int(lengths.max())
    window = WINDOW * longest
    share = max(0.0, (budget - window) / total)
    take = np.floor(counts * share).astype(np.int64)
    left = budget - int((take * lengths).sum())
    order = np.random.default_rng(seed).permutation(len(lengths))
    while left > window:
        before = left
        for i in order:
            if left <= window:
                break
            if take[i] < counts[i] and lengths[i] <= left - window // 2:
                take[i] += 1
                left -= int(lengths[i])
        if left == before:
            break
    return take + _knapsack(lengths, counts - take, min(left, budget), order)


def _knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int, order: np.ndarray) -> np.ndarray:
    """Exact bounded subset sum: the counts whose sum is the greatest reachable one up to ``budget``."""
    via = np.full(budget + 1, -1, dtype=np.int64)
    mask = (1 << (budget + 1)) - 1
    reach = 1
    for i in order.tolist():
        length = int(lengths[i])
        if length > budget:
            continue
        fresh = reach
        for _ in range(min(int(counts[i]), budget // length)):
            fresh = (fresh << length) & mask & ~reach
            if not fresh:
                break
            bits = np.unpackbits(np.frombuffer(fresh.to_bytes((budget + 8) // 8, "little"), np.uint8), bitorder="little")
            via[np.flatnonzero(bits[: budget + 1])] = i
            reach |= fresh
        if reach >> budget & 1:
            break
    take = np.zeros(len(lengths), dtype=np.int64)
    at = reach.bit_length() - 1
    while at > 0:
        take[via[at]] += 1
        at -= int(lengths[via[at]])
    return take


def plan(available: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, int]:
    """Token budget of each source that has documents, a positive weight and at least one repeat.

    Weights are taken relative to the sources that can contribute. Without ``total`` the mixture is
    as large as it can be with every source at its weight and no document beyond its repeats; a
    larger given total is met as far as each source reaches.
    """
    usable = {s: (w, r) for s, (w, r) in targets.items() if w > 0 and r > 0 and available.get(s, 0) > 0}
    whole = sum(w for w, _ in usable.values())
    if not usable or whole <= 0:
        return {}
    most = min(available[s] * r / (w / whole) for s, (w, r) in usable.items())
    size = most if total is None else total
    return {s: min(int(round(size * w / whole)), available[s] * r) for s, (w, r) in usable.items()}


def target_rows(targets: DataFrame) -> DataFrame:
    """(source, target_weight, max_repeats) by folded source: weights of one source add up, null weights are 0, null repeats 1."""
    rows = targets.select(folded_source(F.col("source")).alias("source"), F.greatest(F.lit(0.0), F.coalesce(F.nanvl("target_weight", F.lit(0.0)), F.lit(0.0))).alias("w"), F.coalesce("max_repeats", F.lit(1)).alias("r"))
    return rows.where("source is not null").groupBy("source").agg(F.sum("w").alias("target_weight"), F.max("r").alias("max_repeats"))


def counted(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of each document once, stored; of several rows of an id the greatest count stays."""
    rows = with_token_counts(documents.select("doc_id", folded_source(F.col("source")).alias("source"), "text"), tokenizer)
    return stored(rows.where("doc_id is not null").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"), F.max_by("source", "n_tokens").alias("source")), "tokens")


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0, tokenizer: str = TOKENIZER, counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, uses): the documents of the mixture and how often each is used.

    A document is a doc_id; ids that are null take no part, nor do sources without a target or
    documents without a token. A source is used wholly as often as its budget allows; what remains of
    the budget is a subset sum over its documents, counted by exact token length, and the documents
    of a length are taken in seeded hash order. Only the counts by length of a source meet in a task
    (as many rows as it has different lengths); documents are ranked by a range-partitioned sort, so
    that no source or length is a group of one task. No document is used more than its source's
    max_repeats times. Empty tables give no rows.
    """
    docs = counts if counts is not None else counted(documents, tokenizer)
    goal = {r["source"]: (r["target_weight"], r["max_repeats"]) for r in target_rows(targets).collect()}
    inside = docs.where(F.col("source").isin(list(goal)) & (F.col("n_tokens") > 0))
    histogram = stored(inside.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")), "lengths")
    have = {r["source"]: int(r["t"]) for r in histogram.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("t")).collect()}
    budgets = plan(have, goal, total)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        source = pdf["source"].iloc[0]
        pdf = pdf.sort_values("n_tokens")
        budget = budgets.get(source, 0)
        rounds = budget // have[source]
        take = fit(pdf["n_tokens"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), budget - rounds * have[source], seed)
        return pd.DataFrame({"source": source, "n_tokens": pdf["n_tokens"], "rounds": rounds, "take": take})

    chosen = histogram.groupBy("source").applyInPandas(choose, "source string, n_tokens bigint, rounds bigint, take bigint")
    ranked = running_sum(inside.withColumn("one", F.lit(1)), "one", [F.col("source"), F.col("n_tokens"), F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")], "g", "mix")
    first = ranked.groupBy("source", "n_tokens").agg(F.min("g").alias("g0"))
    cut = stored(chosen.join(first, ["source", "n_tokens"]), "cuts")
    used = ranked.join(broadcast_if_small(cut, 96), ["source", "n_tokens"])
    uses = (F.col("rounds") + (F.col("g") - F.col("g0") < F.col("take")).cast("bigint")).cast("int")
    return used.select("doc_id", "source", "n_tokens", uses.alias("uses")).where("uses > 0")


def shares(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per source with a target or documents: documents and tokens there are, target weight, and documents, uses, tokens and share in the mixture."""
    counts = counted(documents, tokenizer)
    made = mix(documents, targets, total, seed, tokenizer, counts)
    got = made.groupBy("source").agg(F.count(F.lit(1)).alias("used_docs"), F.sum("uses").alias("uses"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"))
    there = counts.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    rows = there.join(target_rows(targets), "source", "full").join(got, "source", "left")
    whole = got.agg(F.sum("tokens").alias("whole"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.join(F.broadcast(whole), how="cross").select(
        "source", zero("n_docs"), zero("n_tokens"), "target_weight", "max_repeats", zero("used_docs"), zero("uses"), zero("most_uses"), zero("tokens"), F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("share")
    )
