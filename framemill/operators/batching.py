"""Grouping streams of samples into batches under a budget, with the order of the stream kept.

These packers are sequential by nature: a decision depends on all before it. They run per shard of
a stream; the caller chooses how long a shard is (see ``sharded``), which bounds every task.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sharded(order: Column, rows_per_shard: int) -> Column:
    """Shard of a row from its position in the stream; packers never look over its end."""
    return F.floor(order / rows_per_shard).cast("bigint")


def sequential(sizes: list[int], limit: int, lookahead: int = 10, max_samples: int | None = None) -> tuple[list[list[int]], list[int]]:
    """(batches, dropped) of indexes. A sample fits while the sum stays below ``limit`` (strictly).

    What does not fit a begun batch is passed over, up to ``lookahead`` times, and comes first in the
    next one, in its old order. A sample that does not fit alone is dropped.
    """
    stream: deque[int] = deque(range(len(sizes)))
    batches, dropped = [], []
    while stream:
        batch, passed, total = [], [], 0
        while stream and not (max_samples and len(batch) >= max_samples) and not (batch and len(passed) >= lookahead):
            i = stream.popleft()
            if total + sizes[i] < limit:
                batch.append(i)
                total += sizes[i]
            elif batch:
                passed.append(i)
            else:
                dropped.append(i)
        stream.extendleft(reversed(passed))
        if batch:
            batches.append(batch)
    return batches, dropped


def pooled(sizes: list[int], kinds: list, limit: int, pool: int = 16, long: int = 6400, max_batch: int | None = None, closest: bool = False) -> list[list[int]]:
    """Batches by padded cost: the longest length times the count.

    A pool of the next samples is kept full. The oldest begins a batch; the one that costs least joins
    while the cost stays within the limit (half of it once a length of 1000 is in), of the same kind
    only; ties go to the older, or with ``closest`` to the nearer length. Long samples go alone.
    """
    waiting: deque[int] = deque(range(len(sizes)))
    held: list[int] = []
    out = []

    def budget(longest: int) -> int:
        return limit if longest < 1000 else limit // 2

    while waiting or held:
        while waiting and len(held) < pool:
            held.append(waiting.popleft())
        first = held.pop(0)
        batch, longest = [first], sizes[first]
        if longest < long and longest < budget(longest):
            while held and not (max_batch and len(batch) >= max_batch):
                fits = [(max(longest, sizes[i]) * (len(batch) + 1), abs(sizes[i] - longest) if closest else 0, k) for k, i in enumerate(held) if kinds[i] == kinds[first]]
                fits = [f for f in fits if f[0] <= budget(longest)]
                if not fits:
                    break
                i = held.pop(min(fits)[2])
                batch.append(i)
                longest = max(longest, sizes[i])
        out.append(batch)
    return out


def greedy(sizes: list[int], limit: int) -> list[list[int]]:
    """Batches in order: a new one begins where the sum would exceed ``limit``; a larger sample goes alone, none is dropped."""
    out: list[list[int]] = []
    total = 0
    for i, s in enumerate(sizes):
        if not out or total + s > limit:
            out.append([])
            total = 0
        out[-1].append(i)
        total += s
    return out


BATCHES = "batch bigint, place int"


def packed(rows: DataFrame, keys: list[str], order: str, size: str, method: str, **options) -> DataFrame:
    """Rows with ``batch`` and ``place`` in it, per keys; method 'sequential', 'pooled' or 'greedy'. Rows dropped by 'sequential' have null in both.

    ``rows`` has keys, ``order`` (unique in the keys), ``size`` and for 'pooled' ``kind``.
    """
    columns = list(rows.columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        sizes = [int(v) for v in pdf[size]]
        if method == "sequential":
            batches, _ = sequential(sizes, **options)
        elif method == "pooled":
            batches = pooled(sizes, pdf["kind"].tolist(), **options)
        else:
            batches = greedy(sizes, **options)
        no, place = [None] * len(pdf), [None] * len(pdf)
        for b, batch in enumerate(batches):
            for p, i in enumerate(batch):
                no[i], place[i] = b, p
        return pdf[columns].assign(batch=pd.array(no, "Int64"), place=pd.array(place, "Int32"))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + BATCHES
    return rows.groupBy(*keys).applyInPandas(run, ddl)


def fixed(position: Column, size: int) -> Column:
    """Batch of a position for batches of a fixed size."""
    return F.floor(position / size).cast("bigint")


def offsets(rows: DataFrame, keys: list[str], order: str, length: str) -> DataFrame:
    """Start and end of each span in its pack: running sums within packs, which are bounded by their capacity."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("stop", F.sum(length).over(w)).withColumn("start", F.col("stop") - F.col(length))


def rounded_up(n: Column, multiple: int, world: int = 1) -> Column:
    """The least multiple of ``multiple`` times ``world`` that is not below n."""
    m = multiple * world
    return (F.ceil(n / m) * m).cast("bigint")
