"""Filling containers of fixed capacity: best fit, then swap-based local search."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framemill.session import broadcast_if_small, stored

#: Pieces packed together by one task; the number bounds its memory and time. Of each block of a stream the emptiest
#: container is packed again, with those of so many other blocks.
BLOCK_ITEMS, GATHERED = 4096, 64

CONTAINERS = (
    "stream_id int, block int, container int, sequence_length int, sample_ids array<bigint>, sample_lens array<int>, "
    "piece_nos array<int>, piece_counts array<int>, used int, unused int"
)


def sample_length(split_lens: Column, sample_len: Column) -> Column:
    """Sum of ``split_lens`` where that has entries (null entries count 0), else ``sample_len``; null where that is null or negative."""
    total = F.aggregate(split_lens, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    length = F.when(F.size(split_lens) > 0, total).otherwise(sample_len.cast("bigint"))
    return F.when(length >= 0, length)


def items(samples: DataFrame, budgets: DataFrame) -> DataFrame:
    """(sample_id, stream_id, length, sequence_length) of each sample once.

    Rows of one sample_id are one sample; where they differ the greatest length counts, in the
    lowest stream. Rows without an id are left out of the identity rule: equal ones are one
    sample. A stream without a positive budget has a null capacity; of several budgets of one
    stream the largest counts.
    """
    length = sample_length(F.col("split_lens"), F.col("sample_len"))
    rows = samples.select("sample_id", F.col("stream_id").cast("int").alias("stream_id"), length.alias("length"), F.when(F.col("sample_id").isNull(), F.struct("stream_id", "arrival_no", "split_lens", "sample_len")).alias("anon"))
    once = rows.groupBy("sample_id", "anon").agg(F.max("length").alias("length"), F.min("stream_id").alias("stream_id"))
    caps = budgets.where("sequence_length > 0").groupBy(F.col("stream_id").cast("int").alias("stream_id")).agg(F.max("sequence_length").cast("int").alias("sequence_length"))
    return once.select("sample_id", "stream_id", "length").join(broadcast_if_small(caps, 32), "stream_id", "left")


def pack(samples: DataFrame, budgets: DataFrame, block_items: int = BLOCK_ITEMS, seed: int = 0) -> DataFrame:
    """Containers (see CONTAINERS) that hold every packable sample of ``samples`` exactly once.

    A sample longer than its stream's capacity is split: full pieces take a container each, the
    rest is packed like a sample; no other sample is split. The samples of a stream are spread by
    hash over blocks of about ``block_items`` pieces, so that a stream of any size is packed by many
    tasks. In a block, best fit over decreasing lengths is followed by a local search: the emptiest
    container hands pieces over by moves, one-for-one and two-for-one exchanges that increase the
    squared fill, until it is empty or nothing helps. Samples of length 0 need no space and share
    a container of their block. The emptiest containers of a stream's blocks are packed once more together (``block`` is negative there). Samples without a known length or capacity are in no
    container (see ``unpacked``). Ties go to the lower id; an empty table gives no containers.
    """
    spread = _blocked(samples, budgets, block_items, seed)
    made = stored(spread.groupBy("stream_id", "block").applyInPandas(_pack_block, CONTAINERS), "packed")
    many = broadcast_if_small(made.groupBy("stream_id").agg(F.max("block").alias("most")).where("most > 0").select("stream_id"), 32)
    # the emptiest container of each block of a cut stream; equal ones are told apart by their number
    last = made.where("unused > 0").join(many, "stream_id", "left_semi").groupBy("stream_id", "block").agg(F.max_by("container", F.struct("unused", "container")).alias("container"))
    keys = ["stream_id", "block", "container"]
    last = stored(last, "emptiest")
    again = made.join(last, keys, "left_semi").withColumn("part", F.floor(F.col("block") / GATHERED).cast("int")).groupBy("stream_id", "part").applyInPandas(_pack_again, CONTAINERS)
    return made.join(last, keys, "left_anti").select(*[f.split()[0] for f in CONTAINERS.split(", ")]).unionByName(again)


def _pack_again(pdf: pd.DataFrame) -> pd.DataFrame:
    """The emptiest containers of several blocks packed anew; they are numbered on in a block of their own."""
    cap = int(pdf["sequence_length"].iloc[0])
    lists = [pdf[c].tolist() for c in ("sample_ids", "sample_lens", "piece_nos", "piece_counts")]
    pieces = [(None if i != i else i, int(n), int(no), int(of)) for row in zip(*lists) for i, n, no, of in zip(*row)]
    return _containers(int(pdf["stream_id"].iloc[0]), -1 - int(pdf["part"].iloc[0]), cap, [], pieces)


def gains(samples: DataFrame, budgets: DataFrame, block_items: int = BLOCK_ITEMS, seed: int = 0) -> DataFrame:
    """(stream_id, best_fit, searched, least): containers of a stream's blocks by best fit, after the search, and at the lower bound."""
    spread = _blocked(samples, budgets, block_items, seed)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cap, full, parts = _pieces(pdf)
        sizes = np.array([p[1] for p in parts], dtype=np.int64)
        counts = (len(best_fit(sizes, cap)), len(search(sizes, cap)), -(-int(sizes.sum()) // cap))
        return pd.DataFrame([(int(pdf["stream_id"].iloc[0]), *(len(full) + c for c in counts))], columns=["stream_id", "best_fit", "searched", "least"])

    each = spread.groupBy("stream_id", "block").applyInPandas(run, "stream_id int, best_fit bigint, searched bigint, least bigint")
    return each.groupBy("stream_id").agg(*[F.sum(c).alias(c) for c in ("best_fit", "searched", "least")])


def _blocked(samples: DataFrame, budgets: DataFrame, block_items: int, seed: int) -> DataFrame:
    """Packable samples with their number of pieces and their block."""
    known = items(samples, budgets).where("length is not null and sequence_length is not null")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("length") / F.col("sequence_length"))).cast("int")
    known = known.withColumn("pieces", pieces)
    blocks = known.groupBy("stream_id").agg(F.ceil(F.sum("pieces") / block_items).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("sample_id", "length", F.lit(seed)), F.col("blocks")).cast("int")
    return known.join(broadcast_if_small(blocks, 32), "stream_id").withColumn("block", block).drop("blocks")


def unpacked(samples: DataFrame, budgets: DataFrame) -> DataFrame:
    """(sample_id, stream_id, reason) of samples in no container: 'no length' or 'no capacity'."""
    reason = F.when(F.col("length").isNull(), "no length").when(F.col("sequence_length").isNull(), "no capacity")
    return items(samples, budgets).withColumn("reason", reason).where("reason is not null").select("sample_id", "stream_id", "reason")


def _pieces(pdf: pd.DataFrame) -> tuple[int, list[tuple], list[tuple]]:
    """(capacity, full pieces, others) of a block's samples; the others by decreasing size, ties by id."""
    pdf = pdf.sort_values(["length", "sample_id"], ascending=[False, True], na_position="first")
    cap = int(pdf["sequence_length"].iloc[0])
    parts, full = [], []
    for sid, length, n in zip(pdf["sample_id"].tolist(), pdf["length"].tolist(), pdf["pieces"].tolist()):
        length = int(length)
        for no in range(n):
            size = min(cap, length - no * cap)
            (full if size == cap else parts).append((sid, size, no, n))
    return cap, full, sorted(parts, key=lambda p: -p[1])


def _pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
    return _containers(int(pdf["stream_id"].iloc[0]), int(pdf["block"].iloc[0]), *_pieces(pdf))


def _containers(stream: int, block: int, cap: int, full: list[tuple], parts: list[tuple]) -> pd.DataFrame:
    parts = sorted(parts, key=lambda p: -p[1])
    bins = [[p] for p in full] + [[parts[i] for i in group] for group in search(np.array([p[1] for p in parts], dtype=np.int64), cap)]
    rows = []
    for i, group in enumerate(bins):
        used = sum(p[1] for p in group)
        rows.append((stream, block, i, cap, [p[0] for p in group], [p[1] for p in group], [p[2] for p in group], [p[3] for p in group], used, cap - used))
    return pd.DataFrame(rows, columns=[f.split()[0] for f in CONTAINERS.split(", ")])


def best_fit(sizes: np.ndarray, cap: int) -> list[list[int]]:
    """Best fit in the given order; ``sizes`` are at most ``cap``."""
    room: list[tuple[int, int]] = []  # (free space, bin), sorted
    bins: list[list[int]] = []
    for i, size in enumerate(sizes.tolist()):
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = cap, len(bins)
            bins.append([])
        bins[b].append(i)
        insort(room, (free - size, b))
    return bins


def exact_fit(sizes: np.ndarray, cap: int) -> list[list[int]]:
    """Containers filled one after another: the largest piece left, and those others whose sum comes nearest to what is left of the capacity.

    An exact bounded subset sum over the different sizes (a bit for every reachable sum), larger pieces first. ``sizes`` are at most ``cap``.
    """
    order = np.argsort(-sizes, kind="stable")
    kinds, first, n = np.unique(-sizes[order], return_index=True, return_counts=True)
    kinds, following, left = (-kinds).tolist(), first.tolist(), n.tolist()
    bins: list[list[int]] = []
    for largest in range(len(kinds)):
        while left[largest]:
            left[largest] -= 1
            taken, rest = [largest], cap - kinds[largest]
            mask, reach, trail = (1 << (rest + 1)) - 1, 1, []
            for k in range(largest, len(kinds)):
                if kinds[k] == 0:  # pieces of no length go along
                    taken += [k] * left[k]
                    left[k] = 0
                    continue
                if kinds[k] > rest or reach >> rest & 1:
                    continue
                for _ in range(min(left[k], rest // kinds[k])):
                    wider = (reach | reach << kinds[k]) & mask
                    if wider == reach:
                        break
                    trail.append((k, reach))
                    reach = wider
            at = reach.bit_length() - 1
            for k, before in reversed(trail):
                if not before >> at & 1:
                    taken.append(k)
                    left[k] -= 1
                    at -= kinds[k]
            group = []
            for k in taken:
                group.append(int(order[following[k]]))
                following[k] += 1
            bins.append(group)
    return bins


def search(sizes: np.ndarray, cap: int) -> list[list[int]]:
    """Containers after a local search from best fit, and where that stays above the lower bound from exactly filled ones too.

    Of both the fewer containers stay.
    """
    if not len(sizes):
        return []
    least = max(1, -(-int(sizes.sum()) // cap))
    found = improved(best_fit(sizes, cap), sizes, cap)
    if len(found) > least:
        other = improved(exact_fit(sizes, cap), sizes, cap)
        found = other if len(other) < len(found) else found
    return found


def improved(bins: list[list[int]], sizes: np.ndarray, cap: int) -> list[list[int]]:
    """``bins`` after a local search on the containers that are not full.

    In a round, every container with space left, from the emptiest on, hands pieces over to fuller ones, each time by the
    move, one-for-one or two-for-one exchange that raises the squared fill most. Rounds follow while anything
    changed (the sum of squares only grows), until the number of containers meets the lower bound.
    """
    home = np.empty(len(sizes), dtype=np.int64)
    for b, group in enumerate(bins):
        home[group] = b
    fill = np.bincount(home, weights=sizes, minlength=len(bins)).astype(np.int64)
    count = np.bincount(home, minlength=len(bins))
    least = max(1, -(-int(sizes.sum()) // cap))
    changed = True
    while (count > 0).sum() > least and changed:
        changed = False
        order = np.argsort(fill, kind="stable")
        for source in order[(fill[order] < cap) & (count[order] > 0)].tolist():
            while count[source] and fill[source] < cap and (change := best_change(source, sizes, home, fill, count, cap)) is not None:
                target, give, take = change
                step = int(sizes[give].sum() - sizes[take].sum())
                home[give], home[take] = target, source
                fill[source] -= step
                fill[target] += step
                count[source] += len(take) - len(give)
                count[target] += len(give) - len(take)
                changed = True
            if (count > 0).sum() <= least:
                break
    groups: list[list[int]] = [[] for _ in bins]
    for i, b in enumerate(home.tolist()):
        groups[b].append(i)
    return [g for g in groups if g]


def best_change(source: int, sizes: np.ndarray, home: np.ndarray, fill: np.ndarray, count: np.ndarray, cap: int):
    """(target, pieces given, pieces taken) that raises the sum of squared fills most, or None.

    ``source`` gives to containers that are at least as full as it and have room; what they gain, d,
    is positive and at most their room. The sum of squares then grows by 2 d (fill of target - fill
    of source + d), which grows with d: so for each container, or each piece that might be taken, the largest piece
    or sum of two pieces that still fits is best, and a binary search finds it. All containers, all pieces
    and all pairs are tried.
    """
    own = np.flatnonzero(home == source)
    own = own[np.argsort(sizes[own], kind="stable")]
    x = sizes[own]
    room = cap - fill
    able = (room > 0) & (fill >= fill[source]) & (count > 0)
    able[source] = False
    if not able.any() or not len(own):
        return None
    lead = fill - fill[source]
    best, found = 0, None

    def tried(sums: np.ndarray, at: np.ndarray, taken: np.ndarray):
        """The best of giving the largest of ``sums`` that container ``at`` can hold without its piece of size ``taken``."""
        k = np.searchsorted(sums, taken + room[at], "right") - 1
        d = np.where(k >= 0, sums[np.maximum(k, 0)] - taken, 0)
        gain = np.where(d > 0, 2 * d * (lead[at] + d), 0)
        i = int(gain.argmax())
        return int(gain[i]), i, int(k[i])

    pieces = np.flatnonzero(able[home])
    at = home[pieces]
    open_bins = np.flatnonzero(able)
    gain, i, k = tried(x, open_bins, np.zeros(len(open_bins), np.int64))
    if gain > best:
        best, found = gain, (int(open_bins[i]), own[[k]], own[:0])
    gain, i, k = tried(x, at, sizes[pieces])
    if gain > best:
        best, found = gain, (int(at[i]), own[[k]], pieces[[i]])
    if len(own) > 1:
        kinds, first, n = np.unique(x, return_index=True, return_counts=True)
        a, b = np.triu_indices(len(kinds))
        usable = (a != b) | (n[a] > 1)
        a, b = a[usable], b[usable]
        sums, some = np.unique(kinds[a] + kinds[b], return_index=True)
        gain, i, k = tried(sums, at, sizes[pieces])
        if gain > best:
            one, two = first[a[some[k]]], first[b[some[k]]]
            best, found = gain, (int(at[i]), own[[one, two + (one == two)]], pieces[[i]])
    return found
