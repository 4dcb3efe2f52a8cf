"""Named chains of transforms: the surface for user-defined steps.

A step is a function of a DataFrame (built-in expressions), of a row dict (``row_step``: returning
None drops the row) or of an iterator of row dicts (``stream_step``); the last two run over Arrow
batches. A pipeline is a name for a list of steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]
_PIPELINES: dict[str, Callable[..., list[Step]]] = {}


def pipeline(name: str) -> Callable:
    """Register a function that builds the steps of a pipeline; names are unique."""

    def add(build: Callable[..., list[Step]]) -> Callable[..., list[Step]]:
        if name in _PIPELINES:
            raise ValueError(f"pipeline {name!r} exists")
        _PIPELINES[name] = build
        return build

    return add


def names() -> list[str]:
    return sorted(_PIPELINES)


def apply(df: DataFrame, name: str, **options) -> DataFrame:
    """Run a registered pipeline; what it does stays lazy."""
    if name not in _PIPELINES:
        raise KeyError(f"no pipeline {name!r}; there are {names()}")
    for step in _PIPELINES[name](**options):
        df = df.transform(step)
    return df


def row_step(fn: Callable[[dict], dict | None], schema: str) -> Step:
    """A step from a function of one row; rows for which it returns None are dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [r for r in (fn(row) for row in pdf.to_dict("records")) if r is not None]
            if out:
                yield pd.DataFrame.from_records(out)

    return lambda df: df.mapInPandas(run, schema)


def stream_step(fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str, batch: int = 1000) -> Step:
    """A step from a generator over the rows of a partition: it may drop, split or join rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for row in fn(r for pdf in batches for r in pdf.to_dict("records")):
            held.append(row)
            if len(held) >= batch:
                yield pd.DataFrame.from_records(held)
                held = []
        if held:
            yield pd.DataFrame.from_records(held)

    return lambda df: df.mapInPandas(run, schema)


def watched(df: DataFrame, name: str) -> DataFrame:
    """Counts rows and nulls as they pass, without another job; read them from the query's observations."""
    nulls = [F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"null_{c}") for c in df.columns]
    return df.observe(name, F.count(F.lit(1)).alias("n_rows"), *nulls)


_PROCESSORS: dict[str, Callable[[dict], dict | None]] = {}


def processor(name: str) -> Callable:
    """Register a function that makes a sample of a raw item, or None to drop it; names are unique."""

    def add(fn: Callable[[dict], dict | None]) -> Callable[[dict], dict | None]:
        if name in _PROCESSORS:
            raise ValueError(f"processor {name!r} exists")
        _PROCESSORS[name] = fn
        return fn

    return add


def processed(df: DataFrame, name: str, schema: str) -> DataFrame:
    """Samples that a registered processor makes of the rows."""
    if name not in _PROCESSORS:
        raise KeyError(f"no processor {name!r}; there are {sorted(_PROCESSORS)}")
    return row_step(_PROCESSORS[name], schema)(df)


def collated(rows: DataFrame, batch: list[str], order: str, fields: list[str]) -> DataFrame:
    """A row for each batch with an array for each field, in the order of ``order``. Batches are as small as the batcher made them."""
    sorted_rows = F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order])))
    return rows.groupBy(*batch).agg(sorted_rows.alias("_b")).select(*batch, *[F.col(f"_b.{f}").alias(f) for f in fields])


def distributed(rows: DataFrame, worker: Column, workers: int) -> DataFrame:
    """Rows laid out so that each worker's share is a partition of its own, by a strategy that names the worker of a row."""
    return rows.withColumn("worker", F.pmod(worker, F.lit(workers)).cast("int")).repartitionById(workers, "worker")


class Accumulator:
    """What a user-defined aggregate has to say; states are merged in any order."""

    #: Type of the state and of the result, as Spark writes it.
    state, result = "binary", "double"

    def update(self, values: pd.Series) -> object:
        """The state of some values."""
        raise NotImplementedError

    def merge(self, states: list) -> object:
        """One state of several."""
        raise NotImplementedError

    def finalize(self, state: object) -> object:
        """The result."""
        raise NotImplementedError


def accumulated(rows: DataFrame, key: str, value: str, how: Accumulator) -> DataFrame:
    """(key, result) of an accumulator: a state for each key and batch where the rows are, merged after one exchange of states."""
    kind = dict(rows.dtypes)[key]

    def update(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [(k, how.update(part[value])) for k, part in pdf.groupby(key, dropna=False)]
            yield pd.DataFrame(parts, columns=[key, "state"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: pdf[key].iloc[:1], "result": [how.finalize(how.merge(pdf["state"].tolist()))]})

    states = rows.select(key, value).mapInPandas(update, f"`{key}` {kind}, state {how.state}")
    return states.groupBy(key).applyInPandas(merge, f"`{key}` {kind}, result {how.result}")


def buffered_shuffle(rows: DataFrame, shard: Column, shards: int, order: Column, size: int, seed: int) -> DataFrame:
    """Rows with ``worker`` and ``place``: each worker's rows, read in order, through a buffer of ``size`` rows.

    A row that comes in pushes out a random one of the full buffer; what is left at the end is shuffled. So a row comes out at most
    ``size`` places before its turn. Each worker holds its buffer and nothing more; the same seed gives the same order.
    """
    laid = distributed(rows, shard, shards).sortWithinPartitions("worker", order)
    kinds = ", ".join(f"`{n}` {t}" for n, t in laid.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        draw = place = worker = columns = None

        def out(found: list[tuple]) -> pd.DataFrame:
            nonlocal place
            place += len(found)
            return pd.DataFrame(found, columns=columns).assign(place=range(place - len(found), place))

        def rest() -> list[tuple]:
            return [held[i] for i in draw.permutation(len(held))]

        for pdf in batches:
            columns = list(pdf.columns)
            for number, part in pdf.groupby("worker", sort=False):
                if number != worker:
                    if held:
                        yield out(rest())
                    held, worker, place, draw = [], number, 0, np.random.default_rng([seed, int(number)])
                gone = []
                for row in part.itertuples(index=False, name=None):
                    if len(held) < size:
                        held.append(row)
                    else:
                        k = int(draw.integers(size))
                        gone.append(held[k])
                        held[k] = row
                if gone:
                    yield out(gone)
        if held:
            yield out(rest())

    return laid.mapInPandas(run, f"{kinds}, place bigint")
