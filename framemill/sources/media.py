"""Media files next to the tables: located by the tables, opened by a function the caller supplies."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Kept:
    """The last opened items, by key; the one unused longest is closed first. One per worker process."""

    def __init__(self, open_one: Callable[[str], Any], size: int = 16, close: Callable[[Any], None] | None = None):
        self.open_one, self.size, self.close = open_one, size, close
        self.items: OrderedDict[str, Any] = OrderedDict()

    def __call__(self, key: str) -> Any:
        if key in self.items:
            self.items.move_to_end(key)
            return self.items[key]
        item = self.items[key] = self.open_one(key)
        if len(self.items) > self.size:
            _, old = self.items.popitem(last=False)
            if self.close:
                self.close(old)
        return item


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modification_time) of files under a path, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def decoded(rows: DataFrame, path: str, decoder: Callable[[str], Callable[[list[float]], list[bytes]]], times: str, out: str = "frames", size: int = 16) -> DataFrame:
    """Frames of media at times: ``decoder(path)`` gives a function from times to encoded frames.

    Rows are brought together by path, spread over slices of time, so that a file is opened by few
    tasks and a long one is not read by a single one. The codec is the caller's; none is built in.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.BinaryType()))])
    slices = F.floor(F.coalesce(F.element_at(times, 1), F.lit(0.0)) / 600)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = Kept(decoder, size)
        for pdf in batches:
            yield pdf.assign(**{out: [kept(p)(list(t)) if p is not None and t is not None else None for p, t in zip(pdf[path], pdf[times])]})

    return rows.repartition(F.col(path), slices).sortWithinPartitions(path).mapInPandas(run, schema)


def probed(files: DataFrame, probe: Callable[[str], dict]) -> DataFrame:
    """(path, fps, duration, width, height, num_frames) by a function of the path; a file that can't be probed keeps nulls and its error."""
    fields = ("fps", "duration", "width", "height", "num_frames")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                try:
                    got, error = probe(p), None
                except Exception as e:  # noqa: BLE001
                    got, error = {}, str(e)
                rows.append((p, *(got.get(k) for k in fields), error))
            yield pd.DataFrame(rows, columns=["path", *fields, "error"]).astype({"num_frames": "Int64", "width": "Int64", "height": "Int64"})

    return files.select("path").mapInPandas(run, "path string, fps double, duration double, width bigint, height bigint, num_frames bigint, error string")
