"""Features of a data set as schemas: flattening, removal, combination and classification."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that no edit may remove.
REQUIRED = ("episode_index", "frame_index", "timestamp", "index", "task_index")


def flattened(df: DataFrame, sep: str = "_") -> DataFrame:
    """Struct fields as columns of their own, names joined by ``sep``; two fields may not come to one name."""

    def leaves(schema: T.StructType, path: list[str]):
        for f in schema.fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, [*path, f.name])
            else:
                yield [*path, f.name]

    paths = list(leaves(df.schema, []))
    flat = [sep.join(p) for p in paths]
    if len(set(flat)) < len(flat):
        raise ValueError(f"flattening gives a name twice: {flat}")
    return df.select(*[F.col(".".join(f"`{x}`" for x in p)).alias(n) for p, n in zip(paths, flat)])


def nested(df: DataFrame, sep: str = "_") -> DataFrame:
    """The inverse for one level: columns that share what stands before the first ``sep`` become a struct."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(c.split(sep, 1)[0], []).append(c)
    return df.select(*[F.col(f"`{cs[0]}`") if cs == [k] else F.struct(*[F.col(f"`{c}`").alias(c.split(sep, 1)[1]) for c in cs]).alias(k) for k, cs in groups.items()])


def without_features(df: DataFrame, names: list[str]) -> DataFrame:
    kept = [n for n in names if n in REQUIRED]
    if kept:
        raise ValueError(f"{kept} may not be removed")
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{missing} are not there")
    return df.drop(*names)


def with_features(df: DataFrame, features: dict[str, Column]) -> DataFrame:
    """Add columns in one projection; existing names are refused."""
    there = [n for n in features if n in df.columns]
    if there:
        raise ValueError(f"{there} exist")
    return df.withColumns(features)


def matching(df: DataFrame, patterns: list[str], strip: str = "") -> DataFrame:
    """Columns whose name matches one of the patterns, a prefix cut off."""
    cols = [c for c in df.columns if any(re.search(p, c) for p in patterns)]
    return df.select(*[F.col(f"`{c}`").alias(c.removeprefix(strip)) for c in cols])


def combined(*features: dict[str, list[str]]) -> dict[str, list[str]]:
    """Feature groups merged by name; the channels of a vector are joined, each once, in order."""
    out: dict[str, list[str]] = {}
    for group in features:
        for name, channels in group.items():
            have = out.setdefault(name, [])
            have += [c for c in channels if c not in have]
    return out


def kind_of(name: Column) -> Column:
    """What a feature is for a policy, by its name."""
    return F.when(name.startswith("observation.image"), "visual").when(name.startswith("observation.environment"), "environment").when(name.startswith("observation"), "state").when(name.startswith("action"), "action")


def from_hardware(spec: dict[str, type | tuple]) -> T.StructType:
    """A schema from joints (float) and cameras (a tuple of height, width, channels)."""
    joints = [k for k, v in spec.items() if v is float]
    fields = [T.StructField("state", T.ArrayType(T.FloatType()), metadata={"channels": joints})] if joints else []
    for k, v in spec.items():
        if isinstance(v, tuple):
            fields.append(T.StructField(k, T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("path", T.StringType())]), metadata={"shape": list(v)}))
    return T.StructType(fields)
