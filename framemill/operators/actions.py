"""Chunks of relative actions and their training layout, as the embodiment readers share them.

A reader is a choice of columns, a rotation form, a chunk length and a stride; the rest is the same
for all of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framemill.functions import rotations
from framemill.operators.episodic import BLOCK, haloed

#: Domains of the readers and the width of their action vectors.
DOMAINS = {"bridge": (0, 10), "fractal": (1, 10), "hand": (2, 57), "franka": (3, 10), "franka_dual": (4, 20), "ur": (5, 10), "umi": (6, 10), "libero": (7, 7), "agibot": (8, 29), "egosuite": (9, 55), "droid": (10, 10)}


@dataclass(frozen=True)
class Reader:
    """One embodiment: where its pose stands in the vector and how chunks are cut."""

    name: str
    vector: str
    rotation: str = "axisangle"
    xyz: slice = field(default_factory=lambda: slice(0, 3))
    turn: slice = field(default_factory=lambda: slice(3, 6))
    gripper: slice = field(default_factory=lambda: slice(6, 7))
    chunk: int = 16
    stride: int = 1
    anchored: bool = False
    scale: float = 1.0

    @property
    def domain_id(self) -> int:
        return DOMAINS[self.name][0]


CHUNKS = "ep bigint, i bigint, actions array<array<double>>"


def relative_chunks(frames: DataFrame, reader: Reader, block: int = BLOCK) -> DataFrame:
    """(ep, i, actions): for each start, ``chunk`` steps of translation (3), two rotation columns (6) and gripper, each relative to the step before (or to the start).

    ``frames`` has ep, i and the reader's vector. Only starts whose chunk lies wholly in the episode,
    without a missing frame and with no null or NaN number, give a row. Episodes are read in blocks with
    a halo of one chunk, so no task holds an episode.
    """
    need = frames.select("ep", "i", F.col(reader.vector).cast("array<double>").alias("x")).where("i is not null and x is not null")
    spread = haloed(need, "i", 0, reader.chunk, block)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True).drop_duplicates("i", ignore_index=True)
        i = pdf["i"].to_numpy()
        width = max(reader.xyz.stop, reader.turn.stop, reader.gripper.stop)
        x = np.array([v if len(v) >= width else [np.nan] * width for v in (np.array(a, dtype=float)[:width] for a in pdf["x"])], dtype=float)
        good = ~np.isnan(x).any(1)
        out = []
        for k in range(len(i)):
            end = k + reader.chunk
            if not pdf["_own"].iloc[k] or i[k] % reader.stride or end >= len(i) or i[end] != i[k] + reader.chunk or not good[k : end + 1].all():
                continue
            part = x[k : end + 1]
            poses = rotations.pose(part[:, reader.xyz], part[:, reader.turn], reader.rotation, reader.scale)
            rel = rotations.relative(poses, reader.anchored)
            six = rotations.from_matrix(rel[:, :3, :3], "rot6d")
            out.append((pdf["ep"].iloc[k], i[k], np.concatenate([rel[:, :3, 3], six, part[1:, reader.gripper]], 1).tolist()))
        return pd.DataFrame(out, columns=["ep", "i", "actions"])

    return spread.groupBy("ep", "_block").applyInPandas(run, CHUNKS)


def loaded_actions(text: Column, chunk: int, width: int) -> Column:
    """Actions of a JSON text as a chunk x width array, zero-padded; zeros where there are none."""
    rows = F.coalesce(F.from_json(text, "array<array<double>>"), F.array().cast("array<array<double>>"))
    zeros = F.array_repeat(F.lit(0.0), width)
    padded = F.transform(rows, lambda r: F.slice(F.concat(r, zeros), 1, width))
    return F.slice(F.concat(padded, F.array_repeat(zeros, chunk)), 1, chunk)


def sequence_plan(frames: Column, u: Column, weights: dict[int, float]) -> Column:
    """Indexes of the conditioning frames: how many is a weighted choice by u, at most all but one."""
    total, upto, n = sum(weights.values()), 0.0, None
    for k, w in weights.items():
        upto += w
        n = F.when(u < upto / total, k) if n is None else n.when(u < upto / total, k)
    n = F.least(n.otherwise(list(weights)[-1]), F.greatest(F.lit(0), frames - 1)).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def domain(name: Column, known: dict[str, tuple[int, int]] = DOMAINS) -> tuple[Column, Column]:
    """(id, width) of a domain by its name, in any case and with blanks around; nulls for an unknown one."""
    key = F.lower(F.trim(name))
    table = lambda k: F.create_map(*[F.lit(x) for d, v in known.items() for x in (d, v[k])])
    return F.try_element_at(table(0), key), F.try_element_at(table(1), key)


def stride_frames(start: Column, end: Column, fps: Column, cap: float, need: int) -> Column:
    """Frame numbers of a clip at a stride that keeps the rate under the cap, from its middle; null where the clip is too short."""
    step = F.greatest(F.lit(1), F.ceil(fps / cap))
    span = (need - 1) * step
    first = start + F.floor((end - start - span) / 2)
    return F.when(end - start >= span, F.sequence(first.cast("bigint"), (first + span).cast("bigint"), step.cast("bigint")))


def encode_state(state: np.ndarray, anchor: np.ndarray, scalars: slice, grippers: slice, quats: list[slice]) -> np.ndarray:
    """States relative to an anchor: scalars as differences, grippers as they are, quaternions (xyzw) as the turn from the anchor's."""
    out = np.array(state, dtype=float)
    out[..., scalars] = state[..., scalars] - anchor[..., scalars]
    out[..., grippers] = state[..., grippers]
    for q in quats:
        a, b = rotations.to_matrix(anchor[..., q], "quat_xyzw"), rotations.to_matrix(state[..., q], "quat_xyzw")
        out[..., q] = rotations.from_matrix(np.swapaxes(a, -1, -2) @ b, "quat_xyzw")
    return out


def decode_state(code: np.ndarray, anchor: np.ndarray, scalars: slice, grippers: slice, quats: list[slice]) -> np.ndarray:
    """The inverse of ``encode_state``; quaternions come back with their last number not negative."""
    out = np.array(code, dtype=float)
    out[..., scalars] = code[..., scalars] + anchor[..., scalars]
    out[..., grippers] = code[..., grippers]
    for q in quats:
        a, b = rotations.to_matrix(anchor[..., q], "quat_xyzw"), rotations.to_matrix(code[..., q], "quat_xyzw")
        out[..., q] = rotations.from_matrix(a @ b, "quat_xyzw")
    return out
