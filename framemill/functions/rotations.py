"""Rotations and poses over numpy arrays, for pandas functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def nearest_rotation(m: np.ndarray) -> np.ndarray:
    """Approximate 3x3 matrices projected onto proper rotations."""
    u, _, vt = np.linalg.svd(m)
    sign = np.sign(np.linalg.det(u @ vt))
    u = u.copy()
    u[..., :, 2] *= sign[..., None]
    return u @ vt


def _axis_to_matrix(v: np.ndarray) -> np.ndarray:
    angle = np.linalg.norm(v, axis=-1)[..., None, None]
    k = v / np.maximum(angle[..., 0], 1e-12)
    z = np.zeros_like(k[..., 0])
    cross = np.stack([np.stack([z, -k[..., 2], k[..., 1]], -1), np.stack([k[..., 2], z, -k[..., 0]], -1), np.stack([-k[..., 1], k[..., 0], z], -1)], -2)
    return np.eye(3) + np.sin(angle) * cross + (1 - np.cos(angle)) * (cross @ cross)


def _quat_to_matrix(q: np.ndarray) -> np.ndarray:
    x, y, z, w = np.moveaxis(q / np.linalg.norm(q, axis=-1, keepdims=True), -1, 0)
    rows = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    return np.stack([np.stack(r, -1) for r in rows], -2)


def _matrix_to_quat(m: np.ndarray) -> np.ndarray:
    """xyzw with w not negative, from the eigenvector of the largest eigenvalue of the symmetric form."""
    a = m
    k = np.empty((*a.shape[:-2], 4, 4))
    xx, xy, xz, yx, yy, yz, zx, zy, zz = (a[..., i, j] for i in range(3) for j in range(3))
    rows = [[xx - yy - zz, yx + xy, zx + xz, zy - yz], [yx + xy, yy - xx - zz, zy + yz, xz - zx], [zx + xz, zy + yz, zz - xx - yy, yx - xy], [zy - yz, xz - zx, yx - xy, xx + yy + zz]]
    for i in range(4):
        for j in range(4):
            k[..., i, j] = rows[i][j] / 3.0
    _, vectors = np.linalg.eigh(k)
    q = vectors[..., :, 3]
    return q * np.where(q[..., 3:] < 0, -1.0, 1.0)


def to_matrix(r: np.ndarray, form: str) -> np.ndarray:
    """Rotation matrices from 'matrix', 'rot9d', 'rot6d' (two columns), 'quat_xyzw', 'quat_wxyz', 'axisangle' or 'euler_xyz' (radians, fixed axes)."""
    r = np.asarray(r, float)
    if form == "matrix":
        return r
    if form == "rot9d":
        return nearest_rotation(r.reshape(*r.shape[:-1], 3, 3))
    if form == "rot6d":
        a, b = r[..., :3], r[..., 3:]
        x = a / np.linalg.norm(a, axis=-1, keepdims=True)
        y = b - (x * b).sum(-1, keepdims=True) * x
        y = y / np.linalg.norm(y, axis=-1, keepdims=True)
        return np.stack([x, y, np.cross(x, y)], -1)
    if form == "quat_xyzw":
        return _quat_to_matrix(r)
    if form == "quat_wxyz":
        return _quat_to_matrix(np.roll(r, -1, -1))
    if form == "axisangle":
        return _axis_to_matrix(r)
    if form == "euler_xyz":
        x, y, z = (_axis_to_matrix(r[..., i : i + 1] * np.eye(3)[i]) for i in range(3))
        return z @ y @ x
    raise ValueError(f"unknown form {form!r}")


def from_matrix(m: np.ndarray, form: str) -> np.ndarray:
    if form == "matrix":
        return m
    if form == "rot9d":
        return m.reshape(*m.shape[:-2], 9)
    if form == "rot6d":
        return np.concatenate([m[..., :, 0], m[..., :, 1]], -1)
    q = _matrix_to_quat(m) if form != "euler_xyz" else None
    if form == "quat_xyzw":
        return q
    if form == "quat_wxyz":
        return np.roll(q, 1, -1)
    if form == "axisangle":
        sine = np.linalg.norm(q[..., :3], axis=-1, keepdims=True)
        angle = 2 * np.arctan2(sine, q[..., 3:])
        return np.where(sine > 1e-12, q[..., :3] / np.maximum(sine, 1e-12) * angle, 2 * q[..., :3])
    if form == "euler_xyz":
        y = np.arcsin(np.clip(-m[..., 2, 0], -1, 1))
        return np.stack([np.arctan2(m[..., 2, 1], m[..., 2, 2]), y, np.arctan2(m[..., 1, 0], m[..., 0, 0])], -1)
    raise ValueError(f"unknown form {form!r}")


def convert(r: np.ndarray, given: str, wanted: str) -> np.ndarray:
    return from_matrix(to_matrix(r, given), wanted)


def pose(xyz: np.ndarray, rotation: np.ndarray, form: str, scale: float = 1.0) -> np.ndarray:
    """4x4 poses from translations (scaled) and rotations."""
    m = to_matrix(rotation, form)
    out = np.zeros((*m.shape[:-2], 4, 4))
    out[..., :3, :3], out[..., :3, 3], out[..., 3, 3] = m, np.asarray(xyz) * scale, 1
    return out


def relative(poses: np.ndarray, anchored: bool = False) -> np.ndarray:
    """Each pose in the frame of the one before it, or of the first: n poses give n - 1."""
    base = np.repeat(poses[:1], len(poses) - 1, 0) if anchored else poses[:-1]
    return np.linalg.inv(base) @ poses[1:]


def absolute(first: np.ndarray, steps: np.ndarray, anchored: bool = False) -> np.ndarray:
    """The inverse of ``relative``."""
    if anchored:
        return np.concatenate([first[None], first @ steps])
    out = [first]
    for s in steps:
        out.append(out[-1] @ s)
    return np.stack(out)


def angle_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Degrees between rotations."""
    trace = np.trace(np.swapaxes(a, -1, -2) @ b, axis1=-2, axis2=-1)
    return np.degrees(np.arccos(np.clip((trace - 1) / 2, -1, 1)))


def convert_column(given: str, wanted: str):
    """A pandas function over arrays of one rotation each; rows with a null or NaN element give null."""

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        good = [v is not None and not any(x is None or x != x for x in v) for v in rows]
        some = [v for v, ok in zip(rows, good) if ok]
        done = iter(convert(np.stack(some).astype(float), given, wanted).reshape(len(some), -1)) if some else iter(())
        return pd.Series([next(done) if ok else None for ok in good], index=rows.index, dtype=object)

    return run


def decode_rle_rows(counts: list[int], height: int, width: int, first: int, stop: int) -> np.ndarray:
    """Rows [first, stop) of a mask coded as run lengths down its columns, zeros first; only those rows are built."""
    ends = np.cumsum(counts)
    cols, rows = np.meshgrid(np.arange(width), np.arange(first, stop))
    return (np.searchsorted(ends, cols * height + rows, side="right") % 2).astype(np.uint8)
