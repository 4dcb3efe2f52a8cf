"""Deeply nested JSON records as flat tables, by columnar shredding.

A record is shredded into one column for each leaf path of a declared shape. Every entry of a
column has a repetition level (which array began a new element here), a definition level (how
much of the path exists) and a value. The tables are put together from the levels alone: the
position in an array is a running count of repetition levels, computed for a whole batch of
records at once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framemill.functions.jsontext import is_blank, parse
from framemill.session import spread

LEAF = "leaf"

#: Name of a leaf that takes what an object holds beside the shape, as one JSON object.
REST = "*"

#: Shape of a prompt record: dicts are objects, lists are arrays (a single value stands for an array of one).
PROMPT_SHAPE = {
    "name": LEAF,
    "model_mode": LEAF,
    "seed": LEAF,
    "extra": {"prompt": LEAF, "tags": [LEAF], REST: LEAF},
    "prompt": {
        "background_setting": LEAF,
        "aspect_ratio": LEAF,
        "lighting": {"conditions": LEAF, "direction": LEAF, "shadows": LEAF, REST: LEAF},
        "cinematography": {"camera_angle": LEAF, "framing": LEAF, REST: LEAF},
        "resolution": {"H": LEAF, "W": LEAF, REST: LEAF},
        "actions": [{"time": LEAF, "description": LEAF, REST: LEAF}],
        "text_and_signage_elements": [{"category": LEAF, "text": LEAF, REST: LEAF}],
        "subjects": [
            {
                "description": LEAF,
                "location": LEAF,
                "orientation": LEAF,
                "relationship": LEAF,
                "number_of_subjects": LEAF,
                "appearance_details": [LEAF],
                "action": [LEAF],
                REST: LEAF,
            }
        ],
        REST: LEAF,
    },
    REST: LEAF,
}

#: path, levels and value of the columns
SHREDDED = "record_key string, record_id bigint, at timestamp, tie string, path string, rep array<int>, def array<int>, val array<string>"


def _text(value) -> str | None:
    """A leaf as text: text as it stands, anything else as compact JSON; null, blank or empty as null."""
    if is_blank(value):
        return None
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _object(part):
    """JSON carried as text is read."""
    return parse(part)[1] if isinstance(part, str) else part


def _rest(shape: dict, value: dict) -> dict | None:
    """What the shape of an object has no place for: other names, and what is no object where the shape has one.

    Of an array of objects the other elements are kept at their places, with nulls between.
    """
    out = {}
    for name, part in value.items():
        inner = shape.get(name) if name != REST else None
        if inner is None or (isinstance(inner, dict) and not isinstance(_object(part), dict)):
            out[name] = part
        elif isinstance(inner, list) and isinstance(inner[0], dict):
            slots = part if isinstance(part, list) else [part]
            odd = [None if isinstance(x, dict) or is_blank(x) else x for x in slots]
            if any(x is not None for x in odd):
                out[name] = odd if isinstance(part, list) else part
    return {k: v for k, v in out.items() if not is_blank(v)} or None


class Shredder:
    """Shreds values of one shape; ``columns[path] = (rep, def, val)`` after each call."""

    def __init__(self, shape: dict):
        self.shape = shape
        self.paths = [p for p, _ in _leaves(shape, "")]

    def __call__(self, value: dict) -> dict[str, tuple[list[int], list[int], list[str | None]]]:
        self.columns = {p: ([], [], []) for p in self.paths}
        self._walk(self.shape, value, "", 0, 0, 0)
        return self.columns

    def _emit(self, path: str, r: int, d: int, v: str | None) -> None:
        rep, defs, vals = self.columns[path]
        rep.append(r)
        defs.append(d)
        vals.append(v)

    def _missing(self, shape, path: str, r: int, d: int) -> None:
        for leaf, _ in _leaves(shape, path):
            self._emit(leaf, r, d, None)

    def _walk(self, shape, value, path: str, r: int, d: int, depth: int) -> None:
        if shape == LEAF:
            text = _text(value)
            self._emit(path, r, d + (text is not None), text)
        elif isinstance(shape, dict):
            for name, inner in shape.items():
                below = f"{path}.{name}" if path else name
                part = _rest(shape, value) if name == REST else value.get(name)
                if isinstance(inner, dict):
                    part = _object(part)
                if isinstance(inner, dict) and not isinstance(part, dict):
                    self._missing(inner, below, r, d)
                else:
                    self._walk(inner, part, below, r, d + isinstance(inner, dict), depth)
        else:
            inner, below = shape[0], path + "[]"
            slots = value if isinstance(value, list) else [value]
            if value is None or not slots:  # no array, or one without elements
                self._missing(inner, below, r, d + (value is not None))
                return
            for i, slot in enumerate(slots):
                at = r if i == 0 else depth + 1
                empty = is_blank(slot) or (isinstance(inner, dict) and not isinstance(slot, dict))
                if empty:  # the slot counts for the positions, but holds nothing
                    self._missing(inner, below, at, d + 2)
                elif inner == LEAF:
                    self._emit(below, at, d + 3, _text(slot))
                else:
                    self._emit(below, at, d + 3, "")
                    self._walk(inner, slot, below, at, d + 3, depth + 1)


def _leaves(shape, path: str) -> Iterator[tuple[str, int]]:
    """(path, arrays on the way) of every column; an array of objects has a column of its own."""
    if shape == LEAF:
        yield path, path.count("[]")
        return
    if isinstance(shape, list):
        yield from _leaves(shape[0], path + "[]")
        return
    if path.endswith("[]"):
        yield path, path.count("[]")
    for name, inner in shape.items():
        yield from _leaves(inner, f"{path}.{name}" if path else name)


def pruned(shape, wanted: set[str], path: str = ""):
    """What of a shape leads to wanted columns, None for nothing. Levels stay what they are."""
    if shape == LEAF:
        return shape if path in wanted else None
    if isinstance(shape, list):
        inner = pruned(shape[0], wanted, path + "[]")
        return [{} if inner is None else inner] if inner is not None or path + "[]" in wanted else None
    out = {name: part for name, inner in shape.items() if (part := pruned(inner, wanted, f"{path}.{name}" if path else name)) is not None}
    return out or None


def full_levels(shape, path: str = "", d: int = 0) -> dict[str, int]:
    """The definition level of each column at which its value exists: an object counts one, an array three (array, slot, element), a leaf outside an array one."""
    if shape == LEAF:
        return {path: d if path.endswith("[]") else d + 1}
    if isinstance(shape, list):
        return full_levels(shape[0], path + "[]", d + 3)
    out = {path: d} if path.endswith("[]") else {}
    for name, inner in shape.items():
        out |= full_levels(inner, f"{path}.{name}" if path else name, d + isinstance(inner, dict))
    return out


def states(shredded: DataFrame, shape: dict = PROMPT_SHAPE) -> DataFrame:
    """(path, state, n): how often a leaf or element of each column is 'there', 'blank' in its array, in an 'empty' array, or 'missing'.

    Told by the definition levels alone. 'missing' stands for a null, blank or absent value, or an absent one above it.
    """
    full = full_levels(shape)
    level = F.create_map(*[F.lit(x) for pair in full.items() for x in pair])[F.col("path")]
    each = shredded.select("path", F.explode("def").alias("d")).groupBy("path", "d").agg(F.count(F.lit(1)).alias("n"))
    short, array = level - F.col("d"), F.col("path").endswith("[]")
    state = F.when(short == 0, "there").when(array & (short == 1), "blank").when(array & (short == 2), "empty").otherwise("missing")
    return each.groupBy("path", state.alias("state")).agg(F.sum("n").alias("n"))


def record_of(raw: str | None) -> dict | None:
    """The record in a raw text, out of a wrapper with the key ``t2i``; None where it or its prompt is no whole JSON object."""
    ok, value = parse(raw)
    if ok and isinstance(value, list) and len(value) == 1:
        value = value[0]
    if not ok or not isinstance(value, dict):
        return None
    inner = value.get("t2i")
    if isinstance(inner, str):
        inner = parse(inner)[1]
    record = inner if isinstance(inner, dict) else value
    prompt = record.get("prompt")
    if isinstance(prompt, str):
        prompt = parse(prompt)[1]
    return {**record, "prompt": prompt} if isinstance(prompt, dict) else None


def shred(records: DataFrame, shape: dict = PROMPT_SHAPE, paths: list[str] | None = None) -> DataFrame:
    """Columns of levels and values of each record: (record_key, path, rep, def, val).

    ``records`` needs record_id, raw_json and received_at; other columns are not read. Text that
    is no complete JSON, or whose prompt is none, gives no columns. Of several deliveries of a
    record the one received last that is whole counts (ties: the greater digest; null times come
    first), chosen by an aggregation that combines before the shuffle. A null record_id is keyed
    by the digest of its text, so equal texts without an id are one record. Texts are read whole.
    ``paths`` limits which columns are kept. An empty table gives none.
    """
    wanted = set(paths) if paths is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shredder = Shredder((pruned(shape, wanted) or {}) if wanted is not None else shape)
        for batch in batches:
            out = [[] for _ in range(8)]
            for rid, raw, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                record = record_of(raw)
                if record is None:
                    continue
                tie = hashlib.sha256(raw.encode("utf-8", "surrogatepass")).hexdigest()
                key = str(rid) if rid is not None else f"text:{tie}"
                for path, (rep, defs, vals) in shredder(record).items():
                    if wanted is None or path in wanted:
                        for column, v in zip(out, (key, rid, at, tie, path, rep, defs, vals)):
                            column.append(v)
            kinds = [pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
            names = [f.split()[0] for f in SHREDDED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=names)

    rows = spread(records.select("record_id", "raw_json", F.col("received_at").cast("timestamp"))).mapInArrow(run, SHREDDED)
    last = F.max_by(F.struct("rep", "def", "val"), F.struct("at", "tie"))
    return rows.groupBy("record_key", "path").agg(F.max("record_id").alias("record_id"), last.alias("c")).select("record_key", "record_id", "path", "c.rep", "c.def", "c.val")


ENTRIES = "record_key string, record_id bigint, path string, subject_pos int, child_pos int, value string"


def entries(shredded: DataFrame, shape: dict = PROMPT_SHAPE) -> DataFrame:
    """What exists in the columns, with its positions: (record_key, record_id, path, subject_pos, child_pos, value).

    ``subject_pos`` and ``child_pos`` are the 0-based places in the first and second array on the
    path (null where the path has none); slots that hold nothing count for them but give no row. What exists has
    the full definition level of its column. A path of more arrays has the places in its last two.
    """
    full = full_levels(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(3)
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            rep, defs, val = np.asarray(lists.flatten()), np.asarray(batch.column(4).flatten()), batch.column(5).flatten()
            paths = batch.column(2).to_pylist()
            depth = np.array([p.count("[]") for p in paths])
            last = np.maximum(depth - 2, 0)[owner]
            outer, _ = _count(rep <= last + 1, rep <= last)
            inner, _ = _count(np.ones(len(rep), bool), rep <= last + 1)
            have = defs == np.array([full[p] for p in paths])[owner]
            own = owner[have]
            arrays = depth[own]
            take = pa.array(own)
            first = pa.array(outer[have], pa.int32(), mask=arrays < 1)
            second = pa.array(inner[have], pa.int32(), mask=arrays < 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), first, second, val.filter(pa.array(have))], names=[f.split()[0] for f in ENTRIES.split(", ")])

    return shredded.select("record_key", "record_id", "path", "rep", "def", "val").mapInArrow(run, ENTRIES)


def _count(step: np.ndarray, restart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running count of ``step`` that begins at 0 again where ``restart`` is set."""
    total = np.cumsum(step)
    base = np.maximum.accumulate(np.where(restart, total, 0)) if len(total) else total
    return total - base, total


SUBJECT = "prompt.subjects[]"


def _column(path: str) -> str:
    """Name of a leaf in its table: its path below the prompt or the array's element."""
    below = path.rsplit("[].", 1)[-1] if "[]." in path else path.removeprefix("prompt.") if path != f"prompt.{REST}" else path
    return below.replace(REST, "rest").replace(".", "_")


def flat_tables(records: DataFrame, shape: dict = PROMPT_SHAPE) -> dict[str, DataFrame]:
    """Tables of the records, linked by record_key and subject_pos: records, subjects and their appearance_details and action.

    Further tables have a row per element of each other array of the record (actions, text_and_signage_elements,
    tags), with its place ``pos``. Columns ``rest`` hold what the shape does not name, as JSON.
    """
    found = entries(shred(records, shape), shape)
    names = {p: _column(p) for p, _ in _leaves(shape, "")}

    def wide(keys: list[str], paths: list[str], element: str | None = None) -> DataFrame:
        cols = [F.max(F.when(F.col("path") == p, F.col("value"))).alias(names[p]) for p in paths]
        return found.where(F.col("path").isin([*paths, *([element] if element else [])])).groupBy(*keys).agg(F.max("record_id").alias("record_id"), *cols)

    def child(path: str) -> DataFrame:
        rows = found.where(F.col("path") == path)
        fields = [F.get_json_object("value", f"$.{k}").alias(k) for k in ("time", "description")]
        return rows.select("record_key", "record_id", "subject_pos", "child_pos", "value", *fields)

    def fields_of(element: str) -> list[str]:
        return [p for p in names if p.startswith(element + ".") and not p.endswith("[]")]

    def elements(path: str) -> DataFrame:
        if fields_of(path):
            return wide(["record_key", "subject_pos"], fields_of(path), path).withColumnRenamed("subject_pos", "pos")
        return found.where(F.col("path") == path).select("record_key", "record_id", F.col("subject_pos").alias("pos"), "value")

    arrays = [p for p in names if p.endswith("[]") and p.count("[]") == 1 and p != SUBJECT]
    return {
        "records": wide(["record_key"], [p for p in names if "[]" not in p]),
        "subjects": wide(["record_key", "subject_pos"], fields_of(SUBJECT), SUBJECT),
        "appearance_details": child(SUBJECT + ".appearance_details[]"),
        "action": child(SUBJECT + ".action[]"),
        **{p.rsplit(".", 1)[-1].removesuffix("[]"): elements(p) for p in arrays},
    }
