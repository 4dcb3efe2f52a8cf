"""Captions in chunks, choices by weight, strides and sizes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framemill.operators.sampling import uniform

#: A caption by chunk: the frames it covers, and its fields.
CHUNKS = "map<string, struct<start_frame: bigint, end_frame: bigint, caption: string, caption_json: map<string, string>>>"

# Where captions of an earlier schema stand, first ones first, and the field an audio caption goes to.
LEGACY = ("caption_rewrite_dense", "caption_dense", "caption_descriptive", "caption_base", "caption_temporal", "caption_short")
AUDIO_FIELD = "audio_description"


def picked(entries: Column, u: Column) -> Column:
    """One entry of an array by u in [0, 1), each as likely; null where there is none."""
    return F.try_element_at(entries, (F.floor(u * F.size(entries)) + 1).cast("int"))


def chunk_of(caption: Column, u: Column) -> Column:
    """(key, value) of one chunk of a caption that is a JSON object of chunks; null where it is none or has none."""
    return picked(F.map_entries(F.from_json(caption, CHUNKS)), u)


def plain_or_chunk(caption: Column, u: Column) -> Column:
    """The text of one chunk of a caption; a caption that is no JSON object is its own text."""
    return F.when(F.trim(caption).startswith("{"), chunk_of(caption, u)["value"]["caption"]).otherwise(caption)


def fields_left(fields: Column, ident: Column, rate: float, seed: int) -> Column:
    """The fields of a caption without those that a draw by id, name and seed drops, each with chance ``rate``."""
    return F.map_filter(fields, lambda k, v: uniform(F.concat(ident.cast("string"), F.lit(":"), k), seed) >= rate)


def audio_caption(flat: Column, nested: Column) -> Column:
    """The audio caption: the flat one, else the first one that is not empty in an array of nested ones; null for none."""
    return F.coalesce(F.nullif(flat, F.lit("")), F.try_element_at(F.filter(nested, lambda c: c != ""), F.lit(1)))


def with_audio(fields: Column, audio: Column) -> Column:
    """A caption's fields with the audio caption among them; it replaces one that is there."""
    rest = F.map_filter(fields, lambda k, v: k != AUDIO_FIELD)
    return F.when(audio.isNull(), fields).otherwise(F.map_concat(rest, F.create_map(F.lit(AUDIO_FIELD), audio)))


def legacy_chunk(named: dict[str, Column], frames: Column) -> Column:
    """One chunk over all frames from captions of the earlier schema: the first that is not empty, as its description; null for none."""
    text = F.coalesce(*[F.nullif(named[k], F.lit("")) for k in LEGACY if k in named])
    key = F.concat(F.lit("chunk_0_"), frames.cast("string"))
    return F.when(text.isNotNull(), F.struct(key.alias("key"), F.lit(0).cast("bigint").alias("start_frame"), frames.alias("end_frame"), text.alias("description")))


def weighted_subset(ident: Column, weights: dict[str, float], n: int, seed: int) -> Column:
    """``n`` of the names without repeats, drawn by weight, in their own order: those with the least -ln(u) / weight."""
    draws = F.array(*[F.struct((-F.log1p(-uniform(F.concat(ident.cast("string"), F.lit(f":{name}")), seed)) / w).alias("t"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, w) in enumerate(weights.items())])
    first = F.slice(F.array_sort(draws), 1, n)
    return F.transform(F.array_sort(F.transform(first, lambda d: F.struct(d["i"], d["name"]))), lambda d: d["name"])


def biased_stride(u: Column, most: Column, least: int = 1, decay: float = 2.0) -> Column:
    """A stride from ``least`` to ``most`` with weights exp(-decay * stride): the first whose cumulative share passes u."""
    steps = F.sequence(F.lit(least), F.greatest(F.lit(least), most.cast("int")))
    mass = lambda upto: 1 - F.exp(-decay * (upto - least + 1))
    total = mass(F.element_at(steps, -1))
    return F.element_at(F.filter(steps, lambda k: (mass(k) / total > u) | (k == F.element_at(steps, -1))), 1)


def nearest_size(height: Column, width: Column, sizes: list[tuple[int, int]]) -> Column:
    """The (height, width) of ``sizes`` whose ratio is nearest to that of the picture; of equal ones the first."""
    near = F.array(*[F.struct(F.abs(height / width - F.lit(h / w)).alias("gap"), F.lit(i).alias("i"), F.lit(h).alias("h"), F.lit(w).alias("w")) for i, (h, w) in enumerate(sizes)])
    return F.array_min(near)


def covered(height: Column, width: Column, target_h: int, target_w: int) -> dict[str, Column]:
    """How to resize a picture so that it covers the target, and where to cut the target out of its middle."""
    scale = F.greatest(F.lit(target_h) / height, F.lit(target_w) / width)
    h, w = F.round(height * scale).cast("int"), F.round(width * scale).cast("int")
    return {"resized_h": h, "resized_w": w, "top": F.floor((h - target_h) / 2), "left": F.floor((w - target_w) / 2)}


def padded(height: Column, width: Column, target_h: int, target_w: int) -> dict[str, Column]:
    """How to resize a picture so that it fits into the target, and the blank rows and columns on each side."""
    scale = F.least(F.lit(target_h) / height, F.lit(target_w) / width)
    h, w = F.round(height * scale).cast("int"), F.round(width * scale).cast("int")
    top, left = F.floor((target_h - h) / 2), F.floor((target_w - w) / 2)
    return {"resized_h": h, "resized_w": w, "top": top, "bottom": target_h - h - top, "left": left, "right": target_w - w - left}
