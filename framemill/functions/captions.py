"""Caption, timestamp and conversation expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from framemill.functions.jsontext import parse

# The sentences that describe a clip, as the training captions word them.
DURATION_TEXT = "The video is %.1f seconds long and is of %.0f FPS."
IMAGE_SIZE_TEXT = "This image is of %dx%d resolution."
VIDEO_SIZE_TEXT = "This video is of %dx%d resolution."
IDLE_TEXT = "IdleFrames: %d out of %d."
IDLE_TEXT_ALONE = "IdleFrames: %d."
VIEW_TEXTS = {
    "ego_view": "This video is captured from a first-person perspective looking at the scene.",
    "third_person_view": "This video is captured from a third-person perspective looking towards the agent from the front.",
    "wrist_view": "This video is captured from a wrist-mounted camera.",
    "concat_view": "This video contains concatenated views from multiple camera perspectives.",
    "top_down_2d_view": "This video is captured from a top-down view of a flat 2D scene.",
}
# Roles of conversations under the names that sources use.
ROLES = {"human": "user", "gpt": "assistant", "user": "user", "assistant": "assistant", "label": "assistant"}
ASPECTS = [(0.65, "9,16"), (0.88, "3,4"), (1.16, "1,1"), (1.55, "4,3")]
WIDEST = "16,9"


def with_sentence(caption: Column, sentence: Column) -> Column:
    """The caption and a further sentence, separated by a blank after a full stop, else by a full stop and a blank; blank captions stay."""
    sep = F.when(F.rtrim(caption).endswith("."), " ").otherwise(". ")
    return F.when(F.coalesce(caption, F.lit("")) == "", caption).otherwise(F.concat(caption, sep, sentence))


def duration_sentence(frames: Column, fps: Column) -> Column:
    """Whole seconds and rate; null where the rate is not positive."""
    return F.when(fps > 0, F.format_string(DURATION_TEXT, F.floor(frames / fps).cast("double"), fps.cast("double")))


def size_sentence(height: Column, width: Column, video: bool = True) -> Column:
    return F.format_string(VIDEO_SIZE_TEXT if video else IMAGE_SIZE_TEXT, height.cast("int"), width.cast("int"))


def idle_sentence(idle: Column, total: Column) -> Column:
    return F.when(total.isNull(), F.format_string(IDLE_TEXT_ALONE, idle.cast("int"))).otherwise(F.format_string(IDLE_TEXT, idle.cast("int"), total.cast("int")))


def view_sentence(view: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in VIEW_TEXTS.items() for x in pair])
    return F.try_element_at(table, view)


#: White space at either end, as ``str.strip`` knows it, in words that both engines read alike.
OUTER_SPACE = r"\A[\s\x0B\x1C-\x1F\x85\p{Z}]+|[\s\x0B\x1C-\x1F\x85\p{Z}]+\z"


def dense_text(raw: Column) -> Column:
    """Plain captions end with exactly one full stop; JSON is kept word for word. White space of any kind around either goes."""
    bare = F.regexp_replace(raw, OUTER_SPACE, "")
    return F.when(bare.startswith("{"), bare).otherwise(F.concat(F.regexp_replace(bare, r"\.+$", ""), F.lit(".")))


def clock(seconds: Column, form: str = "hh:mm:ss") -> Column:
    """hh:mm:ss (truncated), hh:mm:ss.sss or mm:ss.sss."""
    minutes = F.floor(seconds / 60)
    rest = seconds - minutes * 60
    if form == "hh:mm:ss":
        return F.format_string("%02d:%02d:%02d", F.floor(minutes / 60), F.pmod(minutes, F.lit(60)), F.floor(rest))
    if form == "hh:mm:ss.sss":
        return F.format_string("%02d:%02d:%06.3f", F.floor(minutes / 60), F.pmod(minutes, F.lit(60)), rest)
    if form == "mm:ss.sss":
        return F.format_string("%02d:%06.3f", minutes, rest)
    raise ValueError(f"unknown form {form!r}")


def short_clock(seconds: Column) -> Column:
    """M:SS of whole seconds."""
    return F.format_string("%d:%02d", F.floor(seconds / 60), F.pmod(seconds, F.lit(60)))


def reduced_ratio(width: Column, height: Column) -> Column:
    """W,H in lowest terms, empty where a side is not positive; Euclid's steps run as a fold (as many as 64-bit numbers need)."""
    steps = F.sequence(F.lit(1), F.lit(92))
    start = F.struct(width.cast("bigint").alias("a"), height.cast("bigint").alias("b"))
    g = F.aggregate(steps, start, lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("bigint")).otherwise(F.pmod(s["a"], F.greatest(s["b"], F.lit(1)))).alias("b")))["a"]
    text = F.concat_ws(",", F.floor(width / g).cast("string"), F.floor(height / g).cast("string"))
    return F.when((width > 0) & (height > 0), text).otherwise("")


def aspect_bucket(width: Column, height: Column) -> Column:
    r, out = width / height, None
    for bound, name in ASPECTS:
        out = F.when(r < bound, name) if out is None else out.when(r < bound, name)
    return out.otherwise(WIDEST)


def bare_tag(text: Column, tag: str) -> Column:
    """What stands between a tag and its end tag, null where it is not there."""
    inner = F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1)
    return F.when(text.rlike(f"(?s)<{tag}>.*?</{tag}>"), F.trim(inner))


def without_fence(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[\w+-]*\s*", ""), r"\s*```$", ""))


def uri_parts(uri: Column) -> tuple[Column, Column]:
    """(bucket, key) of scheme://bucket/key."""
    return F.regexp_extract(uri, r"^[A-Za-z][\w+.-]*://([^/]*)/?(.*)$", 1), F.regexp_extract(uri, r"^[A-Za-z][\w+.-]*://([^/]*)/?(.*)$", 2)


def score(text: Column) -> Column:
    """The first digit 1 to 5 that stands alone, null where there is none."""
    return F.regexp_extract(text, r"\b([1-5])\b", 1).try_cast("int")


def role(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), name)


def text_parts(content: Column) -> Column:
    """A plain message as a list of typed parts."""
    return F.array(F.struct(F.lit("text").alias("type"), content.alias("text")))


def with_reasoning(answer: Column, reasoning: Column) -> Column:
    """An answer with its reasoning before it in think tags, where there is any."""
    think = F.array(*[F.struct(F.lit("text").alias("type"), t.alias("text")) for t in (F.lit("<think>\n"), reasoning, F.lit("\n</think>\n\n"))])
    return F.when(F.coalesce(reasoning, F.lit("")) == "", text_parts(answer)).otherwise(F.concat(think, text_parts(answer)))


def media_first(parts: Column, first: bool = True) -> Column:
    """Typed parts with the media ones before (or after) the texts, the order kept among each."""
    text = F.filter(parts, lambda p: p["type"] == "text")
    media = F.filter(parts, lambda p: p["type"] != "text")
    return F.concat(media, text) if first else F.concat(text, media)


def first_media(parts: Column) -> Column:
    """The reference of the first image or video part, null where there is none."""
    found = F.filter(parts, lambda p: p["type"].isin("image", "video"))
    return F.when(F.size(found) > 0, found[0]["ref"])


def window_caption(captions: Column, model: str | None, enhanced: str | None) -> Column:
    """One caption out of a map of named ones: the configured enhanced one, the configured one, then the first by name of either kind; blanks do not count."""
    clean = F.map_filter(F.transform_values(captions, lambda _, v: F.trim(v)), lambda _, v: v.isNotNull() & (v != ""))
    names = F.array_sort(F.map_keys(clean))
    one = lambda keep: F.try_element_at(clean, F.try_element_at(F.filter(names, keep), F.lit(1)))
    chain = [F.try_element_at(clean, F.lit(f"{enhanced}_enhanced_caption"))] if enhanced else []
    chain += [F.try_element_at(clean, F.lit(f"{model}_caption"))] if model else []
    chain += [one(lambda n: n.endswith("_enhanced_caption")), one(lambda n: n.endswith("_caption") & ~n.endswith("_enhanced_caption"))]
    return F.coalesce(*chain)


def rounded_numbers(places: int):
    """A pandas function: every number in a text with at most so many decimals, trailing zeros trimmed (0: cut to whole)."""
    number = re.compile(r"-?\d+\.?\d*(?:[eE][+-]?\d+)?")

    def one(m: re.Match) -> str:
        x = float(m[0])
        if x in (float("inf"), float("-inf")):
            return m[0]
        return str(int(x)) if places <= 0 else f"{x:.{places}f}".rstrip("0").rstrip(".")

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else number.sub(one, t))

    return run


def squeezed_repeats():
    """A pandas function: a marker (<|..|> or [..]) that is repeated in a row as marker*Ntimes."""
    again = re.compile(r"(<\|[^|]+\|>|\[[^\]]+\])\1+")

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else again.sub(lambda m: f"{m[1]}*{len(m[0]) // len(m[1])}times", t))

    return run


def recovered_json():
    """A pandas function: the JSON object in a response (tagged, fenced, quoted or between words) in compact form, null where there is none."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            ok, value = parse(t)
            return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True) if ok and isinstance(value, dict) else None

        return texts.map(one)

    return run


def renumbered_markers(text: Column, order: list[int]) -> Column:
    """<img-N> markers rewritten for references in a new order: old number order[k] becomes k + 1; done over placeholders, so numbers cannot collide."""
    out = text
    for new, old in enumerate(order, 1):
        out = F.regexp_replace(out, f"<img-{old}>", f"<img#{new}>")
    return F.regexp_replace(out, r"<img#(\d+)>", "<img-$1>")


def vision_tokens(frames: Column, height: Column, width: Column, spatial: int, patch: int, temporal: int, floor: bool = True) -> Column:
    """Tokens of a clip: latent frames times patches plus two; patches are floored, or of the latent rounded up."""
    side = (lambda x: F.floor(x / (spatial * patch))) if floor else (lambda x: F.ceil(F.floor(x / spatial) / patch))
    return (1 + F.floor((frames - 1) / temporal)) * side(height) * side(width) + 2


def pixels_of_tokens(tokens: Column, patch: int = 14, temporal: int = 2, merge: int = 2) -> Column:
    return tokens * (patch * merge) ** 2 * temporal


def tokens_of_pixels(pixels: Column, patch: int = 14, temporal: int = 2, merge: int = 2) -> Column:
    return F.floor(F.floor(pixels / (patch * merge) ** 2) / temporal)


def capped_size(width: Column, height: Column, max_pixels: int, step: int) -> tuple[Column, Column]:
    """(width, height) scaled to at most max_pixels and rounded down to multiples of ``step``, at least one step each."""
    scale = F.least(F.lit(1.0), F.sqrt(F.lit(float(max_pixels)) / (width * height)))
    side = lambda x: F.greatest(F.lit(step), F.floor(F.floor(x * scale) / step) * step)
    return side(width), side(height)


def assistant_mask(tokens: Column, start: int, end: int, assistant: int) -> Column:
    """For each token whether it is learnt: from three places after a start marker whose role is the assistant's, to the end marker that closes it."""
    n = F.size(tokens)
    at = F.sequence(F.lit(1), n)
    begins = F.filter(at, lambda i: F.element_at(tokens, i) == start)
    stops = F.filter(at, lambda i: F.element_at(tokens, i) == end)
    spans = F.filter(F.zip_with(begins, stops, lambda b, e: F.struct(b.alias("b"), e.alias("e"))), lambda s: F.try_element_at(tokens, s["b"] + 1) == assistant)
    return F.when(n > 0, F.transform(at, lambda i: F.exists(spans, lambda s: (i >= s["b"] + 3) & (i <= s["e"])))).otherwise(F.array().cast("array<boolean>"))
