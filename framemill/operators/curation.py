"""Filters that say why: drop reasons in a fixed order, keywords, sizes, buckets and word lists."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that holds, null where none does; a null condition does not hold."""
    out = None
    for name, cond in checks:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out if out is not None else F.lit(None).cast("string")


def reason_counts(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """(reason, n) of dropped rows, the most frequent first, names breaking ties."""
    return rows.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(reason))


def has_keyword(text: Column, keywords: list[str]) -> Column:
    """Whether any keyword is a substring, whatever the case; one alternation, evaluated once per row."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(k.lower()) for k in keywords], F.lit(False))


def keyword_pass(text: Column, keywords: list[str], include: bool, bypass: Column | None = None) -> Column:
    """Include mode keeps texts with a keyword, exclude mode those without; blank and null texts, and bypassed rows, pass."""
    found = has_keyword(text, keywords)
    ok = F.coalesce(F.trim(text) == "", F.lit(True)) | (found if include else ~found)
    return ok if bypass is None else F.coalesce(bypass, F.lit(False)) | ok


def below_tier(width: Column, height: Column, min_width: Column, min_height: Column) -> Column:
    """Too small only when both sides are below the tier's minimum."""
    return (width < min_width) & (height < min_height)


def bucket_range(path: Column) -> tuple[Column, Column]:
    """(lower, upper) frame counts coded in a path as frames_A_B, frames_A_inf or frames_gt_A; nulls where there is none, infinity for an open end."""
    lo = F.regexp_extract(path, r"frames_(\d+)_(\d+|inf)(?!\w)", 1)
    hi = F.regexp_extract(path, r"frames_(\d+)_(\d+|inf)(?!\w)", 2)
    gt = F.regexp_extract(path, r"frames_gt_(\d+)", 1)
    inf = F.lit(float("inf"))
    lower = F.when(lo != "", lo.try_cast("double")).when(gt != "", gt.try_cast("double"))
    upper = F.when(hi == "inf", inf).when(hi != "", hi.try_cast("double")).when(gt != "", inf)
    return lower, upper


def bucket_kept(path: Column, min_frames: int | None = None, max_frames: int | None = None, skip: list[tuple[float, float]] = ()) -> Column:
    """Whether a bucket stays: its upper bound is above ``min_frames`` (exclusive) and at most ``max_frames``; no bucket in the path stays."""
    lower, upper = bucket_range(path)
    ok = F.lit(True)
    if min_frames is not None:
        ok = ok & (upper > min_frames)
    if max_frames is not None:
        ok = ok & (upper <= max_frames)
    for a, b in skip:
        ok = ok & ~((lower == a) & (upper == b))
    return upper.isNull() | ok


def folded(text: Column) -> Column:
    """Lower case, runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def word_match(text: Column, words: list[str]) -> Column:
    """The first listed word or phrase that stands in the text as whole words; null where none does."""
    out = None
    for w in words:
        cond = F.concat(F.lit(" "), F.regexp_replace(folded(text), r"[^\w]+", " "), F.lit(" ")).contains(" " + re.sub(r"\W+", " ", w.lower()).strip() + " ")
        out = F.when(cond, w) if out is None else out.when(cond, w)
    return out if out is not None else F.lit(None).cast("string")


def fuzzy_match(rows: DataFrame, row_id: str, text: str, words: list[str], letters: float = 1.0, least: int = 6) -> DataFrame:
    """(row_id, word) where a stretch of as many words as the listed phrase is as similar to it as ``letters`` differing letters allow.

    Similarity is the matching-blocks ratio; it must reach (n - letters) / n for a phrase of n letters.
    Phrases under ``least`` letters are left to the exact match. The word list is a bounded argument.
    """
    targets = [(re.sub(r"\s+", " ", w.lower()).strip(), w) for w in words if len(w) >= least]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[tuple[str, str], bool] = {}

        def close(part: str, target: str) -> bool:
            key = (part, target)
            if key not in memo:
                if len(memo) > 200_000:
                    memo.clear()
                bar = (len(target) - letters) / len(target)
                m = difflib.SequenceMatcher(None, part, target, autojunk=False)
                memo[key] = m.real_quick_ratio() >= bar and m.quick_ratio() >= bar and m.ratio() >= bar
            return memo[key]

        for pdf in batches:
            out = []
            for rid, t in zip(pdf[row_id].tolist(), pdf[text]):
                tokens = re.sub(r"\s+", " ", (t or "").lower()).split()
                for target, word in targets:
                    n = len(target.split())
                    if any(close(" ".join(tokens[i : i + n]), target) for i in range(len(tokens) - n + 1)):
                        out.append((rid, word))
            yield pd.DataFrame(out, columns=[row_id, "word"]).astype({row_id: "Int64"})

    return rows.select(row_id, text).mapInPandas(run, f"{row_id} bigint, word string")


def masked_words(text: Column, words: list[str], allowed: list[str] = (), mask: str = "****") -> Column:
    """Listed words replaced by a mask, words of the allow list left as they are."""
    listed = [w.lower() for w in words if w.lower() not in {a.lower() for a in allowed}]
    bare = lambda w: F.lower(F.regexp_replace(w, r"^\W+|\W+$", ""))
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.when(bare(w).isin(listed), F.lit(mask)).otherwise(w)), " ")


def length_rule(tokens: Column, limit: int, media: list[str]) -> tuple[Column, Column]:
    """(kept, tokens): too long sequences are cut at ``limit`` unless a media token stands in the part cut off."""
    tail = F.slice(tokens, limit + 1, F.greatest(F.lit(1), F.size(tokens) - limit))
    lost = (F.size(tokens) > limit) & F.exists(tail, lambda t: t.isin(media))
    return ~lost, F.slice(tokens, 1, limit)


def kept_boxes(boxes: list[tuple[float, float, float, float, float]], confidence: float, overlap: float, top_k: int, keep: int) -> list[int]:
    """Indexes of detected boxes (x1, y1, x2, y2, score) after confidence, top-k, overlap suppression and keep-k."""
    order = sorted((i for i, b in enumerate(boxes) if b[4] > confidence), key=lambda i: -boxes[i][4])[:top_k]
    chosen: list[int] = []

    def area(b):
        return max(0.0, b[2] - b[0] + 1) * max(0.0, b[3] - b[1] + 1)

    for i in order:
        a = boxes[i]
        clear = True
        for j in chosen:
            b = boxes[j]
            w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]) + 1)
            h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]) + 1)
            if w * h / (area(a) + area(b) - w * h) > overlap:
                clear = False
                break
        if clear:
            chosen.append(i)
    return chosen[:keep]


def violations(rows: DataFrame, rules: dict[str, Column], row_id: list[str]) -> DataFrame:
    """(row_id, rule) for every rule that a row breaks; a rule is a condition that should hold, null counts as broken."""
    checks = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in rules.items()]))
    return rows.select(*row_id, F.explode(checks).alias("rule"))
