"""Held-out texts that leaked into a corpus: spaced-seed hashing and exact verification."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framemill.session import broadcast_if_small, spread, stored

#: Shortest passage, in words of the item, and one edit is allowed for each so many of them.
MIN_WORDS = 12
WORDS_PER_EDIT = 8
#: Edits of a shortest passage: one of 2 * MIN_WORDS words or more holds a shorter one.
MOST_EDITS = (2 * MIN_WORDS - 1) // WORDS_PER_EDIT

#: Positions that a mask compares; it ignores those between, whatever word stands there. A shortest passage has at most two edits in 23 words,
#: or one in 15, so that some five words in a row are untouched: the first mask, which spans five, misses none of them.
#: The second one reaches over a changed word and its neighbour.
MASKS = ((0, 1, 3, 4), (0, 1, 2, 5, 6, 7))
#: Seeds that any passage shares with its item: with one edit in 12 words the runs beside it hold three places of the first mask, with two in 16
#: the runs are no shorter than 5, 5 and 4 words together and hold two.
LEAST_SEEDS = 2
#: Words on each side of a seed that a shortest passage around it may reach, its added words included.
REACH = 2 * MIN_WORDS + MOST_EDITS
#: Bits for each seed of an item in the filter that corpus seeds pass before they are shuffled, and the most bits of all.
FILTER_BITS, MOST_BITS = 32, 1 << 27
#: Seeds of items with one hash that meet the corpus in one task; more are split over slices.
SLICE = 1000

_ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]\w{1,30});")
#: Invisible characters beside those that combine: joiners, marks of direction, variation selectors, tags.
_HIDDEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\U000e0000-\U000e007f]")
#: Characters inside angle brackets from which they are a tag only with an attribute.
LONG_TAG = 200
_CHUNK = 1 << 20
_WORD_CHAR, _DROPPED = 1, 2


def without_markup(text: str) -> str:
    """The text with a blank for each tag and comment of any length; a ``<`` that opens neither stays."""
    out, at = [], 0
    while True:
        i = text.find("<", at)
        if i < 0:
            out.append(text[at:])
            return "".join(out)
        if text.startswith("<!--", i):
            j = text.find("-->", i + 4)
            end = j + 3 if j >= 0 else -1
        else:
            name = text[i + 1 : i + 3].lstrip("/")[:1]
            j, k = text.find(">", i), text.find("<", i + 1)
            end = j + 1 if j >= 0 and (k < 0 or j < k) and name.isascii() and name.isalpha() else -1
            if end - i > LONG_TAG and "=" not in text[i:j]:
                end = -1
        if end < 0:
            out.append(text[at : i + 1])
            at = i + 1
        else:
            out.append(text[at:i] + " ")
            at = end


def plain(text: str | None) -> str:
    """A text without mark-up and case, its characters decomposed.

    Compatibility forms are folded (full-width letters, ligatures).
    """
    if not text:
        return ""
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    if "<" in text:
        text = without_markup(text)
    return text.lower() if text.isascii() else unicodedata.normalize("NFKD", text).casefold()


class _Kinds:
    """Which code points belong to words, and which count for nothing; looked up once for each that occurs."""

    def __init__(self) -> None:
        self.kind = np.zeros(0x110000, np.uint8)
        self.known = np.zeros(0x110000, bool)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        there = np.bincount(points, minlength=1) > 0
        for p in np.flatnonzero(there & ~self.known[: len(there)]).tolist():
            c = chr(p)
            self.known[p] = True
            self.kind[p] = _DROPPED if unicodedata.combining(c) or _HIDDEN.match(c) else _WORD_CHAR * c.isalnum()
        return self.kind[points]


_kinds = _Kinds()
_weights = np.random.default_rng(7).integers(1, 1 << 63, 1 << 12, dtype=np.uint64) | np.uint64(1)


def coded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, owner): 64-bit hashes of the words of all texts, and the text of each.

    Words go without case, accents, punctuation, mark-up and invisible characters. An apostrophe joins nothing:
    "it's" is two words, in items and documents alike. A word broken by a hyphen at a line end stays
    two words, as a hyphenated word is two.
    """
    clean = [plain(t) for t in texts]
    points = np.frombuffer(("\n".join(clean) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds(points)
    kept = np.flatnonzero(kind != _DROPPED)
    letter = kind[kept] == _WORD_CHAR
    inside = np.flatnonzero(letter)
    first = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    if not len(first):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.searchsorted(inside, first)
    place = np.arange(len(inside)) - np.repeat(at, np.diff(np.append(at, len(inside))))
    total = np.add.reduceat((points[kept[inside]].astype(np.uint64) + np.uint64(1)) * _weights[place & 0xFFF], at)
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    size = np.array([len(t) + 1 for t in clean], np.int64)
    return total ^ (total >> np.uint64(29)), np.searchsorted(np.cumsum(size), kept[first], "right")


def seeds(codes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of the masked positions at every place where the mask fits."""
    n = len(codes) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, len(mask) * 0x9E3779B97F4A7C15 + mask[-1] & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in mask:
        out = (out ^ codes[at : at + n]) * np.uint64(0x100000001B3) + np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def all_seeds(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of every seed that lies within one text, of all masks."""
    found = []
    for mask in MASKS:
        h = seeds(codes, mask)
        at = np.flatnonzero(owner[: len(h)] == owner[mask[-1] :][: len(h)])
        found.append((h[at], at))
    return np.concatenate([h for h, _ in found]), np.concatenate([at for _, at in found])


def holds_passage(item: np.ndarray, doc: np.ndarray) -> bool:
    """Whether ``doc`` holds a passage of ``item`` of MIN_WORDS words or more with at most one edit in WORDS_PER_EDIT words.

    An edit changes, adds or drops a word. Dynamic programme over (item word, document word): the
    longest passage ending there for each number of edits; a row of the table is one numpy step. Two
    edits are enough: of a passage of 24 words or more one half is again within one edit in
    WORDS_PER_EDIT words, so a shortest such passage has at most 23 words.
    """
    n, m = len(item), len(doc)
    if n < MIN_WORDS or m < MIN_WORDS - MIN_WORDS // WORDS_PER_EDIT:
        return False
    most = min(n // WORDS_PER_EDIT, MOST_EDITS)
    low = -(1 << 20)
    # longest[e][j]: item words in the longest passage that ends at this item word and document word j with e edits
    before = np.full((most + 1, m + 1), low)
    before[0] = 0
    for i in range(n):
        same = doc == item[i]
        now = np.full((most + 1, m + 1), low)
        now[:, 1:] = np.where(same[None, :], before[:, :-1] + 1, low)
        if most:
            np.maximum(now[1:, 1:], before[:-1, :-1] + 1, out=now[1:, 1:])  # changed word
            np.maximum(now[1:], before[:-1] + 1, out=now[1:])  # dropped word
            for e in range(1, most + 1):  # added word
                np.maximum(now[e, 1:], now[e - 1, :-1], out=now[e, 1:])
        np.maximum(now[0], 0, out=now[0])
        for e in range(most + 1):
            if now[e].max() >= max(MIN_WORDS, WORDS_PER_EDIT * e):
                return True
        before = now
    return False


def _straight(item: np.ndarray, doc: np.ndarray, shift: int) -> bool:
    """The same for changed words only, along one diagonal (document place minus item place)."""
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    if b - a < MIN_WORDS:
        return False
    same = item[a:b] == doc[a + shift : b + shift]
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, 1 - WORDS_PER_EDIT))])
    reach = np.minimum.accumulate(score)[: len(score) - MIN_WORDS]
    return bool((score[MIN_WORDS:] >= reach).any())


def verified(item: np.ndarray, doc: np.ndarray, shifts: np.ndarray) -> bool:
    """Whether a passage exists around the seeds of one item in a stretch of a document; ``shifts`` are their places less those in the item."""
    if any(_straight(item, doc, int(x)) for x in shifts):
        return True
    # what is left needs added or dropped words: stretches of the document around plausible shifts
    likely = [int(x) for x in shifts if _plausible(item, doc, int(x))]
    slack = MOST_EDITS + 1
    spans: list[list[int]] = []
    for shift in sorted(likely):
        begin, end = max(0, shift - slack), min(len(doc), shift + len(item) + slack)
        if spans and begin <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([begin, end])
    return any(holds_passage(item, doc[begin:end]) for begin, end in spans)


def _plausible(item: np.ndarray, doc: np.ndarray, shift: int) -> bool:
    """Whether MIN_WORDS item words in a row have all but MOST_EDITS of them in the document at about this shift.

    A shortest passage (see ``holds_passage``) has a seed, at most two edits, and so all but two words of
    any MIN_WORDS of its words at most two places from the seed's shift.
    """
    n = len(item)
    wide = np.zeros(n + 2 * MOST_EDITS, np.uint64)
    there = np.zeros(len(wide), bool)
    lo = shift - MOST_EDITS
    a, b = max(0, lo), min(len(doc), lo + len(wide))
    wide[a - lo : b - lo] = doc[a:b]
    there[a - lo : b - lo] = True
    near = np.zeros(n, bool)
    for k in range(2 * MOST_EDITS + 1):
        near |= (wide[k : k + n] == item) & there[k : k + n]
    total = np.concatenate([[0], np.cumsum(near)])
    return bool((total[MIN_WORDS:] - total[:-MIN_WORDS]).max(initial=0) >= MIN_WORDS - MOST_EDITS)


def _pieces(texts: list) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about _CHUNK characters together."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= _CHUNK):
            size += len(texts[hi] or "")
            hi += 1
        yield lo, hi
        lo = hi


def item_codes(items: DataFrame) -> DataFrame:
    """(item, item_id, codes) of the distinct items that have a passage; ``item`` numbers them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes, owner = coded(pdf["text"].tolist())
            cut = np.searchsorted(owner, np.arange(len(pdf) + 1))
            kept = [k for k in range(len(pdf)) if cut[k + 1] - cut[k] >= MIN_WORDS]
            yield pd.DataFrame({"item": pdf["item"].iloc[kept], "item_id": pdf["item_id"].iloc[kept].astype("Int64"), "codes": [codes[cut[k] : cut[k + 1]].view(np.int64) for k in kept]})

    wanted = items.where("text is not null and item_id is not null").select("item_id", "text").distinct()
    return stored(wanted.select(F.monotonically_increasing_id().alias("item"), "item_id", "text").mapInPandas(run, "item bigint, item_id bigint, codes array<bigint>"), "items")


def item_seeds(items: DataFrame) -> DataFrame:
    """(hash, item, place) of all seeds of the items, stored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = np.array([len(c) for c in pdf["codes"]], np.int64)
            codes = np.concatenate([np.asarray(c, np.int64) for c in pdf["codes"]] or [np.empty(0, np.int64)]).view(np.uint64)
            owner = np.repeat(np.arange(len(pdf)), sizes)
            h, at = all_seeds(codes, owner)
            yield pd.DataFrame({"hash": h.view(np.int64), "item": pdf["item"].to_numpy()[owner[at]], "place": (at - (np.cumsum(sizes) - sizes)[owner[at]]).astype(np.int32)})

    return stored(items.select("item", "codes").mapInPandas(run, "hash bigint, item bigint, place int"), "seeds")


def probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The places of hashes in a filter of ``bits`` (a power of two), one after another."""
    for odd in _PROBES:
        yield (h * odd >> np.uint64(65 - bits.bit_length())).astype(np.int64)


_PROBES = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def bit_filter(known: DataFrame) -> np.ndarray:
    """A Bloom filter of the hashes of the items' seeds, packed; at most MOST_BITS, whatever the number of items."""
    n = known.count()
    bits = min(MOST_BITS, max(1 << 10, 1 << (FILTER_BITS * max(1, n) - 1).bit_length()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.unique(np.concatenate(list(probes(pdf["hash"].to_numpy(np.int64).view(np.uint64), bits))))
            word, first = np.unique(at >> 5, return_index=True)
            yield pd.DataFrame({"word": word, "set": np.bitwise_or.reduceat(1 << (at & 31), first) if len(at) else at})

    words = known.select("hash").mapInPandas(run, "word bigint, set bigint").groupBy("word").agg(F.bit_or("set").alias("set")).toPandas()
    packed = np.zeros(bits >> 5, np.uint32)
    packed[words["word"].to_numpy(np.int64)] = words["set"].to_numpy(np.int64).astype(np.uint32)
    return packed


def passes(packed: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets pass (places in ``h``): all that are in it, and few others."""
    left = np.arange(len(h))
    for odd in _PROBES:
        bit = (h[left] * odd >> np.uint64(65 - (len(packed) << 5).bit_length())).astype(np.int64)
        left = left[packed[bit >> 5] >> (bit & 31).astype(np.uint32) & np.uint32(1) == 1]
    return left


HITS = "doc_id bigint, codes array<bigint>, hashes array<bigint>, places array<int>"


def _hits(shared):
    """mapInPandas function: stretches of documents around seeds that pass the filter, with those seeds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packed = shared.value
        for pdf in batches:
            texts, ids = pdf["text"].tolist(), pdf["doc_id"].astype("Int64")
            for lo, hi in _pieces(texts):
                codes, owner = coded(texts[lo:hi])
                h, at = all_seeds(codes, owner)
                ok = passes(packed, h)
                h, at = h[ok], at[ok]
                order = np.argsort(at, kind="stable")
                h, at = h[order], at[order]
                if not len(at):
                    continue
                # seeds whose surroundings touch share a stretch
                new = np.flatnonzero(np.concatenate([[True], (owner[at[1:]] != owner[at[:-1]]) | (at[1:] - at[:-1] > 2 * REACH)]))
                until = np.append(new[1:], len(at))
                first = np.searchsorted(owner, np.arange(hi - lo + 1))
                begin = np.maximum(at[new] - REACH, first[owner[at[new]]])
                end = np.minimum(at[until - 1] + REACH, first[owner[at[new]] + 1])
                signed, keys = codes.view(np.int64), h.view(np.int64)
                yield pd.DataFrame({
                    "doc_id": ids.iloc[lo + owner[at[new]]].array, "codes": [signed[a:b] for a, b in zip(begin, end)],
                    "hashes": [keys[a:b] for a, b in zip(new, until)], "places": [(at[a:b] - c).astype(np.int32) for a, b, c in zip(new, until, begin)],
                })

    return run


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ok = []
        for item, doc, shifts in zip(pdf["item_codes"], pdf["codes"], pdf["shifts"]):
            ok.append(verified(np.asarray(item, np.int64).view(np.uint64), np.asarray(doc, np.int64).view(np.uint64), np.sort(np.asarray(shifts, np.int64))))
        out = pdf.loc[np.array(ok, bool), ["doc_id", "item_id"]]
        yield out.astype({"doc_id": "Int64", "item_id": "Int64"})


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) where the document holds a passage of the item.

    ``documents`` has doc_id and text, ``items`` item_id and text. Both sides are cut into seeds, which are joined by
    their hash. Most corpus seeds meet no item: a filter of bounded size, made from the hashes of the items' seeds, leaves
    those out where they arise, so the corpus is not shuffled; the filter has no false negatives, and where more items fill it up only
    more seeds go into the join. A hash that very many items share is split over slices. What is joined are the seeds' places;
    each document's stretch around them meets the items found there, with as many seeds as any passage has, once, to be verified exactly, changed, added and
    dropped words included. Every partner is found: seeds have no cap. Null and empty texts hold nothing;
    items of fewer than 12 words have no passage. Repeated documents and items with their ids each
    give a row. Texts are read whole. Empty tables give no rows.
    """
    wanted = item_codes(items)
    known = item_seeds(wanted)
    shared = documents.sparkSession.sparkContext.broadcast(bit_filter(known))
    read = spread(documents.select("doc_id", "text"))
    hits = stored(read.mapInPandas(_hits(shared), HITS).withColumn("stretch", F.monotonically_increasing_id()), "hits")
    crowded = broadcast_if_small(known.groupBy("hash").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices")).where("slices > 1"), 48)
    slice_of = F.coalesce(F.pmod(F.xxhash64("item", "place"), "slices"), F.lit(0)).cast("int")
    there = known.join(crowded, "hash", "left").select("hash", slice_of.alias("slice"), "item", F.col("place").alias("item_place"))
    seen = hits.select("stretch", F.explode(F.arrays_zip("hashes", "places")).alias("s")).select("stretch", F.col("s.hashes").alias("hash"), F.col("s.places").alias("place"))
    seen = seen.join(crowded, "hash", "left").select("stretch", "hash", "place", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("slices") - 1, F.lit(0)))).alias("slice"))
    pairs = seen.join(there, ["hash", "slice"]).groupBy("stretch", "item").agg(F.collect_set(F.col("place") - F.col("item_place")).alias("shifts"), F.count(F.lit(1)).alias("n"))
    pairs = pairs.where(F.col("n") >= LEAST_SEEDS).drop("n")
    both = pairs.join(hits.select("stretch", "doc_id", "codes"), "stretch").join(wanted.withColumnRenamed("codes", "item_codes"), "item")
    return both.select("doc_id", "item_id", "codes", "item_codes", "shifts").mapInPandas(_verify, "doc_id bigint, item_id bigint").distinct()
