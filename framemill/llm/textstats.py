"""Statistics of whole texts for a batch at a time: array passes over all characters, words and lines."""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import xxhash

# Frequent function words of some languages, and the signs of Chinese that serve as such.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if when will would who so no what up into than them only some could these then now its over such our after also did many before must through where much your down should because each just those people how too any while under until near between along across without behind beside inside here".split(),
    "fr": "le la les de des du un une et en est que qui dans pour pas sur au aux avec ce se il elle sont par plus ne son sa ses ou mais comme tout nous vous leur cette sans sous à l d s n".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis ohne unter neben während bevor".split(),
    "es": "el la los las de del un una y en que a por con no se su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy antes bajo mientras".split(),
}
COMMON_SIGNS = "的一是不在了有和人这中上个把到没在被与及并从也为对以于就后前里着过地得"

#: Statistics, in the order of the result.
STATS = (
    "n_chars", "n_words", "n_lines", "mean_word_len", "alpha_ratio", "digit_ratio", "symbol_ratio", "space_ratio",
    "line_end_ratio", "common_share", "distinct_share", "repeat_ratio", "mean_line_words", "prose_share", "item_share",
    "field_share", "sentence_share", "run_share", "odd_ratio", "long_share", "compress_ratio", "item_lines", "field_lines",
)

#: Characters of all texts that one array pass takes; a longer text is a pass of its own.
PASS_CHARS = 1 << 20
#: Words of a line without a final sign up to which it is a label.
LABEL_WORDS = 8
#: Words from which a line of several sentences is running text, whatever sign it begins with.
LONG_ITEM = 25
#: Characters without a blank from which a run is no word of any language.
LONG_RUN = 31

_BULLET = re.compile(r"\s*(?:[-*+•‣◦▪·–—]|\d{1,3}[.)]|\([A-Za-z0-9]{1,3}\)|[A-Za-z][.)]|\[[ xX✓✔]\]|[☐☑✓✔])\s+(?=\S)")
_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
_RULE = re.compile(r"[\s|+:=\-_─-╿]+")
_GAP = re.compile(r" {2,}|\t")
_QUOTED = re.compile(r"\"[^\"]*\"")
_ROW_TAGS = ("<tr", "<td", "<th", "</tr", "<table", "</table", "<tbody", "</tbody", "<thead", "</thead")

# Flags of a character.
_LET, _DIG, _SPC, _ODD, _WORD, _NUM, _CJK, _RUN, _STOP, _WIDE_STOP, _CLOSE, _COLON, _PAUSE, _WIDE_PAUSE = (1 << i for i in range(14))


class Characters:
    """Flags and lower-case forms of code points, looked up once for each that occurs."""

    def __init__(self) -> None:
        self.flags = np.zeros(0x110000, np.uint16)
        self.lower = np.zeros(0x110000, np.uint32)
        self.known = np.zeros(0x110000, bool)

    def learn(self, points: np.ndarray) -> None:
        there = np.bincount(points, minlength=1) > 0
        for p in np.flatnonzero(there & ~self.known[: len(there)]).tolist():
            self.known[p] = True
            self.flags[p], self.lower[p] = _flags(p)


def _flags(p: int) -> tuple[int, int]:
    c = chr(p)
    kind = unicodedata.category(c)
    cjk = 0x3040 <= p <= 0x30FF or 0x3400 <= p <= 0x9FFF or 0xAC00 <= p <= 0xD7AF
    f = _LET * c.isalpha() | _DIG * c.isdigit() | _SPC * c.isspace() | _CJK * cjk | _NUM * c.isdecimal() | _WORD * (c.isalnum() and not c.isdecimal())
    f |= _ODD * ((kind[0] == "C" and kind != "Cf" and c not in "\t\n\r") or p == 0xFFFD)
    f |= _RUN * (not c.isspace() and not cjk and not 0x3000 <= p <= 0x303F and not 0xFF00 <= p <= 0xFFEF)
    f |= _STOP * (c in ".!?…") | _WIDE_STOP * (c in "。！？") | _COLON * (c in ":：") | _CLOSE * (c in "\"'”’»)]*_`")
    f |= _PAUSE * (c in ".?!,:;") | _WIDE_PAUSE * (c in "。？！，")
    low = c.lower()
    return f, ord(low) if len(low) == 1 else p


_characters = Characters()
_weights = np.random.default_rng(20).integers(1, 1 << 63, 1 << 12, dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Words:
    """The characters of some texts, each text followed by a line break, and their words."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        joined = "\n".join(texts) + "\n"
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        _characters.learn(self.points)
        self.flags = _characters.flags[self.points]
        self.lower = _characters.lower[self.points]
        self.length = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(self.length + 1) - self.length - 1
        self._cut()

    def _cut(self) -> None:
        """Words: runs of letters, joined by an apostrophe or hyphen; numbers; single signs of scripts without blanks."""
        f, p = self.flags, self.points
        kind = np.where(f & _NUM, 2, np.where(f & _WORD, np.where(f & _CJK, 3, 1), 0)).astype(np.uint8)
        joins = np.flatnonzero((p == 39) | (p == 0x2019) | (p == 45) | (p == 46) | (p == 44))
        joins = joins[(joins > 0) & (joins + 1 < len(p))]
        left, right = kind[joins - 1], kind[joins + 1]
        number = (p[joins] == 46) | (p[joins] == 44)
        fit = (left == right) & np.where(number, left == 2, left == 1)
        kind[joins[fit]] = left[fit]
        inside = np.flatnonzero(kind)
        k = kind[inside]
        first = np.ones(len(inside), bool)
        first[1:] = (k[1:] != k[:-1]) | (inside[1:] != inside[:-1] + 1) | (k[1:] == 3)
        at = np.flatnonzero(first)
        self.start = inside[at]
        self.size = np.diff(np.append(at, len(inside)))
        place = np.arange(len(inside)) - np.repeat(at, self.size)
        piece = (self.lower[inside].astype(np.uint64) + np.uint64(1)) * _weights[place & 0xFFF]
        self.hash = _mixed(np.add.reduceat(piece, at)) if len(at) else np.empty(0, np.uint64)
        self.doc = np.searchsorted(self.begin, self.start, "right") - 1

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """Number of marked characters of each text."""
        return _between(mask, self.begin, self.begin + self.length)


def _between(mask: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Number of marked characters from each ``lo`` up to its ``hi``."""
    at = np.flatnonzero(mask)
    return np.searchsorted(at, hi) - np.searchsorted(at, lo)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.sort(Words(words).hash)


_common: np.ndarray | None = None


def common_hashes() -> np.ndarray:
    global _common
    if _common is None:
        _common = np.unique(word_hashes([w for words in COMMON.values() for w in words] + list(COMMON_SIGNS)))
    return _common


def _different(doc: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Number of different keys of each text."""
    joint = np.sort((doc.astype(np.uint64) << np.uint64(43)) | (keys >> np.uint64(21)))
    new = np.ones(len(joint), bool)
    new[1:] = joint[1:] != joint[:-1]
    return np.bincount((joint[new] >> np.uint64(43)).astype(np.int64), minlength=n)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(whole > 0, part / np.maximum(whole, 1), 0.0)


def _pass(texts: list[str]) -> dict[str, np.ndarray]:
    """All statistics of texts of one array pass; code between fences counts as text but not for the structure."""
    w, n = Words(texts), len(texts)
    size = w.length
    m = np.bincount(w.doc, minlength=n)
    letters, digits, spaces = (w.per_text(w.flags & f > 0) for f in (_LET, _DIG, _SPC))
    known = common_hashes()
    common = known[np.minimum(np.searchsorted(known, w.hash), len(known) - 1)] == w.hash
    pairs = w.doc[1:] == w.doc[:-1]
    pair_keys = _mixed(w.hash[:-1] * np.uint64(3) + w.hash[1:])[pairs]
    change = np.ones(len(w.hash), bool)
    change[1:] = (w.hash[1:] != w.hash[:-1]) | ~pairs
    at = np.flatnonzero(change)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, w.doc[at], np.diff(np.append(at, len(change))))
    run = w.flags & _RUN > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], run, [False]]).astype(np.int8)))
    first, stop = edge[::2], edge[1::2]
    far = stop - first >= LONG_RUN
    long = np.bincount(np.searchsorted(w.begin, first[far], "right") - 1, weights=(stop - first)[far], minlength=n)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    out = {
        "n_chars": size, "n_words": m, "mean_word_len": _share(np.bincount(w.doc, weights=w.size, minlength=n), m),
        "alpha_ratio": _share(letters, size), "digit_ratio": _share(digits, size), "space_ratio": _share(spaces, size),
        "symbol_ratio": _share(np.maximum(0, size - letters - digits - spaces), size),
        "common_share": _share(np.bincount(w.doc, weights=common, minlength=n), m),
        "distinct_share": _share(_different(w.doc, w.hash, n), m),
        "repeat_ratio": np.where(m > 1, 1 - _share(_different(w.doc[1:][pairs], pair_keys, n), m - 1), 0.0),
        "run_share": np.where(m > 1, _share(longest, m), 0.0),
        "odd_ratio": _share(w.per_text(w.flags & _ODD > 0), size), "long_share": _share(long, size),
        "compress_ratio": np.array([len(zlib.compress(r, 6)) / len(r) if r else 0.0 for r in raw]),
    }
    out |= _structure(w)
    fenced = [i for i, t in enumerate(texts) if "```" in t or "~~~" in t]
    if fenced:
        for name, v in _structure(Words([_FENCE.sub("\n", texts[i]) for i in fenced]), m[fenced]).items():
            out[name][fenced] = v
    out["mean_line_words"] = _share(m, out["n_lines"])
    return {k: out[k].astype(np.float64) for k in STATS}


def _structure(w: Words, words: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Shares of the words, and of the lines, that stand in running text, separate items and rows of fields.

    A line is an item when it begins with a list sign, or is a label: a few words without a final sign, not
    the wrapped end of a sentence. Labels in a row are items, unless sentences run on from line to line.
    """
    f, p, n = w.flags, w.points, len(w.texts)
    total = np.bincount(w.doc, minlength=n) if words is None else words
    ends = np.flatnonzero(p == 10)
    begins = np.concatenate([[0], ends[:-1] + 1])
    solid = np.flatnonzero(f & _SPC == 0)
    opens = np.searchsorted(solid, begins)
    there = np.searchsorted(solid, ends) > opens
    begins, ends, opens = begins[there], ends[there], opens[there]
    doc = np.searchsorted(w.begin, begins, "right") - 1
    n_lines = np.bincount(doc, minlength=n)
    zero = np.zeros(n)
    if not len(begins):
        return {k: zero.copy() for k in ("n_lines", "line_end_ratio", "sentence_share", "prose_share", "item_share", "field_share", "item_lines", "field_lines")}
    # sentence signs: wide ones anywhere, others before a blank, a closing sign or a tag
    nxt = np.append(f[1:], _SPC)
    stop = (f & _WIDE_STOP > 0) | ((f & _STOP > 0) & ((nxt & (_SPC | _CLOSE) > 0) | (np.append(p[1:], 10) == 60)))
    last = np.full(n, -1)
    where = np.flatnonzero(stop)
    np.maximum.at(last, np.searchsorted(w.begin, where, "right") - 1, where)
    sentence = np.bincount(w.doc, weights=w.start <= last[w.doc], minlength=n)
    line = np.searchsorted(begins, w.start, "right") - 1
    count = np.bincount(line, minlength=len(begins))

    def furthest(mask: np.ndarray) -> np.ndarray:
        """The last marked character of each line, or -1."""
        at = np.flatnonzero(mask)
        if not len(at):
            return np.full(len(begins), -1)
        got = at[np.maximum(np.searchsorted(at, ends) - 1, 0)]
        return np.where((got >= begins) & (got < ends), got, -1)

    tail = furthest(f & (_SPC | _CLOSE) == 0)
    ended = (tail >= 0) & (f[tail] & (_STOP | _WIDE_STOP | _COLON) > 0)
    bound = furthest(f & _SPC == 0)
    # the first character that is neither blank nor a quote mark of the line
    body = np.flatnonzero((f & _SPC == 0) & (p != 62))
    first = body[np.minimum(np.searchsorted(body, begins), max(0, len(body) - 1))] if len(body) else begins
    head = np.where((first >= begins) & (first < ends), p[first], 0)
    opening = solid[opens]
    bullet = np.zeros(len(begins), bool)
    for i in np.flatnonzero((f[opening] & _NUM > 0) | np.isin(p[opening], _BULLET_HEADS)).tolist():
        at = w.begin[doc[i]]
        bullet[i] = _BULLET.match(w.texts[doc[i]], begins[i] - at, ends[i] - at) is not None
    bullet &= ~((count > LONG_ITEM) & (_between(stop, begins, ends) > 2))
    # a sign of a sentence or clause inside the line
    after = np.append(f[1:], _SPC)
    inner = ((f & _PAUSE > 0) & (after & _SPC > 0)) | ((f & _WIDE_PAUSE > 0) & (after & _SPC == 0))
    broken = _between(inner, begins, np.maximum(bound, begins)) > 0
    length = ends - begins
    order = np.lexsort((length, doc))
    upto = np.cumsum(n_lines) - n_lines
    middle = np.zeros(n, np.int64)
    middle[n_lines > 0] = length[order][(upto + n_lines // 2)[n_lines > 0]]
    wide = middle[doc]
    field = _rows_of_fields(w, begins, ends, doc, count)
    label = (count <= LABEL_WORDS) & ~((wide > 50) & (length > 0.7 * wide)) & ~field & ~bullet & (head != 35) & ~ended
    turn = np.ones(len(label), bool)
    turn[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
    group = np.cumsum(turn) - 1
    running = np.bincount(group, weights=broken) >= 0.2 * np.bincount(group)
    item = ~field & (bullet | (label & ~running[group]))
    out = {"n_lines": n_lines.astype(float), "line_end_ratio": _share(np.bincount(doc, weights=ended, minlength=n), n_lines), "sentence_share": _share(sentence, total)}
    inside = np.bincount(doc, weights=count, minlength=n)
    for name, mask in (("prose", ~item & ~field), ("item", item), ("field", field)):
        out[f"{name}_share"] = _share(np.bincount(doc, weights=count * mask, minlength=n), inside)
        out[f"{name}_lines"] = _share(np.bincount(doc, weights=mask, minlength=n), n_lines)
    del out["prose_lines"]
    return out


_BULLET_HEADS = np.array([ord(c) for c in "-*+•‣◦▪·–—([☐☑✓✔"] + [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"], np.uint32)


def _rows_of_fields(w: Words, begins: np.ndarray, ends: np.ndarray, doc: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which lines are rows of fields; texts with fewer than three lines that a separator could cut have none."""
    p, f = w.points, w.flags
    upto = lambda mask: _between(mask, begins, ends)
    nxt = np.append(p[1:], 10)
    blank = (p == 32) & (nxt == 32)
    cut = (p == 9) | (p == 124) | (p == 0x2502) | (p == 0x2503)
    tight = (p == 44) & ~(np.append(f[1:], _SPC) & _SPC > 0)
    could = (upto(cut) > 0) | (upto(p == 59) >= 2) | (upto(blank) >= 2) | (upto(tight) + (upto(p == 34) > 1) * upto(p == 44) >= 2) | (upto((p == 60) & ((nxt == 116) | (nxt == 84) | (nxt == 47))) > 0)
    field = np.zeros(len(begins), bool)
    for d in np.flatnonzero(np.bincount(doc, weights=could, minlength=len(w.texts)) >= 3).tolist():
        lo, hi = np.searchsorted(doc, d, "left"), np.searchsorted(doc, d, "right")
        at, text = w.begin[d], w.texts[d]
        field[lo:hi] = table_lines([text[begins[i] - at : ends[i] - at] for i in range(lo, hi)], count[lo:hi])
    return field


def _fields(line: str) -> dict[str, int]:
    """Number of fields of a line for each separator that could cut it."""
    bare = line.strip()
    low = bare[:8].lower()
    if low.startswith(_ROW_TAGS):
        low = bare.lower()
        return {"<td>": max(2, low.count("<td") + low.count("<th"))}
    outside = _QUOTED.sub('""', bare) if '"' in bare else bare
    found = {}
    for sep in "\t|│┃;,":
        n = outside.count(sep)
        if n:
            found["|" if sep in "│┃" else sep] = n + 1 - 2 * (bare[0] == sep and bare[-1] == sep and n > 1)
    gaps = len(_GAP.findall(bare))
    if gaps:
        found["  "] = gaps + 1
    return found


def table_lines(lines: list[str], counts: np.ndarray) -> list[bool]:
    """Which lines are rows of fields: lines cut by one separator into about as many fields as most lines it cuts.

    Commas and blanks also stand in prose, so there a field must be short and the row have three fields or more.
    ``counts`` has the words of each line.
    """
    found = [_fields(x) for x in lines]
    best: list[bool] = [False] * len(lines)
    for sep in sorted({k for f in found for k in f}):
        at = [i for i, f in enumerate(found) if sep in f]
        soft = sep in (",", "  ", ";")
        least = 3 if soft else 2
        usual = [found[i][sep] for i in at if found[i][sep] >= least]
        if not usual:
            continue
        usual = max(usual, key=lambda v: (usual.count(v), -usual.index(v)))
        near = [i for i in at if abs(found[i][sep] - usual) <= (2 if sep == "  " else 1) and found[i][sep] >= min(least, usual)]
        if soft:
            near = [i for i in near if counts[i] <= 5 * found[i][sep] and not (sep == "," and re.search(r",\s\w", _QUOTED.sub("", lines[i])))]
        if len(near) >= 3 and len(near) >= 0.6 * len(at) and len(near) > sum(best):
            best = [False] * len(lines)
            for i in near:
                best[i] = True
    if any(best):
        for i, x in enumerate(lines):
            if _RULE.fullmatch(x.strip()):
                best[i] = True
    return best


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """All statistics of texts, each over the whole of it; an empty text has zeros."""
    parts, lo = [], 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= PASS_CHARS):
            size += len(texts[hi]) + 1
            hi += 1
        parts.append(_pass(texts[lo:hi]))
        lo = hi
    return {k: np.concatenate([x[k] for x in parts]) if parts else np.empty(0) for k in STATS}
