"""Defects of question-answer pairs: empty, truncated, refusing, copied, or in another language."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framemill.functions.jsontext import INVISIBLE, is_blank, parse
from framemill.llm import language
from framemill.llm.language import SAMPLE_PER_LANGUAGE, LanguageModel
from framemill.llm.textstats import Words, _between, _mixed
from framemill.session import spread, stored

#: Share of occurrences of a word pair (or word) that must end a sentence for an unpunctuated end to pass.
END_SHARE = 0.02
#: Probability below which question and answer are not of one language, and the one that a text's likeliest language must have.
SAME_LANGUAGE, CONFIDENT = 0.5, 0.6

# Words that stand for no content, words that lead in a copy, and phrases with which a request is declined.
NO_CONTENT = {"null", "none", "nil", "nan", "na", "undefined", "empty", "tbd"}
LEAD_IN = {"sure", "caption", "prompt", "question", "answer", "here", "is", "the", "okay", "ok", "certainly", "of", "course", "description", "response"}
_ACTS = "(?:assist|help|provide|generate|create|write|describe|complete|fulfil|fulfill|comply|answer|produce|continue|discuss|expand|engage|share|support|process|caption|respond|do (?:that|this)|offer|give|make)"
REFUSALS = [
    rf"\bi(?:(?: am|'m)? (?:really |truly )?(?:cannot|can't|can not|could not|couldn't|won't|will not|not able to|unable to|not allowed to|would rather not|must refuse to|must decline to|have to decline to|decline to|refuse to)) (?:\w+ )?{_ACTS}\b",
    r"\bi (?:do not|don't) feel comfortable\b|\bi (?:must|have to|need to) (?:decline|refuse)\b",
    r"\bi'd rather not\b",
    rf"\bwe (?:cannot|can't|are unable to|are not able to|must decline to) {_ACTS}\b",
    r"\bas an? (?:ai|language|artificial)\b",
    r"\bsomething i(?:'m| am) (?:unable|not able)\b",
    r"\brequest (?:can't|cannot|can not) be (?:completed|fulfilled|processed)\b",
    r"\bno (?:description|caption|answer|response) (?:will|can) be (?:provided|given)\b",
    r"\bagainst my (?:guidelines|policy|policies|rules|principles)\b",
    r"\b(?:lo siento|lamento|disculpa)\b.*\bno puedo\b|^no puedo\b",
    r"\bje suis désolée?\b|\bdésolée?, (?:mais )?je\b|\bje ne peux pas (?:répondre|vous aider|aider)\b",
    r"\btut mir leid\b|\b(?:kann|darf) ich (?:leider )?nicht helfen\b|\bleider kann ich\b",
    r"抱歉|对不起|我无法|我不能|无法完成这个请求",
]
_REFUSAL = re.compile("|".join(REFUSALS))
_QUOTE = re.compile("[\"“„«「《]")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」|《[^》]*》")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_TERMINAL = re.compile(r"[.!?。！？…][\"'”’»)\]}*_`]*$|[\"”»」』]$")
_BULLET = re.compile(r"^\s*(?:[-*•+‣]|\d+[.)]|\([a-z0-9]\))\s+\S")


def texts_of(value) -> list[str]:
    """The texts in a JSON value, keys left out, in order."""
    if isinstance(value, str):
        return [] if is_blank(value) else [value]
    if isinstance(value, dict):
        value = list(value.values())
    if isinstance(value, list):
        return [t for v in value for t in texts_of(v)]
    return [] if value is None or isinstance(value, bool) else [str(value)]


def read_answer(answer: str | None) -> tuple[str, list[str], bool]:
    """(kind, texts, whole) of an answer: kind 'text' or 'json'; ``whole`` is False for JSON that breaks off."""
    bare = (answer or "").strip(INVISIBLE + " \t\r\n　 ")
    if not bare:
        return "text", [], True
    ok, value = parse(bare)
    if ok and isinstance(value, (dict, list)):
        return "json", texts_of(value), True
    inner = re.sub(r"^```[\w+-]*\s*", "", bare).lstrip()
    if inner[:1] in "{[" and re.match(r"[{\[]\s*(?:[\"{\[\]}]|$)", inner):
        return "json", [inner], False
    if len(bare) > 1 and bare[0] == bare[-1] == '"':
        bare = bare[1:-1]
    return "text", [bare], True


def has_content(texts: list[str]) -> bool:
    """Whether any text says something: letters or digits that are no word for nothing."""
    for text in texts:
        if len(text) > 32 and any(map(str.isalnum, text[:32])):
            return True
        words = "".join(filter(str.isalnum, unicodedata.normalize("NFKC", text).lower()))
        if words and words not in NO_CONTENT:
            return True
    return False


def folded(text: str) -> str:
    return unicodedata.normalize("NFKC", text).replace("’", "'").casefold()


def contents(text: str) -> Counter:
    """Words of a text, and in scripts without word spaces its character pairs."""
    text = folded(text)
    runs = re.findall(r"\w+", text)
    if not _CJK.search(text):
        return Counter(runs)
    out: Counter = Counter()
    for run in runs:
        if _CJK.search(run):
            out.update(run[i : i + 2] for i in range(max(1, len(run) - 1)))
        else:
            out[run] += 1
    return out


def is_copy(question: str, texts: list[str]) -> bool:
    """Whether the answer holds nothing that is not in the question, but for words that lead in a copy."""
    asked = contents(question)
    said = contents(" ".join(texts))
    if not said or not asked:
        return False
    new = [w for w in said if w not in asked and w not in LEAD_IN]
    old = sum(n for w, n in said.items() if w in asked)
    # an answer of a few words of the question is not a copy of it
    covered = sum(1 for w in asked if w in said) / len(asked)
    return len(new) <= 1 and len(new) <= 0.1 * len(said) and old > 0 and covered >= 0.6


def is_refusal(texts: list[str]) -> bool:
    """Whether a sentence of its own, outside quotation marks, declines."""
    text = _unquoted(folded(" ".join(texts)))
    return _REFUSAL.search(text) is not None and any(_REFUSAL.search(s.strip()) for s in re.split(r"[.!?。！？\n]+", text))


def foreign(model: LanguageModel, questions: list[str], answers: list[str]) -> np.ndarray:
    """Whether each answer is in another language than its question, by their posteriors.

    The probability that a letter of the answer and one of the question are of one language is below SAME_LANGUAGE, and the answer's
    likeliest language is neither that of the question nor none. Quoted words count for neither text, unless all is quoted.
    """
    asked = model.posteriors([_unquoted(q) or q for q in questions])
    got = model.posteriors([_unquoted(t) for t in answers])
    if not model.languages or not len(questions):
        return np.zeros(len(questions), bool)
    told = (asked[:, :-1].max(1) >= CONFIDENT) & (got[:, :-1].max(1) >= CONFIDENT)
    return told & ((asked * got).sum(1) < SAME_LANGUAGE) & (asked.argmax(1) != got.argmax(1))


def _unquoted(text: str) -> str:
    return _QUOTED.sub(" ", text) if _QUOTE.search(text) else text


class Ends:
    """Words of some texts, each with the word or sign before it and whether it ends a sentence.

    ``pair`` and ``word`` are 64-bit keys. ``end`` is 1 where punctuation, a quotation mark or a line break follows, -1 for the last word of a text
    that ends without one.
    """

    def __init__(self, texts: list[str]):
        w = Words([t if t.isascii() else unicodedata.normalize("NFKC", t) for t in texts])
        n = len(w.hash)
        self.texts, self.doc = w, w.doc
        last = np.ones(n, bool)
        last[:-1] = w.doc[1:] != w.doc[:-1]
        stop = np.where(last, (w.begin + w.length)[w.doc], np.append(w.start[1:], 0))
        begin = w.start + w.size
        closed = _between(np.isin(w.points, _STOPS), begin, stop) > 0
        paused = _between(np.isin(w.points, _PAUSES), begin, stop) > 0
        quoted = _between(np.isin(w.points, _QUOTES), begin, stop) > 0
        self.end = np.where(closed | quoted, 1, np.where(last, -1, 0)).astype(np.int8)
        before = np.zeros(n, np.uint64)
        before[1:] = np.where(closed[:-1], 0, np.where(paused[:-1], 1, w.hash[:-1]))
        if n:
            before[np.append([True], last[:-1])] = 0
        self.word = w.hash.view(np.int64)
        self.pair = _mixed(w.hash * np.uint64(5) + before).view(np.int64)
        self.last = np.flatnonzero(last)


_STOPS = np.array([ord(c) for c in ".!?。！？…\n"], np.uint32)
_PAUSES = np.array([ord(c) for c in ",;:，；：、"], np.uint32)
_QUOTES = np.array([ord(c) for c in "\"”"], np.uint32)

LOOKED = "pair_id bigint, defect string, pair bigint, word bigint, n bigint, n_end bigint"


def _look(shared):
    """mapInPandas function, one pass over questions and answers.

    Rows with a pair_id or without counts tell what a pair shows by itself, or the keys of the last words of an unpunctuated answer;
    rows with counts how often a word occurs, and ends a sentence, in this batch. Only ends that punctuation, a line break or the
    end of a whole JSON text confirm count; the bare end of a text, which may be broken off, counts as neither.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: LanguageModel = shared.value
        for whole in batches:
            for lo in range(0, len(whole), 2000):
                pdf = whole.iloc[lo : lo + 2000]
                questions = [q or "" for q in pdf["extra_prompt"]]
                answers = [read_answer(a) for a in pdf["prompt"]]
                joined = [" ".join(texts) for _, texts, _ in answers]
                texts = questions + [t for _, parts, _ in answers for t in parts]
                sure = np.array([False] * len(questions) + [kind == "json" and ok for kind, parts, ok in answers for _ in parts], bool)
                ends = Ends(texts)
                yield _counted(ends, sure)
                copy, other = copies(questions, joined), foreign(model, questions, joined)
                first = np.cumsum([len(questions)] + [len(parts) for _, parts, _ in answers])
                closing = dict(zip(ends.doc[ends.last].tolist(), ends.last.tolist()))
                found = []
                for i, (kind, parts, ok) in enumerate(answers):
                    defect = pair = word = None
                    if not has_content(parts):
                        defect = "empty"
                    elif kind == "json" and not ok:
                        defect = "truncated"
                    elif is_refusal(parts):
                        defect = "refusal"
                    elif copy[i] and is_copy(questions[i], parts):
                        defect = "copied"
                    elif other[i]:
                        defect = "language"
                    elif kind == "text":
                        state = open_end(parts[0])
                        at = closing.get(int(first[i]))
                        if state == "sign":
                            defect = "truncated"
                        elif state == "word" and at is not None and ends.end[at] < 0:
                            pair, word = ends.pair[at], ends.word[at]
                    found.append((defect, pair, word))
                keys = {c: pd.array([None if f[k] is None else int(f[k]) for f in found], "Int64") for k, c in ((1, "pair"), (2, "word"))}
                none = pd.array([None] * len(found), "Int64")
                out = pd.DataFrame({"pair_id": pdf["pair_id"].astype("Int64").array, "defect": [f[0] for f in found], **keys, "n": none, "n_end": none})
                yield out[out["defect"].notna() | out["word"].notna()]

    return run


def _counted(ends: Ends, sure: np.ndarray) -> pd.DataFrame:
    """How often each word pair of a batch occurs and ends a sentence."""
    end = np.where((ends.end < 0) & sure[ends.doc], 1, ends.end)
    use = end >= 0
    keys, at, inverse = np.unique(ends.pair[use], return_index=True, return_inverse=True)
    frame = pd.DataFrame({"pair": keys, "word": ends.word[use][at], "n": np.bincount(inverse, minlength=len(keys)), "n_end": np.bincount(inverse, weights=end[use], minlength=len(keys)).astype(np.int64)})
    return frame.assign(pair_id=pd.array([pd.NA] * len(keys), "Int64"), defect=None)[["pair_id", "defect", "pair", "word", "n", "n_end"]]


def copies(questions: list[str], answers: list[str]) -> np.ndarray:
    """Which answers may hold hardly a word that their question lacks: what ``is_copy`` has to look at."""
    n = len(questions)
    words = Words([t if t.isascii() else unicodedata.normalize("NFKC", t) for t in questions + answers])
    keys = (words.doc % n if n else words.doc).astype(np.uint64) << np.uint64(40) | words.hash >> np.uint64(24)
    of_answer = words.doc >= n
    asked, said = np.unique(keys[~of_answer]), np.unique(keys[of_answer])
    fresh = said[~np.isin(said, asked, assume_unique=True)] >> np.uint64(40)
    return np.bincount(fresh.astype(np.int64), minlength=n) <= 2 + len(LEAD_IN)


def open_end(text: str) -> str | None:
    """'sign' for a text that ends in a comma or another sign that opens something, 'word' for one that ends without punctuation.

    None for a closed text. The last line of several list items needs no full stop.
    """
    text = text.rstrip(INVISIBLE + " \t\r\n\u3000\xa0")
    if not text or _TERMINAL.search(text, max(0, len(text) - 64)):
        return None
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > 1 and _BULLET.match(lines[-1]) and _BULLET.match(lines[-2]):
        return None
    return "sign" if text[-1] in ",;:，；：、-–—(&" else "word"


def defects(pairs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """(pair_id, defect) of each defective pair; 'empty', 'truncated', 'refusal', 'copied' or 'language'.

    The answer may be text or JSON (its keys are no content); quoted words count neither for the
    language nor as a refusal. A null or blank answer is empty; a null question can neither be
    copied nor have a language. The language is that of the question's text, compared by the
    posteriors of a naive Bayes model over character n-grams. An answer without a final sign is truncated when its
    last words hardly ever end a sentence anywhere in the corpus: the share of confirmed ends of the
    last word pair, or of the last word where the pair is rare. Texts are read whole. A pair has
    one defect at most, the first of: empty, broken JSON, refusal, copied, language, truncated.
    Repeated pair ids give a row for each defect found. An empty table gives no rows.
    """
    read = pairs.select("pair_id", "extra_prompt", "prompt")
    model = language.fit(pairs, "prompt_lang", "extra_prompt", "pair_id", per_language)
    shared = pairs.sparkSession.sparkContext.broadcast(model)
    looked = stored(spread(read).mapInPandas(_look(shared), LOOKED), "looked")
    counts = stored(looked.where("n is not null").groupBy("pair", "word").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end")), "ends")
    open_ends = looked.where("defect is null and n is null").select("pair_id", "pair", "word")
    lone = counts.groupBy("word").agg(F.sum("n").alias("wn"), F.sum("n_end").alias("wn_end"))
    judged = open_ends.join(counts.drop("word"), "pair", "left").join(lone, "word", "left")
    share = F.when(F.coalesce("n", F.lit(0)) >= 5, F.col("n_end") / F.col("n")).otherwise(F.coalesce(F.col("wn_end") / F.col("wn"), F.lit(0.0)))
    cut_off = judged.where(share < END_SHARE).select("pair_id", F.lit("truncated").alias("defect"))
    return looked.where("defect is not null").select("pair_id", "defect").union(cut_off).distinct()
