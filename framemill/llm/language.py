"""Languages of texts: naive Bayes over hashed character n-grams, with true posteriors, for a batch at a time."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framemill.operators.sampling import smallest

#: Labelled texts from which a language is fitted at most (those with the least hash), and all languages together.
SAMPLE_PER_LANGUAGE, SAMPLE_TEXTS = 2000, 200_000
#: Orders of the character n-grams, and the buckets that they are hashed to.
ORDERS, BUCKETS = (1, 2, 3), 1 << 18
#: Letters that are judged at once; the posterior of a text is the mean of those of its stretches.
STRETCH = 96
#: Additive smoothing of n-gram counts.
SMOOTHING = 0.1
#: Name of the class in which all n-grams are equally likely: what is no language at all.
NONE = "und"

_ODD = (np.uint32(0x9E3779B1), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))


class _Fold:
    """Code points as letters of one case; anything that is no letter is a blank."""

    def __init__(self) -> None:
        self.to = np.full(0x110000, 32, np.uint32)
        self.known = np.zeros(0x110000, bool)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        there = np.bincount(points, minlength=1) > 0
        for p in np.flatnonzero(there & ~self.known[: len(there)]).tolist():
            self.known[p] = True
            c = chr(p).casefold()
            if chr(p).isalpha() or unicodedata.category(chr(p))[0] == "M":
                self.to[p] = ord(c) if len(c) == 1 else p
        return self.to[points]


_fold = _Fold()


class Grams:
    """The n-grams of some texts: their buckets (-1 where one would reach over a text's end) and the stretches they begin in."""

    def __init__(self, texts: list[str]):
        plain = [t if t.isascii() else unicodedata.normalize("NFKC", t) for t in texts]
        # each text begins with a blank and ends with one, before the next text's first
        joined = " " + "  ".join(plain) + " "
        points = _fold(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))
        size = np.array([len(t) for t in plain], np.int64)
        blank = points == 32
        keep = np.ones(len(points), bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        heads = np.cumsum(size + 2) - size - 2
        keep[heads] = True
        at = np.flatnonzero(keep)
        c = points[at]
        begin = np.searchsorted(at, np.append(heads, len(points)))
        length = np.diff(begin)
        most = np.maximum(1, length // STRETCH)
        self.stretch_doc = np.repeat(np.arange(len(texts)), most)
        nth = np.arange(len(self.stretch_doc)) - np.repeat(np.cumsum(most) - most, most)
        #: where each stretch begins among the letters
        self.edges = begin[:-1][self.stretch_doc] + nth * STRETCH
        self.letters = np.diff(np.append(self.edges, len(c)))
        bare = np.add.reduceat(c != 32, self.edges) == 0 if len(c) else np.empty(0, bool)
        self.letters[bare] = 0
        self.buckets = []
        h = np.zeros(len(c), np.uint32)
        for k, odd in zip(ORDERS, _ODD):
            n = max(0, len(c) - k + 1)
            h = h[:n] * np.uint32(0x01000193) + c[k - 1 : k - 1 + n]
            bucket = np.full(len(c), -1, np.int32)
            bucket[:n] = ((h ^ (h >> np.uint32(15))) * odd) >> np.uint32(14)
            for back in range(1, k):
                bucket[begin[1:] - back] = -1
            self.buckets.append(bucket)


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the n-grams of texts together."""
    all_of = np.concatenate(Grams(texts).buckets) if texts else np.empty(0, np.int32)
    n = np.bincount(all_of[all_of >= 0], minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


class LanguageModel:
    """Log-likelihoods of n-gram buckets by language, and the languages' priors."""

    def __init__(self, labelled: dict[str, tuple[np.ndarray, np.ndarray]], prior: dict[str, float] | None = None):
        self.languages = sorted(labelled)
        seen = np.unique(np.concatenate([b for b, _ in labelled.values()])) if labelled else np.empty(0, np.int64)
        self.row = np.zeros(BUCKETS, np.int32)
        self.row[seen] = np.arange(1, len(seen) + 1)
        # a row for each n-gram of the sample, the first for unseen ones; the last column is no language at all
        table = np.full((len(seen) + 1, len(self.languages) + 1), SMOOTHING, np.float64)
        for j, lang in enumerate(self.languages):
            b, n = labelled[lang]
            table[self.row[b], j] += n
            table[:, j] /= table[:, j].sum()
        table[:, -1] = 1 / len(table)
        # a last row of zeros for no n-gram
        self.weights = np.vstack([np.log(table), np.zeros(table.shape[1])]).astype(np.float32)
        weight = np.array([max(1.0, (prior or {}).get(lang, 1.0)) for lang in self.languages] + [1.0])
        self.prior = np.log(weight / weight.sum())

    @property
    def names(self) -> list[str]:
        return [*self.languages, NONE]

    def posteriors(self, texts: list[str]) -> np.ndarray:
        """Share of each language (and of none, last) in each text: mean posterior of its stretches, by their letters.

        The orders count the same letters, so their log-likelihoods are averaged. A text without letters has a row of zeros.
        """
        out = np.zeros((len(texts), len(self.languages) + 1))
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= 1 << 18):
                size += len(texts[hi]) + 1
                hi += 1
            out[lo:hi] = self._posteriors(texts[lo:hi])
            lo = hi
        return out

    def _posteriors(self, texts: list[str]) -> np.ndarray:
        g = Grams(texts)
        if not len(texts):
            return np.zeros((0, self.weights.shape[1]))
        total = np.zeros((len(g.stretch_doc), self.weights.shape[1]), np.float32)
        for bucket in g.buckets:
            rows = self.row[bucket]
            rows[bucket < 0] = len(self.weights) - 1
            total += np.add.reduceat(self.weights.take(rows, axis=0, mode="clip"), g.edges, axis=0)
        log = total / len(ORDERS) + self.prior
        log -= log.max(1, keepdims=True)
        p = np.exp(log)
        p *= (g.letters / p.sum(1))[:, None]
        share = np.zeros((len(texts), p.shape[1]))
        np.add.at(share, g.stretch_doc, p)
        whole = share.sum(1, keepdims=True)
        return np.divide(share, whole, out=np.zeros_like(share), where=whole > 0)


def folded_label(label: Column) -> Column:
    """A language label in lower case without region: 'fil' and 'fi' stay apart, 'en-US' is 'en'; null where nothing is left."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(label), r"^([^-_]*)", 1)), F.lit(""))


def fit(rows: DataFrame, label: str, text: str, key: str, per_language: int = SAMPLE_PER_LANGUAGE, most: int = SAMPLE_TEXTS) -> LanguageModel:
    """Fit on a bounded sample of labelled rows: at most ``per_language`` of a language and ``most`` of all together.

    The languages with most labelled rows come first; those beyond ``most`` sampled rows are not fitted. The
    priors count all labelled rows. The sample's n-grams are counted where the rows are; only
    counts by language and bucket come to the driver, at most BUCKETS for each language.
    """
    labelled = rows.select(folded_label(F.col(label)).alias("lang"), F.col(key).alias("key"), F.col(text).alias("text")).where("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()
    names, room = {}, most
    for r in sizes:
        if room <= 0:
            break
        names[r["lang"]] = r["count"]
        room -= min(per_language, r["count"])
    few = smallest(labelled.where(F.col("lang").isin(list(names))), ["lang"], F.struct(F.xxhash64("key", "text"), "key", "text"), per_language)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                b, n = counts(part["text"].tolist())
                yield pd.DataFrame({"lang": lang, "bucket": b, "n": n})

    counted = few.select("lang", "text").mapInPandas(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    labelled_counts = {lang: (part["bucket"].to_numpy(), part["n"].to_numpy()) for lang, part in counted.groupby("lang")}
    return LanguageModel(labelled_counts, {k: float(v) for k, v in names.items()})
