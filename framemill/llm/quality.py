"""Statistics of text quality for each document, exact ranks by language, and the outliers that tail probabilities tell."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framemill.llm import language, textstats
from framemill.llm.textstats import STATS
from framemill.operators.ordering import placed
from framemill.session import broadcast_if_small, fits_broadcast, spread, stored

#: Statistics that are ranked, and the tail that speaks against prose.
TAILS = {
    "alpha_ratio": "low", "digit_ratio": "high", "symbol_ratio": "high", "space_ratio": "low", "line_end_ratio": "low",
    "common_share": "low", "distinct_share": "low", "repeat_ratio": "high", "mean_line_words": "low", "prose_share": "low",
    "item_share": "high", "item_lines": "high", "field_share": "high", "field_lines": "high", "sentence_share": "low",
    "run_share": "high", "odd_ratio": "high", "long_share": "high", "mean_word_len": "both", "compress_ratio": "both",
}

#: Statistics whose tails a list, a table and junk have in common.
LIST = ("item_share", "item_lines", "prose_share")
TABLE = ("field_share", "field_lines", "prose_share")
JUNK = (
    "alpha_ratio", "symbol_ratio", "digit_ratio", "common_share", "distinct_share", "repeat_ratio", "run_share", "odd_ratio",
    "long_share", "mean_word_len", "compress_ratio", "space_ratio",
)
#: Junk is bad in one of several ways: of its tails so many count, those furthest out.
FURTHEST = 5
#: A text is an outlier of a kind when its combined surprise is at least this part of -ln(share of such texts in its language).
OUTLIER = {"table": 0.86, "list": 0.91, "junk": 0.93}
#: Share of a text that makes it mostly one thing; used for the shares of kinds in a language alone, never for a text.
MOSTLY = 0.5
#: Distinct texts from which a language is ranked by itself, else among the whole corpus.
LEAST_RANKED = 100
#: Decimals to which statistics are recorded and ranked.
DECIMALS = 4
_TEXT = ["language", "text_key"]
MEASURED = "row bigint, doc_id bigint, language string, text_key binary, " + ", ".join(f"{c} double" for c in STATS)


def measured(documents: DataFrame) -> DataFrame:
    """All statistics of each document: (row, doc_id, language, text_key, ...). ``row`` tells rows of equal ids apart, ``text_key`` texts.

    A null text is measured like an empty one: all statistics are 0. The language is the one with the greatest
    posterior of a character n-gram model, fitted on a bounded sample of the labels in ``lang``; a text of no
    language (or a corpus without labels) is counted with the most frequent one. Texts are read whole; other
    columns are not read.
    """
    model = language.fit(documents, "lang", "text", "doc_id")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        names = np.array([*known.languages, None], dtype=object)
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            share = known.posteriors(texts)
            told = np.where(share.any(1), names[share.argmax(1)], None)
            keys = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            stats = {k: v.round(DECIMALS) for k, v in textstats.measure(texts).items()}
            yield pd.DataFrame({"row": pdf["row"], "doc_id": pdf["doc_id"].astype("Int64"), "language": told, "text_key": keys, **stats})

    read = spread(documents.select("doc_id", "text")).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    out = stored(read.mapInPandas(run, MEASURED), "measured")
    main = out.where("language is not null").groupBy("language").count().orderBy(F.desc("count"), "language").limit(1)
    first = main.first()
    return out.withColumn("language", F.coalesce("language", F.lit(first["language"] if first else language.NONE)))


def ranks(population: DataFrame) -> DataFrame:
    """(language, stat, value, n, p, upto): each value that occurs, how many rows have it, its tail probability, and the share of rows up to it.

    The tail probability is the share of the language's rows at least as far out; equal values share theirs. Exact: the distinct values
    of each language and statistic are sorted over range partitions, each counts its own, and one offset per
    partition turns counts into ranks.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("stat"), F.col(c).alias("value")) for i, c in enumerate(TAILS)])).alias("s")
    distinct = population.select("language", pairs).groupBy("language", "s.stat", "s.value").agg(F.count(F.lit(1)).alias("n"))
    ranked = placed(distinct, [F.col("language"), F.col("stat"), F.col("value")], "ranks")
    inside = Window.partitionBy("_part", "language", "stat").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = ranked.groupBy("language", "stat", "_part").agg(F.sum("n").alias("m"))
    before = Window.partitionBy("language", "stat").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("language", "stat")
    # a row for each partition and each language and statistic in it
    offsets = totals.select("language", "stat", "_part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"), F.sum("m").over(every).alias("total"))
    counted = ranked.withColumn("inside", F.sum("n").over(inside)).join(broadcast_if_small(offsets, 96), ["language", "stat", "_part"])
    low = (F.col("inside") + F.col("base")) / F.col("total")
    high = (F.col("total") - F.col("inside") - F.col("base") + F.col("n")) / F.col("total")
    side = F.element_at(F.array(*[F.lit(v) for v in TAILS.values()]), F.col("stat") + 1)
    p = F.when(side == "low", low).when(side == "high", high).otherwise(F.least(F.lit(1.0), 2 * F.least(low, high)))
    return stored(counted.select("language", "stat", "value", "n", p.alias("p"), low.alias("upto"), (F.col("n") > 0.01 * F.col("total")).alias("hot")), "tails")


def tails(stats: DataFrame, known: DataFrame) -> DataFrame:
    """(row, stat, p): the tail probability of each ranked statistic of each row of ``stats``.

    The ranks meet the rows in a broadcast while their counted number allows it. Beyond that, values that many rows
    share (at most 100 for each language and statistic) do, all others meet in a join without hot keys.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("stat"), F.col(c).alias("value")) for i, c in enumerate(TAILS)])).alias("s")
    long = stats.select("row", "language", pairs).select("row", "language", "s.stat", "s.value")
    keys = ["language", "stat", "value"]
    table = known.select(*keys, "p")
    if fits_broadcast(table, 96):
        return long.join(F.broadcast(table), keys).select("row", "stat", "p")
    hot = long.join(F.broadcast(known.where("hot").select(*keys, F.col("p").alias("hp"))), keys, "left")
    easy = hot.where("hp is not null").select("row", "stat", F.col("hp").alias("p"))
    return easy.union(hot.where("hp is null").select("row", *keys).join(known.where("not hot").select(*keys, "p"), keys).select("row", "stat", "p"))


def kind_shares(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(language, kind columns): the share of a language's distinct texts that are mostly rows of fields, mostly items, or hardly words of it.

    What is hardly words of a language: a share of common words below half its median (which the ranks give), fewer letters than other
    signs, or word pairs that are nearly all repeated. The shares say how rare an outlier of a kind may be.
    """
    at = list(TAILS).index("common_share")
    median = known.where((F.col("stat") == at) & (F.col("upto") >= 0.5)).groupBy("language").agg(F.min("value").alias("median"))
    c = F.col
    table = c("field_share") >= MOSTLY
    items = ~table & (c("item_share") >= MOSTLY)
    bare = ~table & ~items & ((c("common_share") < MOSTLY * c("median")) | (c("alpha_ratio") < MOSTLY) | (c("repeat_ratio") >= 0.9))
    part = lambda mask: F.avg(mask.cast("double"))
    met = texts.join(broadcast_if_small(median, 64), "language", "left")
    return met.groupBy("language").agg(part(table).alias("table"), part(items).alias("list"), part(F.coalesce(bare, F.lit(False))).alias("junk"))


def scores(stats: DataFrame) -> DataFrame:
    """(language, text_key, copies, score, peak, table_score, list_score, junk_score, kind) of each distinct text.

    Each text with a word is ranked and counted once, however many rows hold it (others have no scores); a language with too few texts to rank is
    ranked among the whole corpus. ``score`` is the mean surprise, -ln p, over all ranked statistics, ``peak`` over
    the three furthest out; the scores of the kinds are those of their statistics' tails: the mean for lists and
    tables, for junk that of the furthest ones and of the common words.
    """
    texts = stored(stats.groupBy(*_TEXT).agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"), F.first("n_words").alias("n_words"), *[F.first(c).alias(c) for c in TAILS]), "texts")
    ranked = texts.where("n_words > 0")
    few = stored(ranked.groupBy("language").count().where(F.col("count") < LEAST_RANKED).select("language"), "few")
    mine, population = ranked, ranked
    if not few.isEmpty():
        small = broadcast_if_small(few, 64)
        every = ranked.withColumn("language", F.lit("*"))
        own = ranked.join(small, "language", "left_anti")
        mine = own.unionByName(every.join(ranked.join(small, "language", "left_semi").select("row"), "row", "left_semi"))
        population = own.unionByName(every)
    known = ranks(population)
    shares = kind_shares(population, known)
    s = -F.ln("p")
    number = {c: i for i, c in enumerate(TAILS)}
    of = lambda names: F.avg(F.when(F.col("stat").isin([number[c] for c in names]), s))
    furthest = lambda only, n: F.aggregate(F.slice(F.sort_array(F.collect_list(only), asc=False), 1, n), F.lit(0.0), lambda a, x: a + x) / n
    out = tails(mine, known).groupBy("row").agg(
        F.avg(s).alias("score"),
        furthest(s, 3).alias("peak"),
        of(TABLE).alias("table_score"),
        of(LIST).alias("list_score"),
        ((furthest(F.when(F.col("stat").isin([number[c] for c in JUNK]), s), FURTHEST) + F.max(F.when(F.col("stat") == number["common_share"], s))) / 2).alias("junk_score"),
    )
    met = mine.select("row", F.col("language").alias("ranked_as")).join(out, "row")
    met = met.join(broadcast_if_small(shares.withColumnRenamed("language", "ranked_as"), 96), "ranked_as").drop("ranked_as")
    return texts.select("row", *_TEXT, "copies", "n_words").join(met, "row", "left").withColumn("kind", kind_of()).drop("row", "n_words", *OUTLIER)


def kind_of() -> Column:
    """The kind whose tails make a text an outlier, tables first, then lists; null for prose, even if it is unusual."""
    over = lambda k: (F.col(k) > 0) & (F.col(f"{k}_score") > 0) & (F.col(f"{k}_score") >= -OUTLIER[k] * F.ln(k))
    out = F.when(F.col("n_words") == 0, "junk")
    for k in OUTLIER:
        out = out.when(over(k), k)
    return out


def with_scores(stats: DataFrame) -> DataFrame:
    """``stats`` with the scores of their texts; texts that many rows share (at most 100) meet their rows in a broadcast."""
    known = stored(scores(stats), "scores")
    many = F.col("copies") > 0.01 * stats.count()
    told = ("score", "peak", "table_score", "list_score", "junk_score", "kind")
    packed = known.where(many).select(*_TEXT, F.struct(*told).alias("_s"))
    met = stats.join(F.broadcast(packed), _TEXT, "left")
    rest = met.where("_s is null").drop("_s").join(known.where(~many).drop("copies"), _TEXT)
    return met.where("_s is not null").select(*_TEXT, *[c for c in stats.columns if c not in _TEXT], "_s.*").unionByName(rest)


def graded(documents: DataFrame) -> DataFrame:
    """Each document with its statistics, outlier scores and kind ('list', 'table', 'junk'; null for prose).

    Texts are ranked within their language, each once. A text is an outlier of a kind when the tails of that kind's statistics,
    combined, are about as improbable as texts of that kind are rare in its language: its score reaches a part of
    -ln(share), which holds alike for rare and for frequent kinds. Nothing but ranks is looked at: texts that are
    no further out than most of their language are prose, so a language with no more than one distinct text has no outlier but an
    empty one. Equal texts of a language get equal kinds. Null texts and texts without a word have nothing to rank
    and are 'junk'. An empty table gives no rows.
    """
    return with_scores(measured(documents))
