"""Train, validation and test splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framemill.llm.components import connected
from framemill.operators.ordering import running_sum
from framemill.session import stored

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def folded_name(name: Column) -> Column:
    """A name without case, blanks, punctuation and separators; null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]+", "")), F.lit(""))


def folded_number(ident: Column) -> Column:
    """The number of an id without leading zeros; ids with no or several numbers keep all letters and digits, folded."""
    text = F.translate(ident, "０１２３４５６７８９", "0123456789")
    one = F.regexp_extract(text, r"^\D*?0*(\d+)\D*$", 1)
    short = F.regexp_replace(text, r"(?<!\d)0+(?=\d)", "")
    bare = F.nullif(F.trim(F.lower(F.regexp_replace(short, r"[^\p{L}\p{N}]+", " "))), F.lit(""))
    return F.when(one != "", one).otherwise(bare)


def ties(records: DataFrame) -> DataFrame:
    """Edges (a, b) between episodes that must share a split.

    All episodes of one recording of one domain are tied to the smallest of them (a star, not all
    pairs); an episode is tied to the other one its record shows. Nulls and names without a letter
    or digit tie nothing.
    """
    named = records.select(F.col("episode_index").alias("a"), folded_name(F.col("domain_name")).alias("d"), folded_number(F.col("recording_id")).alias("r"))
    named = named.where("a is not null and d is not null and r is not null").distinct()
    hub = named.groupBy("d", "r").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = named.join(hub, ["d", "r"]).select("a", "b")
    shown = records.select(F.col("episode_index").alias("a"), F.col("ref_episode_index").alias("b"))
    return same.union(shown).where("a is not null and b is not null and a <> b").distinct()


def episode_components(records: DataFrame, seed: int = 0) -> DataFrame:
    """(episode_index, component) of every episode of the records, shown ones included."""
    seen = records.select(F.col("episode_index").alias("v")).union(records.where("episode_index is not null").select("ref_episode_index"))
    return connected(seen, ties(records), seed).select(F.col("v").alias("episode_index"), "component")


def tied_pairs(components: DataFrame) -> DataFrame:
    """Every pair of different episodes of a component, the smaller first."""
    other = components.select("component", F.col("episode_index").alias("episode_b"))
    pairs = components.withColumnRenamed("episode_index", "episode_a").join(other, "component")
    return pairs.where("episode_a < episode_b").select("episode_a", "episode_b")


def split(records: DataFrame, shares: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """(record_id, episode_index, component, split) for the distinct records.

    Components are lined up by the hash of their id and cut where the running number of records
    passes the shares, in their order. A component larger than a tenth of the smallest share goes
    to the largest split beforehand, and the others fill what is left of each share. Records
    without an episode are units of their own. Equal rows are one record and always fall into one
    split; so do all rows of one episode. An empty table gives no rows.
    """
    shares = shares or SHARES
    whole = sum(shares.values())
    shares = {k: v / whole for k, v in shares.items()}
    largest = max(shares, key=shares.get)
    comps = stored(episode_components(records, seed), "components")
    rows = records.select("record_id", "episode_index").distinct().join(comps, "episode_index", "left")
    rows = rows.withColumn("unit", F.coalesce(F.concat(F.lit("c"), F.col("component").cast("string")), F.concat(F.lit("r"), F.col("record_id").cast("string")), F.lit("none")))
    units = stored(rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n")), "units")
    total = units.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    big = F.col("n") > max(1.0, 0.1 * min(shares.values()) * total)
    held = units.where(big).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    left = {k: max(0.0, v * total - (held if k == largest else 0)) for k, v in shares.items()}
    cum = running_sum(units.where(~big), "n", [F.xxhash64("unit", F.lit(seed)), F.col("unit")], "before", "splits")
    rest, bound, label = max(1.0, total - held), 0.0, None
    scale = rest / max(1e-9, sum(left.values()))
    middle = F.col("before") + F.col("n") / 2
    for name, quota in left.items():
        bound += quota * scale
        label = F.when(middle <= bound, name) if label is None else label.when(middle <= bound, name)
    chosen = cum.select("unit", label.otherwise(largest).alias("split")).union(units.where(big).select("unit", F.lit(largest).alias("split")))
    return rows.join(chosen, "unit").select("record_id", "episode_index", "component", "split")
