"""Edits of data sets on storage that are refused or change nothing, and what a failed one leaves."""

import json

import pytest
from pyspark.sql import functions as F

from framemill.sources import rewrite, store

ROWS = "episode_index bigint, t bigint, task string, state array<double>"


@pytest.fixture
def built(spark, tmp_path):
    def make(name, episodes, fps=10.0):
        rows = [(e, t, f"task {e % 2}", [float(t), float(e)]) for e in episodes for t in range(3 + e)]
        root = f"file://{tmp_path}/{name}"
        store.create(spark.createDataFrame(rows, ROWS), root, fps, [F.col("t")], ["state"])
        return store.Episodes(spark, root)

    return make


def test_edits_keep_numbers_dense_and_totals_right(spark, built, tmp_path):
    a, b = built("a", [0, 1, 2]), built("b", [5, 9])
    rewrite.merge(spark, [a.root, b.root], f"file://{tmp_path}/m", ["state"])
    m = store.Episodes(spark, f"file://{tmp_path}/m")
    assert (m.info["total_episodes"], m.info["total_frames"]) == (5, 3 + 4 + 5 + 8 + 12)
    assert [r["episode_index"] for r in m.episodes().orderBy("episode_index").collect()] == list(range(5))
    rewrite.delete(m, m.episodes().where("episode_index in (0, 3)"), f"file://{tmp_path}/d", ["state"])
    d = store.Episodes(spark, f"file://{tmp_path}/d")
    assert [r["length"] for r in d.episodes().orderBy("episode_index").collect()] == [4, 5, 12]
    assert [r["index"] for r in d.frames(["index"]).orderBy("index").collect()] == list(range(21))
    new = spark.createDataFrame([(7, 0, "new", [1.0, 2.0]), (7, 1, None, [3.0, 2.0])], ROWS)
    rewrite.append(new, d.root, [F.col("t")], ["state"])
    after = store.Episodes(spark, d.root)
    assert (after.info["total_episodes"], after.info["total_frames"]) == (4, 23)
    assert after.frames().where("episode_index = 3").count() == 2 and after.tasks().count() == 3
    first = after.stats().where("dim = 0").first()
    assert first["n"] == 23 and first["mx"] == 11.0


def test_refused_edits(spark, built, tmp_path):
    a, b = built("a", [0, 1]), built("b", [0], fps=20.0)
    with pytest.raises(ValueError, match="rates"):
        rewrite.merge(spark, [a.root, b.root], f"file://{tmp_path}/x")
    with pytest.raises(ValueError, match="left"):
        rewrite.delete(a, a.episodes(), f"file://{tmp_path}/x")
    with pytest.raises(ValueError, match="several"):
        rewrite.split(a, {"p": a.episodes(), "q": a.episodes()}, f"file://{tmp_path}/x")
    with pytest.raises(ValueError, match="episode"):
        rewrite.append(spark.createDataFrame([(None, 0, "t", [0.0])], ROWS), a.root, [F.col("t")])
    rewrite.append(spark.createDataFrame([], ROWS), a.root, [F.col("t")])
    assert store.Episodes(spark, a.root).info == a.info


def test_what_is_not_committed_is_not_read(spark, built, tmp_path):
    a = built("a", [0, 1])
    n = a.frames().count()
    a.spark.read.parquet(f"{a.root}/data").write.parquet(f"{a.root}/data-broken")  # an append that failed before its last step
    assert store.Episodes(spark, a.root).frames().count() == n
    assert json.loads((tmp_path / "a" / "meta" / "info.json").read_text())["total_episodes"] == 2
