"""Data sets, manifests and formats on storage, and streams against batches."""

import json

import pytest
from pyspark.sql import functions as F

from framemill.sources import formats, manifests, store
from framemill.streaming import stateful


def _rows(spark):
    return spark.createDataFrame([(e, t, f"task {e % 2}", [float(t), None if t == 3 else 1.0]) for e in (5, 9) for t in range(8)], "episode_index bigint, t int, task string, state array<double>")


def test_a_data_set(spark, tmp_path):
    root = f"file://{tmp_path}/ds"
    store.create(_rows(spark), root, 4.0, [F.col("t")], ["state"])
    assert store.discover([f"file://{tmp_path}", root]) == [root]
    ds = store.Episodes(spark, root)
    assert (ds.info["total_episodes"], ds.info["total_frames"]) == (2, 16)
    assert ds.frames(["index"], [9]).count() == 8
    assert ds.frames(None, ds.episodes().where("episode_index = 5")).count() == 8
    assert [r["t"] for r in ds.window(9, 2, 5, ["t", "timestamp"]).collect()] == [2, 3, 4]
    with pytest.raises(ValueError):
        ds.window(9, 5, 9, ["t"])
    assert {r["task"]: r["task_index"] for r in ds.tasks().collect()} == {"task 1": 0}
    stats = {r["dim"]: r for r in ds.stats().collect()}
    assert stats[0]["n"] == 16 and stats[1]["n"] == 14 and stats[1]["std"] == 0
    assert store.open_all(spark, [root, root]).groupBy("dataset_index").count().count() == 2
    with pytest.raises(Exception):
        store.create(_rows(spark), root, 4.0, [F.col("t")])
    plan = ds.frames(["index"], [9])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(episode_index" in plan or "EqualTo(episode_index,9)" in plan


def test_refused_data_sets(spark, tmp_path):
    with pytest.raises(ValueError):
        store.create(_rows(spark).withColumnRenamed("state", "a/b"), f"file://{tmp_path}/x", 1.0, [F.col("t")])
    with pytest.raises(ValueError):
        store.create(_rows(spark).withColumn("episode_index", F.lit(None).cast("bigint")), f"file://{tmp_path}/y", 1.0, [F.col("t")])


def test_curation_edges(spark, tmp_path):
    base = {"span_uuid": "u", "clip_location": "/c.mp4", "width": 640, "height": 480, "num_frames": 610, "framerate": 10.0, "windows": [{"start_frame": 0, "end_frame": 60, "captions": {"a_caption": "x"}}]}
    cases = {
        "kept": base,
        "missing_identity": base | {"span_uuid": ""},
        "missing_clip_metadata": base | {"framerate": None, "duration_span": [0, 5]},
        "duration_too_long": base | {"num_frames": 611},
        "short_edge_too_small": base | {"height": 479},
        "no_valid_window": base | {"windows": [{"start_frame": 0, "end_frame": 59, "captions": {"a_caption": "x"}}, {"start_frame": 0, "end_frame": 99, "captions": {"a_caption": " "}}, {"start_frame": None, "end_frame": 99, "captions": {"a_caption": "x"}}]},
    }
    path = tmp_path / "clips.jsonl"
    path.write_text("\n".join(json.dumps(c | {"source_video": k}) for k, c in cases.items()) + "\n{broken\n")
    clips = manifests.read_lines(spark, str(path), manifests.CLIPS)
    rows = manifests.curated(clips, min_edge=480)
    assert {r["reason"] for r in rows.collect()} == {None, "malformed_json", *list(cases)[1:]}
    summary = manifests.write_manifest(rows, f"file://{tmp_path}/m")
    assert summary["kept"] == 1 and sum(summary["dropped"].values()) == 6
    back = manifests.read_lines(spark, f"file://{tmp_path}/m", manifests.MANIFEST)
    flat = manifests.by_window(manifests.usable(back, 61, 480)).collect()
    assert [(r["uuid"], r["caption"], r["end_frame"]) for r in flat] == [("u_w0", "x", 60)]
    with pytest.raises(ValueError):
        manifests.write_manifest(rows.where("reason is not null"), f"file://{tmp_path}/none")
    controls = spark.createDataFrame([("other", "p")], "span_uuid string, control_path string")
    assert {r["reason"] for r in manifests.curated(clips, min_edge=480, controls=controls).collect()} >= {"missing_control_path"}


def test_other_manifests(spark, tmp_path):
    lines = spark.createDataFrame([("/a", None), ("/b", "k")], "path string, video_key string")
    assert [r["video_key"] for r in manifests.with_defaults(lines, {"video_key": "d"}).orderBy("path").collect()] == ["d", "k"]
    with pytest.raises(ValueError):
        manifests.with_defaults(lines.union(spark.createDataFrame([(None, "x")], lines.schema)), {"video_key": "d"})
    (tmp_path / "t.csv").write_text("a,b\n1,NaN\n2,x\n")
    assert [tuple(r) for r in manifests.read_csv(spark, str(tmp_path / "t.csv")).collect()] == [("1", None), ("2", "x")]
    for name, files in {"one": {"caption.txt": "dense", "caption.json": '{"a": 1}'}, "two": {"caption.txt": " only \n"}}.items():
        (tmp_path / "caps" / name).mkdir(parents=True)
        for f, text in files.items():
            (tmp_path / "caps" / name / f).write_text(text)
    got = {r["name"]: (r["caption"].strip(), r["kind"]) for r in manifests.read_caption_dirs(spark, str(tmp_path / "caps")).collect()}
    assert got == {"one": ('{"a": 1}', "json"), "two": ("only", "txt")}


def test_formats(spark, tmp_path):
    assert formats.suffix_of("s3://b/x.jsonl.gz") == ".jsonl" and formats.suffix_of("/a/b") == ""
    with pytest.raises(ValueError):
        formats.load(spark, "/x.unknown")
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("x") from TimeoutError()
        return "done"

    assert formats.with_retries(flaky, (TimeoutError,), delay=0) == "done"
    with pytest.raises(KeyError):
        formats.with_retries(lambda: {}["a"], (TimeoutError,), delay=0)


def test_streams_over_several_triggers(spark, tmp_path):
    rows = spark.createDataFrame([(k, i, float(i * k) if i != 3 else None) for k in (1, 2) for i in range(20)], "key bigint, o bigint, v double")
    for part in range(4):
        rows.where(F.col("o") % 4 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: stateful.source(spark, str(tmp_path / "in"), rows.schema, 1)
    got = {r["key"]: r for r in stateful.latest(stateful.finished(stateful.running_moments(stream(), "key", "v"), "update"), ["key"]).collect()}
    want = {r["key"]: r for r in rows.groupBy("key").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()}
    for k in (1, 2):
        assert got[k]["n"] == want[k]["n"] and got[k]["mean"] == pytest.approx(want[k]["m"]) and got[k]["std"] == pytest.approx(want[k]["s"])
    ring = stateful.latest(stateful.finished(stateful.ring(stream(), "key", "o", 5), "update"), ["key"]).collect()
    assert sorted(r["ord"] for r in ring if r["key"] == 1) == [15, 16, 17, 18, 19]
