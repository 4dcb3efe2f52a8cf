"""Action chunks against a plain loop, schemas, pipelines and media locators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framemill.functions import pipelines, rotations
from framemill.operators import actions, schemas
from framemill.sources import media


def test_relative_chunks(spark):
    rng = np.random.default_rng(1)
    eps = {e: rng.normal(size=(n, 7)) * 0.3 for e, n in ((1, 30), (2, 5), (3, 12))}
    rows = [(e, i, x.tolist()) for e, xs in eps.items() for i, x in enumerate(xs) if not (e == 3 and i == 6)]
    rows[2] = (1, 2, [None] + rows[2][2][1:])
    rows.append((1, None, [0.0] * 7))
    reader = actions.Reader("libero", "x", chunk=4, stride=2)
    got = {(r["ep"], r["i"]): np.array(r["actions"]) for r in actions.relative_chunks(spark.createDataFrame(rows, "ep bigint, i bigint, x array<double>"), reader, block=8).collect()}
    want = {(e, i) for e, xs in eps.items() for i in range(0, len(xs) - 4, 2) if not (e == 1 and i <= 2) and not (e == 3 and i <= 6 <= i + 4)}
    assert set(got) == want
    for (e, i), a in got.items():
        part = eps[e][i : i + 5]
        poses = rotations.pose(part[:, :3], part[:, 3:6], "axisangle")
        steps = np.zeros((4, 4, 4))
        steps[:, :3, :3], steps[:, :3, 3], steps[:, 3, 3] = rotations.to_matrix(a[:, 3:9], "rot6d"), a[:, :3], 1
        assert np.allclose(rotations.absolute(poses[0], steps), poses)
        assert np.allclose(a[:, 9], part[1:, 6])


def test_loaded_actions(spark):
    df = spark.createDataFrame([("[[1.0],[2.0,3.0,4.0]]",), (None,), ("broken",)], "t string")
    got = [r[0] for r in df.select(actions.loaded_actions(F.col("t"), 3, 2)).collect()]
    assert got[0] == [[1.0, 0.0], [2.0, 3.0], [0.0, 0.0]] and got[1] == got[2] == [[0.0, 0.0]] * 3


def test_schemas(spark):
    df = spark.createDataFrame([(1, (2, (3, "x")))], "a int, b struct<c:int, d:struct<e:int, f:string>>")
    flat = schemas.flattened(df)
    assert flat.columns == ["a", "b_c", "b_d_e", "b_d_f"] and tuple(flat.first()) == (1, 2, 3, "x")
    assert schemas.nested(flat).select("a", "b.c").first() == (1, 2)
    with pytest.raises(ValueError):
        schemas.flattened(spark.createDataFrame([(1, (2,))], "b_c int, b struct<c:int>"))
    with pytest.raises(ValueError):
        schemas.without_features(spark.createDataFrame([(1,)], "index int"), ["index"])
    with pytest.raises(ValueError):
        schemas.with_features(df, {"a": F.lit(1)})
    assert schemas.matching(flat, ["^b_"], "b_").columns == ["c", "d_e", "d_f"]
    assert schemas.combined({"s": ["a"]}, {"s": ["b", "a"], "t": []}) == {"s": ["a", "b"], "t": []}
    s = schemas.from_hardware({"j1": float, "cam": (4, 6, 3), "j2": float})
    assert s.names == ["state", "cam"] and s["state"].metadata["channels"] == ["j1", "j2"]


def test_pipelines(spark):
    @pipelines.pipeline("test-odd")
    def build(least):
        def pairs(rows):
            for r in rows:
                if r["id"] % 2:
                    yield {"id": r["id"], "k": 0}
                    yield {"id": r["id"], "k": 1}

        return [pipelines.stream_step(pairs, "id bigint, k bigint", batch=2), lambda df: df.where(F.col("id") >= least)]

    got = pipelines.apply(spark.range(8), "test-odd", least=4).collect()
    assert sorted(tuple(r) for r in got) == [(5, 0), (5, 1), (7, 0), (7, 1)]
    with pytest.raises(ValueError):
        pipelines.pipeline("test-odd")(build)
    with pytest.raises(KeyError):
        pipelines.apply(spark.range(1), "absent")


def test_media(spark, tmp_path):
    closed = []
    kept = media.Kept(lambda k: k.upper(), 2, closed.append)
    assert [kept(k) for k in ("a", "b", "a", "c", "b")] == ["A", "B", "A", "C", "B"] and closed == ["B", "A"]
    for n in ("one.bin", "two.bin"):
        (tmp_path / n).write_bytes(n.encode())
    files = media.listed(spark, str(tmp_path), "*.bin")
    assert sorted(r["size_bytes"] for r in files.collect()) == [7, 7]

    def probe(path):
        if path.endswith("two.bin"):
            raise ValueError("broken")
        return {"fps": 10.0, "num_frames": 5}

    got = {r["path"][-7:]: r for r in media.probed(files, probe).collect()}
    assert got["one.bin"]["fps"] == 10.0 and got["one.bin"]["width"] is None and got["two.bin"]["error"] == "broken"
    rows = spark.createDataFrame([("p", [0.5, 1.5]), ("q", None), (None, [1.0])], "path string, times array<double>")
    frames = {r["path"]: r["frames"] for r in media.decoded(rows, "path", lambda p: lambda ts: [f"{p}{t}".encode() for t in ts], "times").collect()}
    assert frames == {"p": [bytearray(b"p0.5"), bytearray(b"p1.5")], "q": None, None: None}


def test_states_come_back():
    rng = np.random.default_rng(2)
    s, a = rng.normal(size=(9, 10)), rng.normal(size=10)
    parts = (slice(0, 5), slice(5, 6), [slice(6, 10)])
    back = actions.decode_state(actions.encode_state(s, a, *parts), a, *parts)
    assert np.allclose(back[:, :6], s[:, :6])
    assert np.allclose(rotations.to_matrix(back[:, 6:], "quat_xyzw"), rotations.to_matrix(s[:, 6:], "quat_xyzw"))


def test_a_stream_that_stands_still():
    from types import SimpleNamespace as N

    from framemill.streaming.monitor import Watch

    warned = []
    w = Watch(10, lambda k, s: warned.append(k))
    w.onQueryStarted(N(runId="a"))
    w.onQueryProgress(N(progress=N(runId="a", numInputRows=5)))
    assert w.idle() == [] and w.rows == {"a": 5} and w.triggers == {"a": 1}
    assert w.idle(w.seen["a"] + 11) == ["a"] == warned
    w.onQueryTerminated(N(runId="a"))
    assert w.idle(1e12) == []
