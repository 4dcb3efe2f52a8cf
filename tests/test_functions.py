"""Expressions and numpy functions: captions, vectors, rotations."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framemill.functions import captions as C
from framemill.functions import rotations as rot
from framemill.functions import vectors as V


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_captions(spark):
    assert one(spark, C.with_sentence(F.lit("A cat"), F.lit("B."))) == "A cat. B."
    assert one(spark, C.with_sentence(F.lit("A cat. "), F.lit("B."))) == "A cat.  B."
    assert one(spark, C.with_sentence(F.lit(""), F.lit("B."))) == ""
    assert one(spark, C.with_sentence(F.lit(None).cast("string"), F.lit("B."))) is None
    assert one(spark, C.duration_sentence(F.lit(35), F.lit(24.0))) == "The video is 1.0 seconds long and is of 24 FPS."
    assert one(spark, C.duration_sentence(F.lit(35), F.lit(0.0))) is None
    assert one(spark, C.dense_text(F.lit(" a b... "))) == "a b."
    assert one(spark, C.dense_text(F.lit('{"a": "b"}'))) == '{"a": "b"}'


@pytest.mark.parametrize("seconds,form,want", [(3725.5, "hh:mm:ss", "01:02:05"), (3725.5, "hh:mm:ss.sss", "01:02:05.500"), (3725.25, "mm:ss.sss", "62:05.250"), (0.0, "hh:mm:ss", "00:00:00")])
def test_clocks(spark, seconds, form, want):
    assert one(spark, C.clock(F.lit(seconds), form)) == want


def test_ratios(spark):
    assert one(spark, C.reduced_ratio(F.lit(1280), F.lit(720))) == "16,9"
    assert one(spark, C.reduced_ratio(F.lit(7), F.lit(7))) == "1,1"
    assert one(spark, C.reduced_ratio(F.lit(0), F.lit(7))) == ""
    assert one(spark, C.aspect_bucket(F.lit(720), F.lit(1280))) == "9,16"


def test_window_caption(spark):
    def caption(model, enhanced, **names):
        m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        return one(spark, C.window_caption(m, model, enhanced))

    assert caption("m", "e", e_enhanced_caption=" top ", m_caption="low") == "top"
    assert caption("m", "e", e_enhanced_caption="  ", m_caption="low") == "low"
    assert caption(None, None, b_caption="b", a_caption="a", z_enhanced_caption="z") == "z"
    assert caption(None, None, b_caption="b", a_caption="a") == "a"
    assert caption("m", None, other="x") is None


def test_text_functions(spark):
    df = spark.createDataFrame([("at 1.50 and 2 or 3e2, -0.129",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(C.rounded_numbers(2)("t")).collect()] == ["at 1.5 and 2 or 300, -0.13", None, ""]
    assert one(spark, C.squeezed_repeats()(F.lit("<|pad|><|pad|><|pad|>x[a][a]"))) == "<|pad|>*3timesx[a]*2times"
    assert one(spark, C.recovered_json()(F.lit('Sure: ```json\n{"b": 1}\n``` ok'))) == '{"b":1}'
    assert one(spark, C.bare_tag(F.lit("a <x> b\nc </x>"), "x")) == "b\nc"
    assert one(spark, C.bare_tag(F.lit("none"), "x")) is None
    assert one(spark, C.renumbered_markers(F.lit("<img-1> <img-2> <img-3>"), [3, 1, 2])) == "<img-2> <img-3> <img-1>"
    assert one(spark, C.score(F.lit("about 7, say 4 of 5"))) == 4


def test_assistant_mask(spark):
    tokens = [1, 7, 9, 50, 51, 2, 1, 8, 9, 60, 2, 1, 7, 9, 70, 2]
    got = one(spark, C.assistant_mask(F.array(*[F.lit(t) for t in tokens]), 1, 2, 7))
    assert got == [i in (3, 4, 5, 14, 15) for i in range(len(tokens))]


def test_vectors(spark):
    x, lo, hi = F.array(F.lit(1.0), F.lit(5.0)), F.array(F.lit(0.0), F.lit(5.0)), F.array(F.lit(2.0), F.lit(5.0))
    for method in ("minmax", "meanstd"):
        back = V.denormalize(V.normalize(x, method, lo, hi), method, lo, hi)
        assert one(spark, back) == pytest.approx([1.0, 5.0])
    assert one(spark, V.padded(F.array(F.lit(1.0)), 3)) == [1.0, 0.0, 0.0]
    assert one(spark, V.padded(F.array(F.lit(1.0), F.lit(2.0)), 1)) is None
    for z in (-3.0, 0.4, 2.0):
        assert one(spark, V.asinh_inverse(V.asinh_scaled(F.lit(z)))) == pytest.approx(z)
    assert one(spark, V.bounded_scale(F.lit(float("nan")), F.lit(0.0), F.lit(1.0))) == 0.0
    assert one(spark, V.bounded_scale(F.lit(9.0), F.lit(0.0), F.lit(1.0))) == 1.5


FORMS = ["matrix", "rot9d", "rot6d", "quat_xyzw", "quat_wxyz", "axisangle", "euler_xyz"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-1, 1), min_size=4, max_size=4).filter(lambda q: sum(x * x for x in q) > 0.1), st.sampled_from(FORMS), st.sampled_from(FORMS))
def test_rotations_come_back(q, a, b):
    m = rot.to_matrix(np.array([q]), "quat_xyzw")
    assert np.allclose(m @ np.swapaxes(m, -1, -2), np.eye(3), atol=1e-9) and np.allclose(np.linalg.det(m), 1)
    via = rot.convert(rot.convert(m, "matrix", a), a, b)
    assert np.allclose(rot.to_matrix(via, b), m, atol=1e-5)


def test_poses_and_masks():
    rng = np.random.default_rng(1)
    p = rot.pose(rng.normal(size=(6, 3)), rng.normal(size=(6, 4)), "quat_xyzw", 2.0)
    for anchored in (False, True):
        assert np.allclose(rot.absolute(p[0], rot.relative(p, anchored), anchored), p)
    assert np.allclose(rot.angle_between(p[:, :3, :3], p[:, :3, :3]), 0, atol=1e-5)
    mask = rng.integers(0, 2, size=(7, 5)).astype(np.uint8)
    flat = mask.T.reshape(-1)
    counts, value, n = [], 0, 0
    for v in flat:
        if v != value:
            counts.append(n)
            value, n = v, 0
        n += 1
    counts.append(n)
    assert (rot.decode_rle_rows(counts, 7, 5, 2, 6) == mask[2:6]).all()
