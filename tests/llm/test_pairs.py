"""Defects of pairs, the language model on held-out questions, and truncation."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framemill.llm import language, pairs

QUESTIONS = {
    "en": ["The robot opens the top drawer in a bright workshop.", "A child with a red scarf waits near the crossing while the light turns green.", "Describe the arm that lifts the mug and places it on the bench."],
    "fr": ["Le robot ouvre le tiroir du haut dans un atelier lumineux.", "Une enfant avec une écharpe rouge attend devant le carrefour.", "Décris le bras qui soulève la tasse et la pose sur le banc."],
    "de": ["Der Roboter öffnet die oberste Schublade in einer hellen Werkstatt.", "Ein Kind mit rotem Schal wartet vor der Kreuzung.", "Beschreibe den Arm, der die Tasse hebt und auf die Bank stellt."],
    "zh": ["在明亮的车间里，机械臂打开最上面的抽屉。", "一个戴红围巾的孩子在路口前停下。", "描述把杯子放到长凳上的机械臂。"],
}
SCHEMA = "pair_id bigint, extra_prompt string, prompt string, prompt_lang string, model_mode string, defect string, word int"
BASE = [(100 + i, q, q + " " + QUESTIONS[lang][(j + 1) % 3], lang) for lang in QUESTIONS for j, q in enumerate(QUESTIONS[lang]) for i in [len(lang) * 50 + j * 7 + ord(lang[0])] for _ in range(3)]


def run(spark, cases):
    rows = [(i, q, a, lang, "m", "clash", 1) for i, q, a, lang in BASE] + [(i, q, a, None, "m", "clash", 1) for i, (q, a) in enumerate(cases)]
    got = {}
    for r in pairs.defects(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["pair_id"], set()).add(r["defect"])
    return [next(iter(got.get(i, {None}))) for i in range(len(cases))]


def test_defects(spark):
    q, other, fr = QUESTIONS["en"][0], QUESTIONS["en"][1], QUESTIONS["fr"][1]
    cases = [
        (q, None, "empty"), (q, " ​ ", "empty"), (q, "N/A", "empty"), (q, '{"subjects": [], "x": " "}', "empty"), (q, "```\n```", "empty"), (q, "...", "empty"), (None, "", "empty"),
        (q, "I'm sorry, but I can’t help with that.", "refusal"), (q, '{"error": "I cannot assist with this request."}', "refusal"), (q, "抱歉，我无法完成这个请求。", "refusal"),
        (q, "The gripper cannot reach the shelf. " + other, None), (q, "I cannot see any people. " + other, None), (q, 'A sign reads "Sorry, I cannot help you". ' + other, None),
        (q, q, "copied"), (q, q.upper(), "copied"), (q, f"Sure! {q}", "copied"), (q, f'"{q}"', "copied"), (q, '{"caption": "%s"}' % q, "copied"), (q, f"{q}\n{q}", "copied"), (q, f"{q} {other}", None),
        (q, fr, "language"), (q, '{"subject": "%s"}' % fr, "language"), (fr, other, "language"), (q, QUESTIONS["zh"][1], "language"), (q, f'{other} A board reads "{fr}".', None),
        (q, '{"caption": "%s' % other, "truncated"), (q, f"{other} The robot opens the", "truncated"), (q, f"{other} A child with a red scarf,", "truncated"), (q, other[:-1], None), (q, f"{other}\n- light: soft\n- texture: diffuse", None),
        (None, other, None), (q, other, None),
    ]
    got = run(spark, [(a, b) for a, b, _ in cases])
    assert [(c[1], g) for c, g in zip(cases, got) if g != c[2]] == []


def test_empty_table_and_long_texts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pairs.defects(empty).collect() == []
    assert run(spark, [(QUESTIONS["en"][0], (QUESTIONS["en"][1] + " ") * 5000)]) == [None]


def test_language_model_on_held_out_questions(spark, data_dir):
    """Fitted on half of the labelled questions, tried on the other half; the smallest tables hold too few of each language."""
    larger = os.path.join(os.path.dirname(data_dir), "sf0.01")
    if not os.path.isdir(larger):
        pytest.skip("the larger test tables are not here")
    df = spark.read.parquet(f"{larger}/t2i_pairs.parquet").where("prompt_lang is not null")
    model = language.fit(df.where("pair_id % 2 = 0"), "prompt_lang", "extra_prompt", "pair_id")
    rows = df.where("pair_id % 2 = 1").collect()
    got = model.posteriors([r["extra_prompt"] for r in rows])
    assert np.allclose(got.sum(1)[got.any(1)], 1)
    assert sum(model.names[p.argmax()] == r["prompt_lang"] for p, r in zip(got, rows) if p.any()) >= 0.97 * len(rows)


def test_sample_is_bounded(spark):
    rows = [(i, "the same text", "en", "en", "m", "d", 1) for i in range(50)] + [(100 + i, "le texte", "fr", "fr", "m", "d", 1) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    one = language.counts(["the same text"])[1].sum()
    seen = []
    real = language.LanguageModel
    try:
        language.LanguageModel = lambda labelled, prior: (seen.append((labelled, prior)), real(labelled, prior))[1]
        language.fit(df, "prompt_lang", "extra_prompt", "pair_id", 10)
        language.fit(df, "prompt_lang", "extra_prompt", "pair_id", 10, 10)
    finally:
        language.LanguageModel = real
    assert set(seen[0][0]) == {"en", "fr"} and seen[0][0]["en"][1].sum() == 10 * one
    assert seen[0][1] == {"en": 50.0, "fr": 20.0}  # priors count all labelled rows
    assert set(seen[1][0]) == {"en"}


def test_more_than_two_hundred_languages(spark):
    rows = [(i, f"{chr(0x4E00 + 3 * i) * 3} {chr(0x4E01 + 3 * i) * 4}", None, f"x{i:03d}", "m", "d", 1) for i in range(230)]
    model = language.fit(spark.createDataFrame(rows, SCHEMA), "prompt_lang", "extra_prompt", "pair_id")
    assert len(model.languages) == 230
    got = model.posteriors([r[1] for r in rows])
    assert [model.names[i] for i in got.argmax(1)] == [r[3] for r in rows]


@given(st.lists(st.text(st.sampled_from("abé日ß 1.,\n'\u0301"), max_size=300), min_size=1, max_size=6))
@settings(max_examples=50, deadline=None)
def test_posteriors_of_a_text_do_not_depend_on_others(texts):
    model = language.LanguageModel({"a": language.counts(["ab ab é", "a b"]), "b": language.counts(["日 日日 b"])})
    together = model.posteriors(texts)
    assert together.shape == (len(texts), 3)
    for t, p in zip(texts, together):
        assert np.allclose(model.posteriors([t])[0], p, atol=1e-4)
        assert p.sum() == pytest.approx(1, abs=1e-5) or (p.sum() == 0 and not any(map(str.isalpha, t)))


@pytest.mark.parametrize("text,words,end", [("a b. c d", "a b c d", [0, 1, 0, -1]), ("在家。走", "在 家 走", [0, 1, -1]), ("", "", []), ("x,", "x", [-1]), ('he said "stop" and', "he said stop and", [0, 1, 1, -1])])
def test_ends(text, words, end):
    got = pairs.Ends([text])
    assert got.end.tolist() == end
    assert got.word.tolist() == [int(pairs.Ends([w]).word[0]) for w in words.split()]


def test_ends_of_one_text_do_not_depend_on_others():
    texts = ["a b. c", "", "b", "x, y z\n", "日本。"]
    together = pairs.Ends(texts)
    for i, t in enumerate(texts):
        alone = pairs.Ends([t])
        mine = together.doc == i
        assert together.pair[mine].tolist() == alone.pair.tolist() and together.end[mine].tolist() == alone.end.tolist()
