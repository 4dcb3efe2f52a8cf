"""Columnar shredding against a plain walk over the same JSON."""

import json
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from framemill.functions.jsontext import is_blank, parse
from framemill.operators.shredding import SUBJECT, Shredder, PROMPT_SHAPE, entries, flat_tables, record_of, shred

CHILD = {SUBJECT: "subject", f"{SUBJECT}.appearance_details[]": "appearance_details", f"{SUBJECT}.action[]": "action"}


def walk(raw):
    """(subject_pos, child, child_pos) by reading the record as it stands."""
    record = record_of(raw)
    out = set()
    subjects = (record or {}).get("prompt", {}).get("subjects")
    for i, s in enumerate(subjects if isinstance(subjects, list) else [subjects]):
        if not isinstance(s, dict) or not s:
            continue
        out.add((i, "subject", 0))
        for name in ("appearance_details", "action"):
            v = s.get(name)
            for j, x in enumerate(v if isinstance(v, list) else [v]):
                if not is_blank(x):
                    out.add((i, name, j))
    return out


SCHEMA = "record_id bigint, record_name string, raw_json string, received_at timestamp, path string, rep int"


def found(spark, raws):
    df = spark.createDataFrame([(rid, "n", raw, at, "clash", 1) for rid, raw, at in raws], SCHEMA)
    rows = entries(shred(df, paths=list(CHILD))).collect()
    return {(r["record_id"], r["subject_pos"], CHILD[r["path"]], r["child_pos"] or 0) for r in rows}


T = datetime(2025, 1, 1)
leaf = st.one_of(st.none(), st.just(""), st.just("  "), st.text(max_size=5), st.just([]), st.just({}), st.integers(0, 9), st.dictionaries(st.sampled_from(["time", "x"]), st.text(max_size=3), max_size=2))
value = st.one_of(leaf, st.lists(leaf, max_size=4))
subject = st.one_of(st.none(), st.just("none"), st.just({}), st.dictionaries(st.sampled_from(["description", "appearance_details", "action"]), value, max_size=3))
subjects = st.one_of(subject, st.lists(subject, max_size=4))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(subjects, st.integers(0, 4)), max_size=30))
def test_against_a_plain_walk(spark, cases):
    raws = []
    for i, (s, dress) in enumerate(cases):
        prompt = {"subjects": s, "background_setting": "b"}
        text = json.dumps(prompt)
        dressed = [prompt, text, json.dumps(text), f"```json\n{json.dumps(prompt, indent=1)}\n```", f"<json>{text}</json>"][dress]
        raws.append((i, json.dumps({"t2i": {"name": "n", "prompt": dressed}} if i % 2 else {"prompt": dressed}), T))
    want = {(i, *k) for i, raw, _ in raws for k in walk(raw)}
    assert found(spark, raws) == want


def test_dresses_of_json():
    for text in ('{"a": 1}', '"{\\"a\\": 1}"', '```json\n{"a": 1}\n```', "```\n{\"a\": 1}```", "<json>{\"a\": 1}</json>", "'{\"a\": 1}'", '{\\"a\\": 1}', "{&quot;a&quot;: 1}", 'Here it is: {"a": 1}.', '﻿{"a": 1}'):
        assert parse(text) == (True, {"a": 1}), text
    for text in (None, "", "  ", "plain words", '{"a": 1', '```json\n{"a": [1,\n```', '"unfinished', "[1, 2", "{'a': 1}x{"):
        assert parse(text)[0] is False, text
    assert parse("```json\n{" + " " * 300_000 + "```")[0] is False
    assert parse("```json\n" + " " * 300_000 + '{"a": 1}' + "\n" * 300_000 + "```") == (True, {"a": 1})
    assert parse("<!--" * 50_000)[0] is False and parse('```{"a": 1}```') == (True, {"a": 1})


def test_records_that_have_no_rows(spark):
    raws = [(1, None, T), (2, "", T), (3, '{"prompt": {"subjects": [{"action": "x"}', T), (4, '{"prompt": "dense text"}', T), (5, '{"prompt": "{\\"subjects\\": [{\\"action\\": \\"x"}', T), (6, "[]", T), (7, '{"prompt": null}', T), (8, "x" * 100_000, T)]
    assert found(spark, raws) == set()


def test_the_last_whole_delivery_counts(spark):
    one, two = '{"prompt": {"subjects": {"action": "x"}}}', '{"prompt": {"subjects": [null, {"action": ["y", "z"]}]}}'
    raws = [(1, one, T), (1, one, T), (1, two, datetime(2025, 1, 2)), (1, '{"prompt": {"subjects"', datetime(2025, 1, 3)), (None, one, None), (None, two, None)]
    got = found(spark, raws)
    assert {k for k in got if k[0] == 1} == {(1, 1, "subject", 0), (1, 1, "action", 0), (1, 1, "action", 1)}
    assert {k[1:] for k in got if k[0] is None} == {(0, "subject", 0), (0, "action", 0), (1, "subject", 0), (1, "action", 0), (1, "action", 1)}


def test_empty_table(spark):
    assert found(spark, []) == set()


def test_a_hot_record_and_a_very_long_one(spark):
    big = json.dumps({"prompt": {"subjects": [{"action": ["a"] * 5000, "description": "d" * 200_000}]}})
    raws = [(1, '{"prompt": {"subjects": [{"action": "x"}]}}', T)] * 500 + [(2, big, T)]
    got = found(spark, raws)
    assert sum(k[0] == 1 for k in got) == 2 and sum(k[0] == 2 for k in got) == 5001


def test_tables_are_linked(spark):
    raw = json.dumps({"name": "n", "extra": {"prompt": "q"}, "prompt": {"background_setting": "b", "subjects": [{"description": "d", "number_of_subjects": 2}, {"action": [{"time": "0:01", "description": "goes"}, "stops"]}]}})
    df = spark.createDataFrame([(5, "n", raw, T, None, None)], SCHEMA)
    t = {k: [r.asDict() for r in v.collect()] for k, v in flat_tables(df).items()}
    assert t["records"][0]["extra_prompt"] == "q" and t["records"][0]["background_setting"] == "b"
    assert sorted((r["subject_pos"], r["description"], r["number_of_subjects"]) for r in t["subjects"])[0] == (0, "d", "2")
    assert len(t["subjects"]) == 2
    assert sorted((r["subject_pos"], r["child_pos"], r["time"], r["value"]) for r in t["action"])[1] == (1, 1, None, "stops")
    assert {r["record_key"] for rows in t.values() for r in rows} == {"5"}


def test_levels():
    cols = Shredder(PROMPT_SHAPE)({"prompt": {"subjects": [{"action": ["a", None]}, None, {"action": "b"}]}})
    rep, defs, vals = cols[f"{SUBJECT}.action[]"]
    assert rep == [0, 2, 1, 1] and vals == ["a", None, None, "b"] and len(set(defs)) == 3


def test_nothing_of_a_record_is_lost(spark):
    prompt = {
        "background_setting": "b", "lighting": {"direction": "left", "haze": 3}, "cinematography": "plain", "resolution": {"H": 720, "W": 480},
        "actions": [{"time": "0:00", "description": "a"}, None, {"description": "c", "who": ["x"]}], "text_and_signage_elements": [{"category": "sign", "text": "Exit"}],
        "subjects": ["none", {"description": "d", "mood": "calm"}], "weather": {"sky": "grey"},
    }
    raw = json.dumps({"t2i": {"name": "n", "seed": 5, "version": 2, "extra": {"prompt": "q", "tags": ["r", "", "s"], "by": "z"}, "prompt": prompt}})
    df = spark.createDataFrame([(1, "n", raw, T, "clash", 1)], SCHEMA)
    t = {k: [r.asDict() for r in v.collect()] for k, v in flat_tables(df).items()}
    (r,) = t["records"]
    assert (r["lighting_direction"], r["lighting_rest"], r["resolution_H"], r["resolution_W"]) == ("left", '{"haze":3}', "720", "480")
    assert json.loads(r["prompt_rest"]) == {"cinematography": "plain", "weather": {"sky": "grey"}, "subjects": ["none", None]}
    assert (r["rest"], r["extra_rest"], r["extra_prompt"]) == ('{"version":2}', '{"by":"z"}', "q")
    assert {(x["pos"], x["time"], x["description"], x["rest"]) for x in t["actions"]} == {(0, "0:00", "a", None), (2, None, "c", '{"who":["x"]}')}
    assert [(x["pos"], x["category"], x["text"]) for x in t["text_and_signage_elements"]] == [(0, "sign", "Exit")]
    assert {(x["pos"], x["value"]) for x in t["tags"]} == {(0, "r"), (2, "s")}
    assert [(x["subject_pos"], x["rest"]) for x in t["subjects"]] == [(1, '{"mood":"calm"}')]


def test_a_pruned_shape_has_the_same_columns():
    from framemill.operators.shredding import PROMPT_SHAPE, Shredder, full_levels, pruned

    record = {"name": "n", "prompt": {"background_setting": "b", "subjects": [{"description": "d", "appearance_details": ["x", None, ""], "action": []}, None, {"action": "a"}], "actions": None}}
    whole = Shredder(PROMPT_SHAPE)(record)
    for some in ({"prompt.subjects[]"}, {"prompt.subjects[].action[]", "name"}, {"prompt.background_setting"}, {"prompt.subjects[]", "prompt.subjects[].appearance_details[]"}):
        part = Shredder(pruned(PROMPT_SHAPE, some))(record)
        assert all(part[p] == whole[p] for p in some)
    full = full_levels(PROMPT_SHAPE)
    assert set(full) == set(whole)
    details = whole["prompt.subjects[].appearance_details[]"]
    top = full["prompt.subjects[].appearance_details[]"]
    assert [top - d for d in details[1]] == [0, 1, 1, top - 3, 3]  # there, blank, blank, a blank subject, no array
    action = whole["prompt.subjects[].action[]"]
    assert [top - d for d in action[1]] == [2, top - 3, 0]  # empty, a blank subject, there


def test_json_quoted_many_times(spark):
    import json

    from framemill.functions.jsontext import parse

    text = json.dumps({"prompt": {"subjects": ["x"]}})
    for _ in range(12):
        text = json.dumps(text)
    assert parse(text) == (True, {"prompt": {"subjects": ["x"]}})
    assert parse("<a>" * 50 + "{}" + "</a>" * 50)[0] and parse('"\\"' * 3000)[0] is False
