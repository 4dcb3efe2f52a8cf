"""Statistics against plain counts, ranks against sorting, and kinds of texts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framemill.llm import quality, textstats

SCHEMA = "doc_id bigint, text string, lang string, source string, row int, value double, kind string"

PROSE = "The robot opens the top drawer and waits. A child with a red scarf looks at the arm, while the light falls from the left. It is a quiet room."
KINDS = {
    PROSE: None,
    PROSE.replace(". ", ".\n"): None,
    "\n".join(PROSE[i : i + 40] for i in range(0, len(PROSE), 40)): None,
    PROSE.lower().replace(".", "").replace(",", ""): None,
    PROSE + "\n\n- a mug\n- a box": None,
    "Q. " + PROSE + "\nA. unclear": None,
    "# Notes on the arm\n\n" + PROSE + "\n\n```\n--batch 5\n--rig 7\n```": None,
    "> " + PROSE.replace(". ", ".\n> "): None,
    "- a red mug\n- the second arm\n- opens the drawer\n- a coiled cable": "list",
    "Shot list\na red mug\nthe second arm\nopens the drawer\na coiled cable\nthe tool rack": "list",
    "1) the bench;\n2) a spare battery;\n3) the operator and the robot;": "list",
    "clip,task,frames\nc1,\"wipes the counter\",40\nc2,\"opens the drawer\",50\nc3,\"waits, then goes\",60": "table",
    "| clip | task |\n|---|---|\n| c1 | wipes |\n| c2 | opens |": "table",
    "<tr><td>clip</td><td>task</td></tr>\n<tr><td>c1</td><td>wipes</td></tr>\n<tr><td>c2</td><td>opens</td></tr>": "table",
    "clip   task            n\nc1     wipes the desk  40\nc2     opens           50\nc3     waits           60": "table",
    "grey " * 60: "junk",
    "0.51 -1.2 0.33 " * 30: "junk",
    "home » login » menu » cookies » search » home » share » top »" * 3: "junk",
    "cO6Dl3y8kTWtKp+rxnYRgdLWq+yxR4Tj1wHM6Jm3KvHd4ObbKS5AeYTmtdSF3CagfZehC2lsNlVxSrrwSwbx1rnwfosob2eW7": "junk",
    "{[~*#@|!#%[:/#]$<{++[&|?>[:#*:>>[< !;@=/!|&;@]**< &##}|?}}?;~ +%#": "junk",
    "reached the goal " * 60: "junk",
    "": "junk",
}


@pytest.fixture(scope="module")
def graded(spark):
    filler = [PROSE.replace("robot", w) + f" It took {n} seconds, but nobody minded the wait." for w in ("arm", "cart", "drone", "van") for n in range(40)]
    rows = [(i, t, "en", "s", 1, 2.0, "clash") for i, t in enumerate(KINDS)] + [(100 + i, t, None, "s", 1, 2.0, "clash") for i, t in enumerate(filler)]
    rows += [(900, None, None, None, None, None, None), (None, PROSE, "en", None, None, None, None), (901, "word and " * 50_000 + "end.", "en", "s", 1, 1.0, "x")]
    return {r["doc_id"]: r for r in quality.graded(spark.createDataFrame(rows, SCHEMA)).collect()}


@pytest.mark.parametrize("i", range(len(KINDS)))
def test_kinds(graded, i):
    assert graded[i]["kind"] == list(KINDS.values())[i], list(KINDS)[i]


def test_odd_rows(graded):
    assert graded[900]["kind"] == "junk" and graded[900]["n_words"] == 0
    assert graded[None]["kind"] is None
    assert graded[901]["n_words"] == 100_001


@pytest.mark.parametrize("copied", ["- a red mug\n- the second arm\n- a coiled cable\n- a tool rack", "", None])
def test_a_third_of_all_rows_as_copies(spark, copied):
    prose = [PROSE.replace("robot", w) + f" It took {n} seconds, but nobody minded the wait." for w in ("arm", "cart") for n in range(60)]
    rows = [(i, t, "en", "s", 1, 2.0, "clash") for i, t in enumerate(prose)] + [(1000 + i, copied, "en", "s", 1, 2.0, "clash") for i in range(60)]
    rows += [(2000, "reached the goal " * 60, "fr", "s", 1, 2.0, "clash"), (2001, "clip | task\nc1 | wipes\nc2 | opens\nc3 | waits", "it", "s", 1, 2.0, "clash")]
    got = {r["doc_id"]: r["kind"] for r in quality.graded(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    assert {got[1000 + i] for i in range(60)} == {"list" if copied else "junk"}
    assert {got[i] for i in range(len(prose))} == {None}
    assert got[2001] == "table"  # the one text of its language; the single repeated one is no outlier among so few texts


def test_copies_are_ranked_once(spark):
    texts = [PROSE + f" It took {n} seconds." for n in range(120)]
    once = quality.graded(spark.createDataFrame([(i, t, "en", "s", 1, 2.0, "clash") for i, t in enumerate(texts)], SCHEMA))
    often = quality.graded(spark.createDataFrame([(i, t, "en", "s", 1, 2.0, "clash") for i, t in enumerate(texts + texts[:1] * 80)], SCHEMA))
    want = {r["doc_id"]: (r["score"], r["peak"]) for r in once.collect()}
    got = {r["doc_id"]: (r["score"], r["peak"]) for r in often.collect()}
    assert all(got[i] == pytest.approx(v) for i, v in want.items())
    assert all(got[120 + i] == pytest.approx(want[0]) for i in range(80))


def test_empty_table(spark):
    assert quality.graded(spark.createDataFrame([], SCHEMA)).collect() == []


def measure(*texts):
    return {k: v.tolist() for k, v in textstats.measure(list(texts)).items()}


def test_statistics():
    m = measure("The cat, the dog.\nA cat 12\n\n", "", "x", "l'arbre co-op 1.5", "日本 abc", "d " * 5000)
    assert [m[k][0] for k in ("n_words", "n_lines", "n_chars")] == [7, 2, 28]
    assert m["common_share"][0] == pytest.approx(3 / 7) and m["distinct_share"][0] == pytest.approx(5 / 7)
    assert m["line_end_ratio"][0] == 0.5 and m["digit_ratio"][0] == pytest.approx(2 / 28)
    assert all(v[1] == 0 for v in m.values())
    assert m["n_words"][3:] == [3, 3, 5000] and m["run_share"][5] == 1 and m["distinct_share"][5] == 1 / 5000


@given(st.lists(st.text(st.sampled_from("aé日1 .,-'\n|;#>\"!"), max_size=60), max_size=8))
@settings(max_examples=60, deadline=None)
def test_a_text_is_measured_alike_among_others(texts):
    together = measure(*texts)
    for i, t in enumerate(texts):
        assert all(v[0] == pytest.approx(together[k][i]) for k, v in measure(t).items())


def test_ranks_against_sorting(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "a", "cat", "dog", "12", "-"]) for _ in range(rng.randrange(1, 12))) + rng.choice([".", ""]), rng.choice(["en", "fr"]), "s", 1, 1.0, "x") for i in range(200)]
    stats = quality.measured(spark.createDataFrame(rows, SCHEMA))
    known = {r["row"]: r.asDict() for r in stats.collect()}
    got = {(r["row"], r["stat"]): r["p"] for r in quality.tails(stats, quality.ranks(stats)).collect()}
    assert len(got) == len(known) * len(quality.TAILS)
    groups = {}
    for r in known.values():
        groups.setdefault(r["language"], []).append(r)
    for row, r in known.items():
        mine = groups[r["language"]]
        for i, (c, side) in enumerate(quality.TAILS.items()):
            low = sum(x[c] <= r[c] for x in mine) / len(mine)
            high = sum(x[c] >= r[c] for x in mine) / len(mine)
            want = {"low": low, "high": high, "both": min(1.0, 2 * min(low, high))}[side]
            assert got[row, i] == pytest.approx(want)


def corpus(lists=6, tables=6, prose=200):
    texts = [PROSE.replace("robot", w) + f" It took {n} seconds, but nobody minded the wait." for w in ("arm", "cart", "drone", "van") for n in range(prose // 4)]
    texts += [f"Shot list {n}\na red mug\nthe second arm\nopens the drawer\na coiled cable" for n in range(lists)]
    texts += [f"clip;task;frames\nc1;wipes;{n}\nc2;opens;50\nc3;waits;60" for n in range(tables)]
    return [(i, t, "en", "s", 1, 2.0, "clash") for i, t in enumerate(texts)]


def test_the_ranks_decide(spark, monkeypatch):
    """Without tails no text but an empty one has a kind; with them the outliers are about the texts that are no prose."""
    rows = corpus() + [(999, "", "en", "s", 1, 2.0, "clash")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["kind"] for r in quality.graded(docs).collect()}
    assert [got[i] for i in range(200, 212)] == ["list"] * 6 + ["table"] * 6 and got[999] == "junk"
    assert sum(got[i] is not None for i in range(200)) <= 4
    real = quality.tails
    monkeypatch.setattr(quality, "tails", lambda stats, known: real(stats, known).withColumn("p", F.lit(1.0)))
    flat = {r["doc_id"]: r["kind"] for r in quality.graded(docs).collect()}
    assert {k: v for k, v in flat.items() if v} == {999: "junk"}


@pytest.mark.parametrize("lists", [2, 100])
def test_rare_and_frequent_kinds(spark, lists):
    got = {r["doc_id"]: r["kind"] for r in quality.graded(spark.createDataFrame(corpus(lists, 0), SCHEMA)).collect()}
    assert sum(got[i] == "list" for i in range(200, 200 + lists)) >= 0.95 * lists
    assert sum(got[i] is not None for i in range(200)) <= 4


def test_languages_with_like_codes_stay_apart(spark):
    rows = [(i, f"ang bata ay naglalaro sa labas {i}", "fil", "s", 1, 1.0, "x") for i in range(30)] + [(100 + i, f"lapsi leikkii pihalla talossa {i}", "fi", "s", 1, 1.0, "x") for i in range(30)]
    got = {r["doc_id"]: r["language"] for r in quality.measured(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == ("fil" if i < 100 else "fi") for i in got)
