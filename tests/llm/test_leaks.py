"""Passages against a brute-force search over all of them."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from framemill.llm import leaks


def distance_ok(part, doc):
    """Whether some stretch of doc is within one edit in eight words of ``part``: plain edit distance with free ends."""
    before = [0] * (len(doc) + 1)
    for i, a in enumerate(part):
        now = [i + 1]
        for j, b in enumerate(doc):
            now.append(min(before[j] + (a != b), before[j + 1] + 1, now[j] + 1))
        before = now
    return min(before) <= len(part) // 8


def brute(item, doc):
    return any(distance_ok(item[i : i + n], doc) for n in range(12, len(item) + 1) for i in range(len(item) - n + 1))


@settings(max_examples=600, deadline=None)
@given(st.data())
def test_passages_against_brute_force(data):
    rng = random.Random(data.draw(st.integers(0, 10**6)))
    item = [f"w{rng.randrange(9)}" if rng.random() < 0.3 else f"u{i}" for i in range(rng.randrange(10, 26))]
    lo = rng.randrange(0, max(1, len(item) - 9))
    part = item[lo : lo + rng.randrange(9, 24)]
    for _ in range(rng.randrange(0, 4)):
        if part:
            k = rng.randrange(len(part))
            change = rng.randrange(3)
            part = part[:k] + (["zz"] if change == 0 else [part[k], "yy"] if change == 1 else []) + part[k + 1 :]
    doc = [f"x{rng.randrange(99)}" for _ in range(rng.randrange(0, 6))] + part + [f"w{rng.randrange(9)}" for _ in range(rng.randrange(0, 6))]
    want = brute(item, doc)
    a, b = leaks.coded([" ".join(item)])[0], leaks.coded([" ".join(doc)])[0]
    assert len(a) == len(item) and len(b) == len(doc)
    assert leaks.holds_passage(a, b) == want
    here, there = ({} for _ in range(2))
    for codes, into in ((a, here), (b, there)):
        for h, at in zip(*leaks.all_seeds(codes, np.zeros(len(codes), int))):
            into.setdefault(int(h), []).append(int(at))
    shifts = {y - x for h in here.keys() & there.keys() for x in here[h] for y in there[h]}
    assert leaks.verified(a, b, np.array(sorted(shifts), np.int64)) == want  # no seed missed: recall is 1
    assert not want or sum(len(here[h]) * len(there[h]) for h in here.keys() & there.keys()) >= leaks.LEAST_SEEDS


def test_no_mask_is_contiguous():
    assert all(mask != tuple(range(len(mask))) for mask in leaks.MASKS) and leaks.MASKS[0][-1] < 5


def words(text):
    return [int(x) for x in leaks.coded([text])[0]]


def test_words():
    text = "<p>The  Réd</p>\n​“ca­t” &amp; **dog**’s ﬁne, x_y №5 Ｗｉｄｅ"
    assert words(text) == words("the red cat dog s fine x y no5 wide") and len(words(text)) == 10
    assert words(None) == [] and words("") == [] and words("!!") == []
    assert words("a <b> c <!-- " + "long comment " * 400 + "--> d") == words("a c d")
    assert words('a <img alt="' + "many words " * 300 + '">\nc <b\nclass="x">d') == words("a c d")
    assert words("a < b and c <d e") == words("a b and c d e") and words("<" * 500) == []
    codes, owner = leaks.coded(["a b", None, "", "c"])
    assert owner.tolist() == [0, 0, 3] and codes.tolist() == words("a b c")


ITEM = "One brass tripod leaves lighthouse 535 and the gasket blocks the sensor once more before noon arrives"


def search(spark, docs, items):
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id bigint, text string, item_id string, places int")
    q = spark.createDataFrame([(i, t, "b") for i, t in items], "item_id bigint, text string, doc_id string")
    return {tuple(r) for r in leaks.leaks(d, q).collect()}


def test_documents(spark):
    w = ITEM.split()
    docs = [
        (1, "Before. " + ITEM.upper() + " After."), (2, "so " + " ".join(w[2:14])), (3, " ".join(w[:10])), (4, " ".join([*w[:6], "NEW", *w[7:13]])),
        (5, " ".join([*w[:4], "x", *w[5:9], "y", *w[10:12]])), (6, " ".join([*w[:6], *w[7:16]])), (7, "\n".join(w)), (8, None), (9, ""), (10, " ".join(sorted(w))), (1, "Before. " + ITEM), (None, ITEM),
        (11, "filler " * 200_000 + ITEM), (12, " ".join(w[:8]) + " <!--" + " note" * 800 + "--> " + " ".join(w[8:])),
    ]
    items = [(1, ITEM), (2, ITEM), (3, "too short"), (4, None), (5, ""), (None, ITEM)]
    want = {(d, i) for d in (1, 2, 4, 6, 7, None, 11, 12) for i in (1, 2)}
    assert search(spark, docs, items) == want


def test_empty_tables(spark):
    assert search(spark, [], [(1, ITEM)]) == set() and search(spark, [(1, ITEM)], []) == set()


def test_a_crowded_hash_is_split(spark, monkeypatch):
    """Boilerplate of all items in all documents, with slices of a few seeds and a filter that is full."""
    monkeypatch.setattr(leaks, "SLICE", 3)
    monkeypatch.setattr(leaks, "MOST_BITS", 1 << 10)
    items = [(i, f"{ITEM} own{i} words{i} here{i}") for i in range(20)]
    docs = [(100 + i, "Shared: " + ITEM) for i in range(15)] + [(200, "one brass tripod leaves lighthouse")]
    assert search(spark, docs, items) == {(100 + d, i) for d in range(15) for i in range(20)}
