"""Dense captions of every prompt, whatever white space is around it, against Python's own strip."""

from framemill.functions.captions import dense_text
from framemill.plans.texts import R


def plain(x):
    bare = x.strip()
    return bare if bare.startswith("{") else bare.rstrip(".") + "."


def test_every_prompt_is_returned(spark, data_dir):
    rows = [r for r in spark.read.parquet(f"{data_dir}/t2i_pairs.parquet").collect() if r["prompt"] is not None]
    got = {r["pair_id"]: r["caption"] for r in R.queries["dense_caption_all"](spark, data_dir).collect()}
    assert got == {r["pair_id"]: plain(r["prompt"]) for r in rows}


def test_white_space_of_any_kind(spark):
    texts = ["a dog.\n", "\t a dog", "\u3000a dog..\u00a0", " {\"a\": 1}\r\n", "\x0b\x1ca\u2028b.\x85", " ", "a .", "a\n\n."]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(dense_text("t")).collect()
    assert [r[0] for r in got] == [plain(t) for t in texts]
