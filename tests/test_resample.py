"""Rows nearest in time against a search through each episode."""

from collections import defaultdict

from framemill.plans.base import steps
from framemill.plans.windows import R


def test_rows_are_nearest_in_time(spark, data_dir):
    fps = {r["episode_index"]: r["fps"] for r in spark.read.parquet(f"{data_dir}/episodes.parquet").collect()}
    rows = defaultdict(list)
    for r in steps(spark, data_dir).collect():
        t = r["ts"] if r["ts"] is not None and r["ts"] == r["ts"] else r["i"] / fps[r["ep"]] if fps.get(r["ep"]) else None
        if t is not None:
            rows[r["ep"]].append((int(t * 1_000_000 + 0.5), r["i"]))
    want = {}
    for ep, x in rows.items():
        first = min(x)[0]
        want |= {(ep, k): min((abs(us - first - k * 250_000), us, i) for us, i in x)[2] for k in range(9)}
    got = {(r["ep"], r["k"]): r["i"] for r in R.queries["resample_nearest_time"](spark, data_dir).collect()}
    assert got == want
    by_index = {(r["ep"], r["k"]): r["i"] for r in R.queries["resample_target_rate"](spark, data_dir).collect()}
    assert any(got[x] != i for x, i in by_index.items() if x in got)
