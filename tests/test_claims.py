"""What the README lists as not implemented is claimed by no query."""

import re
from pathlib import Path

from framemill.plans import registries

_IDS = re.compile(r"\b([A-Z]{3}-)(\d+)(?:\.\.(?:[A-Z]{3}-)?(\d+))?")


def ids(text):
    return {f"{kind}{n:02d}" for kind, a, b in _IDS.findall(text) for n in range(int(a), int(b or a) + 1)}


def test_ids_are_not_claimed_without_code():
    readme = (Path(__file__).resolve().parents[1] / "README.md").read_text()
    missing = ids(readme.split("## Not implemented")[1].split("Open, with no query")[1])
    claimed = {n: ids(f.__doc__ or "") for r in registries() for n, f in r.queries.items()}
    assert len(missing) == 17
    assert not {n: both for n, x in claimed.items() if (both := x & missing)}
