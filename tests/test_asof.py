"""The as-of rules, each as one small case."""

import pytest

from quillon.operators.asof import match_last_writes


def run(spark, events):
    rows = [("a", role, name, t) for role, name, t in events]
    df = spark.createDataFrame(rows, "key string, role string, instance string, t array<int>")
    out = {}
    for r in match_last_writes(df).collect():
        out.setdefault(r["relation"], set()).add(r["source"])
    return out


S = ("sink", "S", [1, 0])
LOOP = [("must", f"T{i}", [0, i]) for i in range(10)]
MAY = [("may", f"T{i}", [0, i]) for i in range(10)]


@pytest.mark.parametrize(
    "events, must, may, no_must, no_may",
    [
        (LOOP, {"T9"}, {"T9"}, False, False),
        ([("must", "T", [0, 0]), ("must", "U", [0, 0])], set(), {"T", "U"}, False, False),
        ([("must", "T", [0, 0]), ("must", "U", [0, 0]), ("may", "V", [0, 1])], set(), {"T", "U", "V"}, False, False),
        (LOOP[::2] + MAY[1::2], set(), {"T8", "T9"}, False, False),
        (MAY, set(), {f"T{i}" for i in range(10)}, False, True),
        (LOOP + [("kill", "T9", [0, 9])], {"T9"}, {"T9"}, False, False),
        (LOOP + [("kill", "K", [0, 9])], set(), {"T9"}, False, False),
        (LOOP + [("kill", "K", [0, 10])], set(), set(), False, False),
        (MAY + [("kill", "K", [0, 4])], set(), {f"T{i}" for i in range(4, 10)}, False, False),
        ([("must", "T", [2, 0])], set(), set(), True, True),
        ([], set(), set(), True, True),
    ],
)
def test_rules(spark, events, must, may, no_must, no_may):
    got = run(spark, [*events, S])
    assert got.get("must_dependence", set()) == must
    assert got.get("may_dependence", set()) == may
    assert ("must_no_source" in got) == no_must
    assert ("may_no_source" in got) == no_may
