"""Readers, binary formats and operators of the surveyed tools, beside the queries."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import scalar as S
from quillon.operators import asof, domains, records, tools
from quillon.plans import surveyed
from quillon.sources import formats

DOCUMENT = "--- !Missed\nPass: 'it''s'\nName: N\nFunction: f\nArgs:\n  - A: \"x: y\"\n  - A: z\n...\n"


def test_remark_files_of_several_documents(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("# a comment\n" + DOCUMENT * 3)
    (tmp_path / "b.yaml").write_text(DOCUMENT.replace("\n", "\r\n"))
    got = formats.read_remarks(spark, str(tmp_path)).collect()
    assert len(got) == 4
    for r in got:
        assert (r["remark_type"], r["pass"], r["name"], r["function"], r["args"]) == ("Missed", "it's", "N", "f", {"A": "z"})


def test_malformed_remarks_raise_whatever_is_selected(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("--- !Missed\nName: N\n...\n")
    with pytest.raises(Exception, match="without Pass"):
        formats.read_remarks(spark, str(tmp_path)).select("name").collect()
    (tmp_path / "a.yaml").write_text("")
    with pytest.raises(Exception, match="mapping type"):
        formats.read_remarks(spark, str(tmp_path)).count()


def test_binary_formats(spark, tmp_path):
    (tmp_path / "a.o").write_bytes(surveyed._elf([("f", 16, 4, 2, 1, 1), ("u", 0, 0, 0, 2, 0)]))
    got = [tuple(r)[1:] for r in formats.read_symbols(spark, str(tmp_path)).collect()]
    assert got == [("f", 16, 4, "func", "global", 1), ("u", 0, 0, "notype", "weak", None)]
    with pytest.raises(formats.ParseError):
        formats.parse_symbols(b"nothing")
    assert formats.parse_coverage(b"\x32\xff\xff\xff\xff\xff\xbf\xc0\x05\0\0\0") == [(5,)]
    with pytest.raises(formats.ParseError):
        formats.parse_coverage(b"\0" * 8)


def test_special_functions_equal_the_standard_library(spark):
    xs = [-5.5, -2.25, -0.7, -0.0, 0.0, 0.1, 0.5, 1.0, 3.3, 9.9, 25.0]
    x = F.col("x")
    rows = spark.createDataFrame([(v,) for v in xs], "x double").select(
        x, S.erf(x).alias("erf"), S.erfc(x).alias("erfc"), S.lgamma(x + 0.125).alias("l"), S.tgamma(x + 0.125).alias("g"),
        S.signbit(x).alias("sign"),
    )
    for r in rows.collect():
        v = r["x"]
        assert r["erf"] == pytest.approx(math.erf(v), abs=1e-14)
        assert r["erfc"] == pytest.approx(math.erfc(v), rel=1e-12)
        assert r["l"] == pytest.approx(math.lgamma(v + 0.125), rel=1e-12, abs=1e-13)
        assert r["g"] == pytest.approx(math.gamma(v + 0.125), rel=1e-12)
        assert r["sign"] == (math.copysign(1, v) < 0)
    poles = spark.range(1).select(S.lgamma(F.lit(-2.0)), S.tgamma(F.lit(0.0)), S.erf(F.lit(float("inf")))).head()
    assert poles[0] == math.inf and math.isnan(poles[1]) and poles[2] == 1.0


def test_spans_of_as_of_matching(spark):
    rows = [("k", "must", "a", 1), ("k", "may", "b", 2), ("k", "sink", "s1", 3), ("k", "kill", "c", 4), ("k", "sink", "s2", 4), ("k", "sink", "s3", 5)]
    events = spark.createDataFrame([(k, r, i, [t]) for k, r, i, t in rows], "key string, role string, instance string, t array<int>")
    got = {tuple(r) for r in asof.match_last_writes(events).collect()}
    assert got == {("may_dependence", "a", "s1"), ("may_dependence", "b", "s1"), ("may_dependence", "a", "s2"), ("may_dependence", "b", "s2")}


def test_lookup_of_wide_ranges(spark):
    ranges = spark.createDataFrame([(0, 1 << 50, 1), (5, 6, 2), (255, 257, 3), (7, 7, 4), (0, (1 << 63) - 1, 5)], "start_addr long, end_addr long, cnt long")
    asked = spark.createDataFrame([(5,), (5,), (256,), ((1 << 50) - 1,), ((1 << 63) - 1,)], "address long")
    got = sorted((r["address"], r["cnt"]) for r in records.lookup_addresses(asked, ranges).collect())
    big = (1 << 50) - 1
    expected = sorted([(5, c) for c in (1, 2, 5)] * 2 + [(256, c) for c in (1, 3, 5)] + [(big, 1), (big, 5)], key=str)
    assert sorted((x for x in got if x[1] is not None), key=str) == expected
    assert [x for x in [r["cnt"] for r in records.lookup_addresses(asked, ranges).where(f"address = {(1 << 63) - 1}").collect()]] == [None]


def test_recursive_stacks(spark):
    calls = [(1, "function-enter", 1), (1, "function-enter", 2), (1, "function-exit", 3), (2, "function-enter", 4), (2, "function-exit", 5), (1, "function-exit", 6), (1, "function-enter", 7)]
    trace = spark.createDataFrame([(1, f, k, t) for f, k, t in calls], "thread int, func_id int, kind string, tsc long")
    assert sorted(r["stack"] for r in records.call_stacks(trace).collect()) == [[1], [1], [1, 1], [1, 2]]
    assert records.unique_stacks(trace).head()[0] == 3


def test_a_late_job_is_cancelled(spark):
    assert tools.with_deadline(spark, lambda: surveyed._slow(spark), 0.3) is None
    assert tools.with_deadline(spark, lambda: spark.range(5).count(), 60) == 5
    with pytest.raises(ZeroDivisionError):
        tools.with_deadline(spark, lambda: 1 / 0, 60)


def test_rules_without_an_end_raise(spark):
    nodes = spark.createDataFrame([(1, "a", 1)], "id long, op string, n_args int")
    rules = spark.createDataFrame([("a", 1, "b"), ("b", 1, "a")], "op string, n_args int, new_op string")
    with pytest.raises(ValueError, match="end"):
        tools.rewrite(nodes, rules, rounds=3)


def test_empty_loops_have_no_points(spark):
    n = spark.createDataFrame([(0,), (3,)], "n long")
    got = domains.scan_domain(n, [("i", "1", "n", 1)]).collect()
    assert [(r["n"], r["i"]) for r in got] == [(3, 1), (3, 2), (3, 3)]
    assert n.select(domains.sum_over_range(F.col("n"), lambda i: i * i).alias("s")).collect()[0]["s"] == 0


@pytest.mark.parametrize("name, shown", [
    ("_Z3foov", "foo()"), ("_ZN1a1bEPKci", "a::b(char const*, int)"), ("main", "main"), ("_Z99x", "_Z99x"), ("_ZN1a", "_ZN1a"),
])
def test_demangling(name, shown):
    assert tools._demangled(name) == shown
