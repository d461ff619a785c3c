import pytest
from pyspark.errors import PythonException

from quillon.operators import records
from quillon.plans import fixtures as X
from quillon.plans.reference_queries import _profile, _remarks, _text
from quillon.sources import formats


def test_empty_remarks_are_malformed():
    with pytest.raises(formats.ParseError, match="not of mapping type"):
        formats.parse_remarks("")


def test_remark_without_function_is_malformed(spark):
    text = "--- !Analysis\nPass: a\nName: b\n...\n"
    with pytest.raises(formats.ParseError, match="Function"):
        formats.parse_remarks(text)
    rows = formats.parse_each(_text(spark, text), formats.parse_remarks, formats.REMARKS, "PERMISSIVE")
    assert "Function" in rows.head()["error"]


def test_size_diff_of_equal_inputs_is_empty(spark):
    r = _remarks(spark, X.REMARKS_YAML)
    assert records.size_diff(r, r).isEmpty()


def test_size_diff_needs_instruction_counts(spark):
    r = _remarks(spark, X.REMARKS_YAML)
    with pytest.raises(ValueError, match="instruction-count"):
        records.size_diff(r, r.where("name = 'StackSize'"))


def test_non_integer_measure_raises(spark):
    r = _remarks(spark, X.REMARKS_YAML.replace("'1'", "'a'"))
    with pytest.raises(Exception):
        records.instruction_counts(r).collect()


def test_counter_mismatch_raises(spark):
    p = _profile(spark, "foo\n1024\n1\n1\n", "foo\n1024\n2\n1\n2\n")
    with pytest.raises(Exception, match="mismatch"):
        records.merge_profiles(p).collect()


def test_bad_hash_raises(spark):
    with pytest.raises(PythonException, match="not a number"):
        _profile(spark, "foo\nxyz\n1\n1\n").collect()


def test_merge_adds_elementwise(spark):
    p = _profile(spark, "foo\n3\n3\n1\n2\n3\n", "foo\n3\n3\n7\n5\n3\n")
    assert [int(c) for c in records.merge_profiles(p).head()["counters"]] == [8, 7, 6]


def test_value_sites():
    text = "foo\n1\n2\n4\n6\n1\n0\n1\n2\nbar1:40\nbar2:60\n"
    sites = formats.parse_instr_profile(text)[0][4]
    assert [(s["target"], int(s["count"])) for s in sites] == [("bar1", 40), ("bar2", 60)]


def test_sample_profile_skips_blank_lines():
    text = X.SAMPLE_PROFILE.replace("\n", "\n\n")
    assert formats.parse_sample_profile(text) == formats.parse_sample_profile(X.SAMPLE_PROFILE)


def test_empty_trace_raises(spark):
    trace = formats.parse_each(_text(spark, "records:\n"), formats.parse_trace, formats.TRACE)
    with pytest.raises(ValueError, match="No instrumented calls"):
        records.unique_stacks(trace)


def test_nested_calls_are_paired(spark):
    rows = [(1, "function-enter", 1), (2, "function-enter", 2), (2, "function-exit", 3), (1, "function-exit", 4)]
    trace = spark.createDataFrame([(0, f, 1, 7, k, t) for f, k, t in rows], formats.TRACE)
    got = {(r["func_id"], r["enter_tsc"], r["exit_tsc"]) for r in records.pair_calls(trace).collect()}
    assert got == {(1, 1, 4), (2, 2, 3)}


def test_matrix_with_missing_entries_raises():
    with pytest.raises(formats.ParseError, match="announced"):
        formats.parse_matrix(X.MATRIX.replace("5 5 7", "5 5 8"))


def test_same_input_and_output_is_refused(spark):
    with pytest.raises(ValueError, match="same file"):
        formats.write_lines(spark.range(1), "/tmp/x", source="/tmp/x/")


def test_missing_file(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        formats.read_remarks(spark, "/no/such/file").collect()


def test_files_are_read(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(X.REMARKS_YAML)
    (tmp_path / "m.mtx").write_text(X.MATRIX)
    (tmp_path / "b.bin").write_bytes(b"\0abcd\0ab\0hello\n")
    assert formats.read_remarks(spark, str(tmp_path / "a.yaml")).count() == 2
    assert formats.read_matrix(spark, str(tmp_path / "m.mtx")).count() == 7
    found = formats.read_strings(spark, str(tmp_path / "b.bin")).collect()
    assert [(r["offset"], r["string"]) for r in found] == [(1, "abcd"), (9, "hello")]


def test_split_file_keeps_line_ends(spark):
    text = spark.createDataFrame([("//--- a\r\none\r\n//--- b\ntwo\n",)], "value string")
    assert [tuple(r) for r in formats.split_file(text).collect()] == [("a", "one\r\n"), ("b", "two\n")]
