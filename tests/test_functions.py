import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import arrays as A
from quillon.functions import scalar as S
from quillon.operators import records, tensor
from quillon.operators.tree import Matcher, QueryShell


def one(spark, c):
    return spark.range(1).select(c.alias("x")).head()["x"]


def test_floor_of_odd_values(spark):
    assert math.isnan(one(spark, S.floor(F.lit(S.NAN))))
    assert one(spark, S.floor(F.lit(1e300))) == 1e300


def test_saturation(spark):
    top = F.lit((1 << 63) - 1)
    assert one(spark, S.add_sat(top, top, 64)) == (1 << 63) - 1
    assert one(spark, S.sub_sat(-top, top, 64)) == -(1 << 63)


def test_rotate_and_swap(spark):
    x = F.lit(0x12345678)
    assert one(spark, S.rotate(x, 8)) == 0x34567812
    assert one(spark, S.bswap(x)) == 0x78563412
    assert one(spark, S.bitreverse(F.lit(1))) == -(1 << 31)


def test_high_products(spark):
    long = lambda v: F.lit(v).cast("bigint")
    for a, b, width in [(-1, 1, 32), (1 << 31, (1 << 33) - 1, 64), (-(1 << 63), (1 << 63) - 1, 64), (150_000 << 32, 20_000 << 32, 64)]:
        assert one(spark, S.mul_hi(long(a), long(b), width)) == a * b >> width
    assert one(spark, S.mad_hi(long(150_000 << 32), long(20_000 << 32), long(7), 64)) == 3_000_000_007


def test_special_functions(spark):
    assert one(spark, S.erf(F.lit(0.5))) == pytest.approx(math.erf(0.5))
    assert one(spark, S.erfc(F.lit(0.5))) == pytest.approx(math.erfc(0.5))
    assert one(spark, S.nextafter(F.lit(1.0), F.lit(2.0))) == math.nextafter(1.0, 2.0)
    assert one(spark, S.bessel_j(0, F.lit(1.0))) == pytest.approx(0.7651976865579666)
    assert one(spark, S.bessel_j(2, F.lit(3.0))) == pytest.approx(0.4860912605858911)
    assert one(spark, S.bessel_y(0, F.lit(1.0))) == pytest.approx(0.08825696421567698)
    assert one(spark, S.bessel_y(1, F.lit(1.0))) == pytest.approx(-0.7812128213002887)


def test_remquo_and_sincos(spark):
    r = one(spark, S.remquo(F.lit(7.0), F.lit(4.0)))
    assert (r["rem"], r["quo"]) == (-1.0, 2.0)
    assert one(spark, S.sincos(F.lit(0.0)))["cos"] == 1.0


def test_complex(spark):
    z = F.struct(F.lit(3.0).alias("re"), F.lit(4.0).alias("im"))
    assert one(spark, A.complex_abs(z)) == 5.0
    assert tuple(one(spark, A.complex_sqrt(z))) == (2.0, 1.0)
    assert tuple(one(spark, A.complex_multiply(z, A.conjugate(z)))) == (25.0, 0.0)


def test_matrix_shapes(spark):
    m = A.reshape(F.array(*map(F.lit, range(6))), 2, 3)
    assert one(spark, m) == [[0, 2, 4], [1, 3, 5]]
    assert one(spark, A.transpose(m)) == [[0, 1], [2, 3], [4, 5]]


def test_sparse_product(spark):
    a = spark.createDataFrame([(1, 2, 2.0), (2, 1, 3.0)], "i long, j long, v double")
    assert {tuple(r) for r in tensor.sparse_multiply(a, a).collect()} == {(1, 1, 6.0), (2, 2, 6.0)}


def test_query_shell(spark):
    nodes = spark.createDataFrame([(1, None, "function", "bar"), (2, 1, "variable", "x")], "id long, parent long, kind string, name string")
    shell = QueryShell(nodes)
    shell.let("func", Matcher("function", has=Matcher("variable")))
    assert [tuple(r) for r in shell.match("func", "v").collect()] == [(1, "bar", "v"), (1, "bar", "root")]
    shell.set("bind-root", "false")
    assert shell.match("func", "v").count() == 1
    with pytest.raises(ValueError):
        shell.set("none", "1")


def test_symbol_lists(spark):
    before = spark.createDataFrame([("a1",), ("b1",), ("c1",)], "name string")
    after = spark.createDataFrame([("a2",), ("b1",)], "name string")
    normal = lambda c: F.regexp_replace(c, r"\d", "")
    assert [tuple(r) for r in records.correspond(before, after, normal).collect()] == [("a1", "a2")]
    assert [r["name"] for r in records.unmatched(before, after, normal).collect()] == ["c1"]
    assert records.ambiguous(before.union(after), normal).count() == 1


def test_coverage(spark):
    f = spark.createDataFrame([("x.c", "f", 1, 3), ("x.c", "g", 5, 0)], "file string, function string, line int, count int")
    rows = {r["file"]: r["percent"] for r in records.coverage_report(f).collect()}
    assert rows == {"x.c": 50.0, None: 50.0}
    assert records.not_covered(f, f.where("count > 0").select("function")).count() == 1


def test_import_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
