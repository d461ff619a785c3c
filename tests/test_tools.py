import pytest
from pyspark.sql import functions as F

from quillon.operators import tools
from quillon.streaming import state


def test_symbols(spark):
    s = spark.createDataFrame(
        [("b", None, "external", "x86"), ("B", "text", "internal", "arm"), ("a", "text", "hidden", "arm")],
        "name string, section string, linkage string, arch string",
    )
    assert [r["name"] for r in tools.undefined_only(s).collect()] == ["b"]
    assert {r["name"] for r in tools.external_only(s).collect()} == {"a", "b"}
    assert [r["name"] for r in tools.sort_symbols(s).collect()] == ["B", "a", "b"]
    assert tools.of_architecture(s, "arm").count() == 2


def test_extract_function(spark):
    f = spark.createDataFrame(
        [("foo", "body", ["bar"]), ("bar", "b2", []), ("zed", "b3", [])], "name string, body string, calls array<string>"
    )
    assert {(r["name"], r["body"]) for r in tools.extract_function(f, "foo").collect()} == {("foo", "body"), ("bar", None)}


@pytest.mark.parametrize(
    "text, value", [("a && b", True), ("a && !b", False), ("c || (a && b)", True), ("!c", True), ("a && c || b", True)]
)
def test_requirements(text, value):
    assert tools.requirement(text, {"a", "b"}) is value


@pytest.mark.parametrize("text", ["", "a &&", "(a", "a b", "a @ b"])
def test_bad_requirements(text):
    with pytest.raises(ValueError):
        tools.requirement(text, {"a"})


def test_names(spark):
    df = spark.createDataFrame([("i",), ("zz",), ("at {{{symbol:_Zf}}} and {{{symbol:g}}}",)], "x string")
    assert [r[0] for r in df.select(tools.render_names(F.col("x"), tools.TYPE_NAMES)).collect()][:2] == ["int", "zz"]
    assert df.select(tools.render_markup(F.col("x"), {"_Zf": "f()"})).collect()[2][0] == "at f() and g"


def test_scopes(spark):
    uses = spark.createDataFrame([(1, "x", 2), (2, "y", 2), (3, "z", 2)], "id long, name string, scope long")
    defs = spark.createDataFrame([(10, "x", 1), (11, "x", 2), (12, "y", 1)], "id long, name string, scope long")
    scopes = spark.createDataFrame([(2, 2, 0), (2, 1, 1), (1, 1, 0)], "scope long, outer long, depth int")
    got = {r["id"]: r["definition"] for r in tools.resolve_names(uses, defs, scopes).collect()}
    assert got == {1: 11, 2: 12, 3: None}


def test_order(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (0, 2)], "before long, after long")
    assert {r["id"]: r["level"] for r in tools.topological_order(nodes, edges).collect()} == {0: 0, 1: 1, 2: 2, 3: 0}
    cycle = edges.union(spark.createDataFrame([(2, 0)], "before long, after long"))
    with pytest.raises(ValueError, match="cycle"):
        tools.topological_order(nodes, cycle)


def test_order_has_no_round_cap(spark, monkeypatch):
    # any cap on the rounds, made short: a chain is no cycle however long it is
    monkeypatch.setattr(tools, "range", lambda n: iter([0, 1, 2]), raising=False)
    nodes = spark.createDataFrame([(i,) for i in range(8)], "id long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(7)], "before long, after long")
    assert {r["id"]: r["level"] for r in tools.topological_order(nodes, edges).collect()} == {i: i for i in range(8)}
    cycle = edges.union(spark.createDataFrame([(7, 6)], "before long, after long"))
    with pytest.raises(ValueError, match="cycle"):
        tools.topological_order(nodes, cycle)


def test_epoch_text(spark):
    assert spark.range(1).select(tools.epoch_text(F.lit(305419896))).head()[0] == "1979-09-05 22:51:36"
    with pytest.raises(Exception, match="32-bit"):
        spark.range(1).select(tools.epoch_text(F.lit(1 << 32))).collect()


def test_templates_and_overrides(spark):
    names = spark.createDataFrame([("r",), ("s",)], "name string")
    made = tools.expand_templates(names, spark.createDataFrame([("_lo", 1), ("_hi", 2)], "template string, value int"))
    assert {tuple(r) for r in made.collect()} == {("r_lo", 1), ("r_hi", 2), ("s_lo", 1), ("s_hi", 2)}
    df = spark.createDataFrame([(1, 2)], "x int, y int")
    assert tuple(tools.override(df, {"x": F.lit(3)}, {"y": lambda: F.col("x") + 1}).head()) == (3, 4)
    with pytest.raises(Exception, match="not a Bla"):
        tools.must_have(spark.createDataFrame([("Foo",)], "kind string"), "Bla").collect()


def test_formatters_and_children(spark):
    df = spark.createDataFrame([("Box", "1"), ("std::vec", "2"), ("int", "3")], "kind string, v string")
    f = tools.Formatters(spark)
    f.register("Box", lambda c: F.concat(F.lit("box "), c))
    f.register_pattern("std::.*", lambda c: F.concat(c, F.lit(" items")))
    assert [r["summary"] for r in f.summaries(df, "kind", "v").collect()] == ["box 1", "2 items", None]
    kids = tools.children_provider(df, lambda r: int(r["v"]), lambda r, i: (r["kind"], i), "kind string, i long")
    assert kids.count() == 6


def test_lines_with_remarks(spark):
    text = spark.createDataFrame([("a.c", "x\ny\r\nz")], "file string, value string")
    remarks = spark.createDataFrame([("a.c", 2, "unroll"), ("a.c", 2, "unroll")], "file string, line int, name string")
    got = {r["line"]: r["remarks"] for r in tools.remarks_by_line(tools.number_lines(text), remarks).collect()}
    assert got == {1: None, 2: ["unroll"], 3: None}


def test_metrics_and_duplicates(spark):
    t = spark.createDataFrame([("PASS", {"a": 1.0}), ("PASS", {"a": 2.0}), ("FAIL", None)], "status string, data map<string,double>")
    assert {(r["status"], r["metric"], r["total"]) for r in tools.metrics(t).collect()} == {("PASS", "a", 3.0), ("FAIL", None, None)}
    d = spark.createDataFrame([(1, "i32", "5"), (2, "i32", "5"), (3, "i64", "5")], "id long, type string, v string")
    assert {r["id"] for r in tools.structural_duplicates(d, ["type", "v"]).collect()} == {1, 3}


def test_running_totals(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    query = (
        state.running_totals(events).writeStream.outputMode("update").format("memory").queryName("totals")
        .option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {r["user_id"]: r["n"] for r in spark.table("totals").collect()}
    expected = {r["user_id"]: r["count"] for r in spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").count().collect()}
    assert got == expected
