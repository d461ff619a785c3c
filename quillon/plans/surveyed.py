"""Queries of the surveyed sources, sinks, filters, joins, orders and callbacks.

They run over the driver's whole tables: rows are written in a surveyed format to
the shared folder, read back by the reader of that format, and compared with the
table itself; symbols, remarks, records and traces are views of the tables."""

from __future__ import annotations

import struct
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import scalar as S
from ..operators import domains, records, tensor, tools, tree
from ..sources import formats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = tempfile.mkdtemp(prefix="quillon-files-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _put(spark: SparkSession, path: str, data: bytes) -> str:
    """A small file of bytes, written by the driver through Spark's file system."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(data))
    out.close()
    return path


def _refused(action) -> str:
    """The kind of error that an action raises, or 'none'."""
    try:
        action()
    except Exception as e:
        name = e.getCondition() if hasattr(e, "getCondition") and e.getCondition() else type(e).__name__
        return name.split(".")[0]
    return "none"


def _rows(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


# sources and sinks


def source_remarks(spark, sf_dir):
    """A remark for each part, as YAML files and back."""
    p = _table(spark, sf_dir, "part")
    lines = p.select(
        F.concat_ws(
            "\n",
            F.concat(F.lit("--- !"), F.when(F.col("p_size") > 25, "Missed").otherwise("Passed")),
            F.concat(F.lit("Pass:            '"), "p_type", F.lit("'")),
            F.concat(F.lit("Name:            "), F.replace("p_brand", F.lit("#"), F.lit("_"))),
            F.concat(F.lit("Function:        f"), F.col("p_partkey").cast("string")),
            F.lit("Args:"),
            F.concat(F.lit("  - NumInstructions: '"), F.col("p_size").cast("string"), F.lit("'")),
            F.concat(F.lit('  - String:          "'), "p_type", F.lit('"')),
            F.lit("  - String:          ' done'"),
            F.lit("..."),
        ).alias("value")
    )
    path = _folder(spark, "remarks")
    formats.write_lines(lines, path)
    return formats.read_remarks(spark, path).select(
        "remark_type", "pass", "name", "function",
        F.col("args")["NumInstructions"].cast("int").alias("instructions"), F.size("args").alias("n_args"),
        F.col("args")["String"].alias("text"),
    )


SOURCE_REMARKS = """SELECT CASE WHEN p_size > 25 THEN 'Missed' ELSE 'Passed' END AS remark_type, p_type AS pass,
    replace(p_brand, '#', '_') AS name, 'f' || p_partkey AS function, p_size AS instructions,
    CAST(2 AS INT) AS n_args, ' done' AS text FROM part"""


def source_instr_profile(spark, sf_dir):
    """Instrumentation profiles of customers: text sink, blank lines, rescan,
    weighted union of two profiles by name, binary form and rescan."""
    c = _table(spark, sf_dir, "customer").select(
        F.concat(F.lit("f"), F.col("c_nationkey").cast("string"), F.lit("_"), (F.col("c_custkey") % 50).cast("string")).alias("name"),
        F.col("c_nationkey").cast("decimal(20,0)").alias("hash"),
        F.array(F.col("c_custkey"), F.lit(7), F.lit(0)).cast("array<decimal(20,0)>").alias("counters"),
    )
    first, second = _folder(spark, "profile"), _folder(spark, "profile")
    formats.write_lines(formats.instr_profile_lines(c), first)
    formats.write_lines(formats.instr_profile_lines(c.where("hash < 10")), second)
    both = formats.read_instr_profile(spark, first).withColumn("w", F.lit(1)).unionByName(
        formats.read_instr_profile(spark, second).withColumn("w", F.lit(3))
    )
    binary = _folder(spark, "profile-binary")
    formats.write_profile(records.merge_profiles(both, "w"), binary)
    merged = formats.read_profile(spark, binary)
    return merged.select(
        "name", F.col("hash").cast("bigint").alias("hash"),
        *(F.col("counters")[k].cast("bigint").alias(f"c{k}") for k in range(3)),
    )


SOURCE_PROFILE = """SELECT 'f' || c_nationkey || '_' || (c_custkey % 50) AS name, CAST(c_nationkey AS BIGINT) AS hash,
    CAST(sum(c_custkey * CASE WHEN c_nationkey < 10 THEN 4 ELSE 1 END) AS BIGINT) AS c0,
    CAST(sum(7 * CASE WHEN c_nationkey < 10 THEN 4 ELSE 1 END) AS BIGINT) AS c1, CAST(0 AS BIGINT) AS c2
    FROM customer GROUP BY 1, 2"""


def source_sample_profile(spark, sf_dir):
    """Sample profiles of orders by customer: text sink, rescan, generated names
    left out, order by falling total."""
    o = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("head"),
        F.sum(F.floor("o_totalprice").cast("bigint")).alias("total"),
        F.collect_list(F.struct((F.col("o_orderkey")).cast("bigint").alias("line"), F.floor("o_totalprice").cast("bigint").alias("samples"))).alias("lines"),
    )
    name = F.when(F.col("o_custkey") % 10 == 0, F.lit("__cxx_global_var_init.")).otherwise(F.lit("fn"))
    o = o.select(F.concat(name, F.col("o_custkey").cast("string")).alias("name"), "head", "total", "lines")
    path = _folder(spark, "samples")
    formats.write_lines(formats.format_sample_profile(o), path)
    read = records.drop_generated(formats.read_sample_profile(spark, path).drop("file", "error"))
    top = records.order_samples(read).select(F.col("path")[0].alias("name"), "total", "head")
    lines = read.where("line is not null").groupBy(F.col("path")[0].alias("name")).agg(
        F.count("*").alias("n_lines"), F.sum("samples").alias("samples")
    )
    return top.join(lines, "name")


SOURCE_SAMPLES = """SELECT 'fn' || o_custkey AS name, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS total,
    count(*) AS head, count(*) AS n_lines, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS samples
    FROM orders WHERE o_custkey % 10 <> 0 GROUP BY o_custkey"""


def source_names(spark, sf_dir):
    """Symbol lists and their union; printable strings of binary files; parts of
    files of several documents; files found by a glob."""
    n = _table(spark, sf_dir, "nation")
    base = _folder(spark, "names")
    formats.write_lines(n.where("n_regionkey < 3").select(F.concat(F.lit("# list\n\n  "), "n_name").alias("value")), f"{base}/a.list")
    formats.write_lines(n.where("n_regionkey > 1").select("n_name"), f"{base}/b.list")
    union = formats.read_symbol_list(spark, f"{base}/a.list").union(formats.read_symbol_list(spark, f"{base}/b.list")).distinct()
    c = _table(spark, sf_dir, "supplier")
    noise = F.lit("\x01ab\x02")
    formats.write_lines(c.select(F.concat(noise, "s_name", noise, F.substring("s_name", -3, 3), F.lit("\x7f")).alias("value")), f"{base}/s.bin")
    strings = formats.read_strings(spark, f"{base}/s.bin/part-*").select("string")
    parts = n.select(
        F.concat(F.lit("//--- "), "n_name", F.lit(".txt\n"), F.lit("line of "), "n_name", F.lit("\r\n")).alias("value")
    )
    split = formats.split_file(parts).select(F.concat_ws("|", "name", F.length("content").cast("string")))
    globbed = spark.read.text(f"{base}/[ab].list").where("value <> '' and value not like '#%'").select(F.trim("value"))
    return (
        union.select(F.lit("symbol list").alias("source"), F.col("name").alias("value"))
        .union(strings.select(F.lit("strings"), "string"))
        .union(split.select(F.lit("split"), "*"))
        .union(globbed.select(F.lit("glob"), "*"))
    )


SOURCE_NAMES = r"""
SELECT 'symbol list' AS source, n_name AS value FROM nation UNION ALL
SELECT 'strings', s_name FROM supplier UNION ALL
SELECT 'split', n_name || '.txt|' || (length(n_name) + 10) FROM nation UNION ALL
SELECT 'glob', n_name FROM nation WHERE n_regionkey < 3 UNION ALL SELECT 'glob', n_name FROM nation WHERE n_regionkey > 1"""


def source_numbers(spark, sf_dir):
    """Traces of events, a matrix of nations, address ranges of suppliers: written
    as text and read back."""
    base = _folder(spark, "numbers")
    e = _table(spark, sf_dir, "events").where("event_id % 7 = 0")
    formats.write_lines(
        e.select(F.concat(
            F.lit("  - { type: 0, func-id: "), (F.col("event_id") % 11).cast("string"), F.lit(", cpu: 1, thread: "),
            F.col("user_id").cast("string"), F.lit(", kind: function-enter, tsc: "), F.col("event_id").cast("string"), F.lit(" }"),
        ).alias("value")), f"{base}/trace")
    trace = formats.read_trace(spark, f"{base}/trace").select(F.lit("trace").alias("source"), F.col("tsc").alias("a"), F.col("thread").cast("bigint").alias("b"), F.col("func_id").cast("double").alias("v"))
    cells = _table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("i"), (F.col("n_regionkey") + 1).alias("j"), F.length("n_name").alias("v"))
    size = cells.agg(F.concat(F.lit("%%MatrixMarket matrix coordinate real general\n% nations\n25 5 "), F.count("*").cast("string")).alias("value"))
    body = cells.agg(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat_ws(" ", F.col("i").cast("string"), F.col("j").cast("string"), F.col("v").cast("string"))))).alias("value"))
    text = size.select("value", F.lit(0).alias("k")).union(body.select("value", F.lit(1))).agg(  # 25 cells: one file by its form
        F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("k", "value"))), lambda x: x["value"])).alias("value")
    )
    formats.write_lines(text, f"{base}/matrix")
    matrix = formats.read_matrix(spark, f"{base}/matrix/part-*").where("i is not null").select(F.lit("matrix"), "i", "j", "re")
    s = _table(spark, sf_dir, "supplier")
    formats.write_lines(
        s.select(F.concat(
            F.lit("1\n"), F.lower(F.hex(F.col("s_suppkey") * 256)), F.lit("-"), F.lower(F.hex(F.col("s_suppkey") * 256 + 17)),
            F.lit(":"), F.col("s_nationkey").cast("string")).alias("value"),
        ), f"{base}/ranges")
    ranges = formats.parse_each(
        formats.lines_of(spark, f"{base}/ranges", 2), formats.parse_ranges, formats.RANGES
    ).select(F.lit("ranges"), "start_addr", "end_addr", F.col("cnt").cast("double"))
    return trace.union(matrix).union(ranges)


SOURCE_NUMBERS = """
SELECT 'trace' AS source, CAST(event_id AS BIGINT) AS a, CAST(user_id AS BIGINT) AS b, CAST(event_id % 11 AS DOUBLE) AS v FROM events WHERE event_id % 7 = 0
UNION ALL SELECT 'matrix', n_nationkey + 1, n_regionkey + 1, length(n_name) FROM nation
UNION ALL SELECT 'ranges', s_suppkey * 256, s_suppkey * 256 + 17, s_nationkey FROM supplier"""


def _elf(symbols: list[tuple[str, int, int, int, int, int]]) -> bytes:
    """A 64-bit object file with a symbol table alone: (name, value, size, type,
    binding, section)."""
    names, entries = b"\0", b"\0" * 24
    for name, value, size, kind, binding, section in symbols:
        entries += struct.pack("<IBBHQQ", len(names), binding << 4 | kind, 0, section, value, size)
        names += name.encode() + b"\0"
    table = 64 + len(entries) + len(names)
    head = b"\x7fELF\x02\x01\x01" + b"\0" * 9 + struct.pack("<HHIQQQIHHHHHH", 1, 62, 1, 0, 0, table, 0, 64, 0, 0, 64, 3, 0)
    sections = [
        struct.pack("<IIQQQQIIQQ", 0, 0, 0, 0, 0, 0, 0, 0, 0, 0),
        struct.pack("<IIQQQQIIQQ", 0, 2, 0, 0, 64, len(entries), 2, 1, 8, 24),
        struct.pack("<IIQQQQIIQQ", 0, 3, 0, 0, 64 + len(entries), len(names), 0, 0, 1, 0),
    ]
    return head + entries + names + b"".join(sections)


def source_binary(spark, sf_dir):
    """Symbol tables of object files and points of coverage files, a file for each
    region."""
    n = _table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows by the benchmark's rules
    base = _folder(spark, "binary")
    for region in {r["n_regionkey"] for r in n}:
        own = [r for r in n if r["n_regionkey"] == region]
        _put(spark, f"{base}/o/{region}.o", _elf([
            (r["n_name"], 16 * r["n_nationkey"], r["n_nationkey"], 2 if r["n_nationkey"] % 2 else 1, r["n_nationkey"] % 2, r["n_nationkey"] % 4)
            for r in own
        ]))
        _put(spark, f"{base}/c/{region}.sancov", struct.pack(f"<{len(own) + 1}Q", 0xC0BFFFFFFFFFFF64, *(4096 + r["n_nationkey"] for r in own)))
    symbols = formats.read_symbols(spark, f"{base}/o").select(
        F.lit("symbol").alias("kind"), "name", "value", "size", "type", "binding", "section"
    )
    points = formats.read_coverage(spark, f"{base}/c").select(
        F.lit("point"), F.lit(None).cast("string"), "address", *(F.lit(None).cast(t) for t in ("bigint", "string", "string", "int"))
    )
    return symbols.union(points)


SOURCE_BINARY = """
SELECT 'symbol' AS kind, n_name AS name, CAST(16 * n_nationkey AS BIGINT) AS value, CAST(n_nationkey AS BIGINT) AS size,
    CASE WHEN n_nationkey % 2 = 1 THEN 'func' ELSE 'object' END AS type,
    CASE WHEN n_nationkey % 2 = 1 THEN 'global' ELSE 'local' END AS binding, CAST(nullif(n_nationkey % 4, 0) AS INT) AS section FROM nation
UNION ALL SELECT 'point', NULL, 4096 + n_nationkey, NULL, NULL, NULL, NULL FROM nation"""


def source_sinks(spark, sf_dir):
    """CSV rows appended, JSON statistics and traces, lcov and JSON coverage:
    written, read back and put in one form."""
    base = _folder(spark, "sinks")
    r = _table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("bigint").alias("n"))
    for k in range(2):  # a run appends its rows to those of the run before
        formats.append_csv(r.withColumn("run", F.lit(k)), f"{base}/stats.csv")
    csv = spark.read.csv(f"{base}/stats.csv", schema="name string, n bigint, run int")
    formats.write_json(r, f"{base}/stats.json")
    stats = spark.read.json(f"{base}/stats.json")
    e = _table(spark, sf_dir, "events").select(
        F.lit("X").alias("ph"), F.col("event_type").alias("name"), F.col("event_id").cast("bigint").alias("ts"), F.struct(F.col("user_id").cast("bigint").alias("user")).alias("args")
    )
    formats.write_json(e, f"{base}/trace.json")
    trace = spark.read.schema("ph string, name string, ts bigint, args struct<user: bigint>").json(f"{base}/trace.json")
    s = _table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("dir/"), F.col("s_nationkey").cast("string"), F.lit(".c")).alias("file"), F.col("s_name").alias("function"),
        F.col("s_suppkey").cast("int").alias("line"), (F.col("s_suppkey") % 3).cast("int").alias("count"),
    )
    formats.write_lines(formats.lcov_lines(s), f"{base}/lcov")
    lcov = spark.read.text(f"{base}/lcov").where("value like 'FNDA:%'").select(
        F.regexp_extract("value", "^FNDA:([0-9]+),(.*)$", 2), F.regexp_extract("value", "^FNDA:([0-9]+),(.*)$", 1).cast("bigint")
    )
    formats.write_json(s.groupBy("file").agg(F.collect_list(F.struct("function", "count")).alias("functions")), f"{base}/coverage.json")
    coverage = spark.read.schema("file string, functions array<struct<function: string, count: int>>").json(f"{base}/coverage.json")
    return (
        csv.select(F.lit("csv").alias("sink"), "name", (F.col("n") * 10 + F.col("run")).alias("n"))
        .union(stats.select(F.lit("json"), "name", "n"))
        .union(trace.select(F.lit("trace"), "name", F.col("ts") * 1000 + F.col("args.user") % 1000))
        .union(lcov.select(F.lit("lcov"), "*"))
        .union(coverage.select(F.lit("coverage"), "file", F.aggregate("functions", F.lit(0).cast("bigint"), lambda t, x: t + x["count"])))
    )


SOURCE_SINKS = """
SELECT 'csv' AS sink, r_name AS name, CAST(r_regionkey * 10 + k AS BIGINT) AS n FROM region, (VALUES (0), (1)) v(k)
UNION ALL SELECT 'json', r_name, r_regionkey FROM region
UNION ALL SELECT 'trace', event_type, event_id * 1000 + user_id % 1000 FROM events
UNION ALL SELECT 'lcov', s_name, s_suppkey % 3 FROM supplier
UNION ALL SELECT 'coverage', 'dir/' || s_nationkey || '.c', sum(s_suppkey % 3) FROM supplier GROUP BY s_nationkey"""


def source_errors(spark, sf_dir):
    """What readers and sinks refuse, and rows that a permissive read marks."""
    n = _table(spark, sf_dir, "nation")
    base = _folder(spark, "errors")
    _put(spark, f"{base}/empty.yaml", b"")
    _put(spark, f"{base}/no-pass.yaml", b"--- !Missed\nName: x\nFunction: f\n...\n")
    _put(spark, f"{base}/short.prof", b"foo\n1\n3\n5\n")
    _put(spark, f"{base}/stack.txt", b"0x10 f\n0x20 g\n\n[truncated]\n")
    cases = [
        ("missing file", _refused(lambda: formats.read_remarks(spark, f"{base}/none.yaml"))),
        ("same input and output", _refused(lambda: formats.write_lines(n.select("n_name"), f"{base}/x", f"{base}/x/"))),
        ("deadline", "late" if tools.with_deadline(spark, lambda: _slow(spark), 0.5) is None else "in time"),
        ("no deadline", str(tools.with_deadline(spark, lambda: n.count(), 600))),
        ("no size remarks", _refused(lambda: records.size_diff(_remarks_of(n), _remarks_of(n)))),
        ("subtract reduction", _refused(lambda: tools.reduction("-", "n_nationkey"))),
        ("user reduction", _refused(lambda: tools.reduction(".min.", "n_nationkey"))),
        ("power reduction", _refused(lambda: tools.reduction("**", "n_nationkey"))),
        ("bound below zero", _refused(lambda: tools.bounded(n, -1, ["n_name"]))),
        ("cycle", _refused(lambda: tools.topological_order(
            _rows(spark, "id bigint", [(1,), (2,)]), _rows(spark, "before bigint, after bigint", [(1, 2), (2, 1)])))),
        ("empty trace", _refused(lambda: records.unique_stacks(_rows(spark, "thread int, func_id int, kind string, tsc bigint", [])))),
        ("wrong kind", _refused(lambda: tools.must_have(n.select(F.lit("Foo").alias("kind")), "Bla").collect())),
        ("not an integer", _refused(lambda: records.instruction_counts(_remarks_of(n, "x")).collect())),
        ("no such option", _refused(lambda: tree.QueryShell(n).set("none", "1"))),
        ("unknown category", _refused(lambda: n.select(tools.categories(F.col("n_name"), ["NONE"])).collect())),
    ]
    marked = formats.read_remarks(spark, base + "/*.yaml", "PERMISSIVE").where("error is not null").select(
        F.regexp_extract("file", "([^/]*)$", 1).alias("case"), F.col("error").alias("result")
    )
    short = formats.read_instr_profile(spark, f"{base}/*.prof", "PERMISSIVE").select(
        F.regexp_extract("file", "([^/]*)$", 1), "error"
    )
    stack = formats.read_stacks(spark, f"{base}/stack.txt").select(F.lit("stack.txt"), F.coalesce("warning", F.lit("whole")))
    return _rows(spark, "case string, result string", cases).union(marked).union(short).union(stack)


def _slow(spark):
    """Some minutes of work that nothing cuts short but a cancelled job."""
    return spark.range(0, 1 << 36, 1, 4).selectExpr("bit_xor(xxhash64(id))").head()


def _remarks_of(n: DataFrame, value: str | None = None) -> DataFrame:
    name = "InstructionCount" if value else "Other"
    args = F.create_map(F.lit("NumInstructions"), F.lit(value or "1"))
    return n.select(F.lit(name).alias("name"), F.col("n_name").alias("function"), args.alias("args"))


def _values(rows, columns):
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({', '.join(columns)})"


SOURCE_ERRORS = _values([
    ("missing file", "PATH_NOT_FOUND"), ("same input and output", "ValueError"), ("deadline", "late"), ("no deadline", "25"),
    ("no size remarks", "ValueError"), ("subtract reduction", "ValueError"), ("user reduction", "ValueError"),
    ("power reduction", "ValueError"), ("bound below zero", "ValueError"), ("cycle", "ValueError"), ("empty trace", "ValueError"),
    ("wrong kind", "USER_RAISED_EXCEPTION"), ("not an integer", "CAST_INVALID_INPUT"), ("no such option", "ValueError"),
    ("unknown category", "USER_RAISED_EXCEPTION"), ("empty.yaml", "document root is not of mapping type"),
    ("no-pass.yaml", "remark without Pass"), ("short.prof", "truncated profile"), ("stack.txt", "whole"), ("stack.txt", "truncated stack"),
], ['"case"', "result"])


# symbols, remarks and reports


def _symbols(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.element_at(F.split("p_name", " "), 1), F.lit("_"), F.col("p_partkey").cast("string")).alias("name"),
        F.when(F.col("p_size") % 5 > 0, F.concat(F.lit(".text."), (F.col("p_size") % 7).cast("string"))).alias("section"),
        F.when(F.col("p_size") % 3 == 0, "internal").when(F.col("p_size") % 3 == 1, "hidden").otherwise("external").alias("linkage"),
        F.when(F.col("p_size") % 2 == 0, "arm").otherwise("x86").alias("arch"),
        "p_partkey", "p_size", "p_type", "p_brand",
    )


_SYMBOLS = """s AS (SELECT split_part(p_name, ' ', 1) || '_' || p_partkey AS name,
    CASE WHEN p_size % 5 > 0 THEN '.text.' || (p_size % 7) END AS section,
    CASE p_size % 3 WHEN 0 THEN 'internal' WHEN 1 THEN 'hidden' ELSE 'external' END AS linkage,
    CASE WHEN p_size % 2 = 0 THEN 'arm' ELSE 'x86' END AS arch, * FROM part)"""


def symbol_filters(spark, sf_dir):
    """Filters of symbol tables and reports, over parts; one row for each hit."""
    s = _symbols(spark, sf_dir)
    remarks = s.select("name", F.col("p_type").alias("pass"), F.col("p_brand").alias("section"))
    profiles = s.select("name", F.array(F.lit(0), F.when(F.col("p_size") > 40, 1).otherwise(0)).alias("counters"))
    paths = s.select("name", F.array(F.when(F.col("p_size") == 1, F.concat(F.lit("__tls_init_"), "name")).otherwise(F.col("name"))).alias("path"))
    nodes = s.select("name", F.col("p_brand").alias("op"))
    traits = _rows(spark, "op string, trait string", [("Brand#11", "constant"), ("Brand#12", "constant"), ("Brand#12", "pure")])
    found = {
        "undefined": tools.undefined_only(s), "external": tools.external_only(s), "architecture": tools.of_architecture(s, "arm"),
        "report": tools.report(remarks, "^STANDARD"), "suppressed": tools.report(remarks, None, ("small_0",)),
        "sections": tools.without_sections(remarks, "Brand#1", "Brand#2"), "covered": records.covered_functions(profiles),
        "generated": records.drop_generated(paths), "trait": tools.with_trait(nodes, traits, "constant"),
    }
    out = None
    for label, rows in found.items():
        own = rows.select(F.lit(label).alias("filter"), "name")
        out = own if out is None else out.union(own)
    return out


SYMBOL_FILTERS = f"""WITH {_SYMBOLS}
SELECT 'undefined' AS filter, name FROM s WHERE section IS NULL UNION ALL
SELECT 'external', name FROM s WHERE linkage <> 'internal' UNION ALL
SELECT 'architecture', name FROM s WHERE arch = 'arm' UNION ALL
SELECT 'report', name FROM s WHERE p_type LIKE 'STANDARD%' UNION ALL
SELECT 'suppressed', name FROM s WHERE name <> 'small_0' UNION ALL
SELECT 'sections', name FROM s WHERE p_brand NOT IN ('Brand#1', 'Brand#2') UNION ALL
SELECT 'covered', name FROM s WHERE p_size > 40 UNION ALL
SELECT 'generated', name FROM s WHERE p_size <> 1 UNION ALL
SELECT 'trait', name FROM s WHERE p_brand IN ('Brand#11', 'Brand#12')"""


def symbol_joins(spark, sf_dir):
    """Correspondence, ambiguity and gaps of two symbol lists, module differences,
    functions that are not covered, references by name; over suppliers."""
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"))
    old = s.where("k % 4 <> 0").select(F.concat(F.lit("f"), F.col("k").cast("string"), F.lit("_v1")).alias("name"))
    new = s.where("k % 3 <> 0").select(F.concat(F.lit("f"), F.col("k").cast("string"), F.when(F.col("k") % 5 == 0, "_v1").otherwise("_v2")).alias("name"))
    normal = lambda c: F.regexp_replace(c, "_v[0-9]+$", "")
    left = s.select(F.when(F.col("k") % 7 > 0, F.concat(F.lit("m"), F.col("k").cast("string"))).alias("name"), (F.col("k") % 2).cast("string").alias("body"))
    right = s.where("k % 2 = 0").select(F.concat(F.lit("m"), F.col("k").cast("string")).alias("name"), (F.col("k") % 3).cast("string").alias("body"))
    functions = s.select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("function"))
    covered = s.where("k % 6 = 0").select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("function"))
    refs = s.select(F.col("k").alias("id"), F.concat(F.lit("r"), F.col("nation").cast("string")).alias("name"))
    there = _table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("name"), F.lit("Bla").alias("kind"), "n_name")
    found = [
        records.correspond(old, new, normal).select(F.lit("correspond").alias("join"), F.concat_ws(">", "old", "new").alias("value")),
        records.ambiguous(old.union(new), normal).select(F.lit("ambiguous"), "key"),
        records.unmatched(old, new, normal).select(F.lit("unmatched"), "name"),
        records.module_diff(left, right).select(F.lit("module"), F.concat_ws(":", "name", "difference")),
        records.not_covered(functions, covered).select(F.lit("not covered"), "function"),
        tools.by_name(refs, there, "Bla").select(F.lit("by name"), F.concat_ws("=", F.col("id").cast("string"), "n_name")),
        tools.exists_by_name(refs, there.where("n_name < 'F'"), "Bla").select(F.lit("exists"), F.concat_ws("=", F.col("id").cast("string"), F.col("found").cast("string"))),
    ]
    out = found[0]
    for rows in found[1:]:
        out = out.union(rows)
    return out


SYMBOL_JOINS = """
WITH s AS (SELECT s_suppkey AS k, s_nationkey AS nation FROM supplier),
o AS (SELECT k, 'f' || k || '_v1' AS name FROM s WHERE k % 4 <> 0),
n AS (SELECT k, 'f' || k || CASE WHEN k % 5 = 0 THEN '_v1' ELSE '_v2' END AS name FROM s WHERE k % 3 <> 0)
SELECT 'correspond' AS "join", o.name || '>' || n.name AS value FROM o JOIN n USING (k) WHERE o.name <> n.name UNION ALL
SELECT 'ambiguous', 'f' || k FROM o JOIN n USING (k) WHERE o.name <> n.name UNION ALL
SELECT 'unmatched', name FROM o WHERE k % 3 = 0 UNION ALL
SELECT 'module', 'm' || k || CASE WHEN k % 2 = 1 THEN ':only left' WHEN k % 7 = 0 THEN ':only right' ELSE ':differs' END FROM s
    WHERE (k % 2 = 1 AND k % 7 > 0) OR (k % 2 = 0 AND (k % 7 = 0 OR k % 2 <> k % 3)) UNION ALL
SELECT 'not covered', 'f' || k FROM s WHERE k % 6 <> 0 UNION ALL
SELECT 'by name', k || '=' || n_name FROM s JOIN nation ON n_nationkey = nation UNION ALL
SELECT 'exists', k || '=' || (n_name < 'F') FROM s JOIN nation ON n_nationkey = nation"""


def report_lines(spark, sf_dir):
    """Source lines with their numbers and the remarks placed on them, over the
    lines of all documents; one row for each."""
    d = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), F.col("text").alias("value"))
    lines = tools.number_lines(d)
    marks = lines.where("line % 3 = 0").select("file", "line", F.lit("vectorized").alias("name")).union(
        lines.where("line % 6 = 0").select("file", "line", F.lit("inlined"))
    )
    joined = tools.remarks_by_line(lines, marks)
    return joined.groupBy("file").agg(
        F.count("*").alias("n_lines"), F.max("line").alias("last"),
        F.sum(F.coalesce(F.size("remarks"), F.lit(0))).alias("n_remarks"), F.sum(F.length("text")).alias("n_chars"),
    )


REPORT_LINES = """
WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS t, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS i FROM documents)
SELECT 'd' || doc_id AS file, count(*) AS n_lines, CAST(max(i) AS INT) AS last,
    CAST(sum((i % 3 = 0)::INT + (i % 6 = 0)::INT) AS BIGINT) AS n_remarks, CAST(sum(length(t)) AS BIGINT) AS n_chars
FROM l GROUP BY doc_id""".replace("\\\\", "\\")


def orders_and_limits(spark, sf_dir):
    """Order of symbols, sections, includes, threads and dependencies, and bounds;
    each row with its place."""
    from pyspark.sql import Window

    s = _symbols(spark, sf_dir)
    place = lambda rows, *by: rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*by)))
    n = _table(spark, sf_dir, "nation")
    symbols = place(tools.sort_symbols(n.select(F.col("n_name").alias("name"))), "name").select(F.lit("symbols").alias("order"), F.col("name").alias("value"), F.col("place").cast("bigint").alias("place"))
    sections = tools.sort_sections(n.select(F.concat(F.lit(".ctors."), F.col("n_regionkey").cast("string"), F.lit(".x."), F.col("n_nationkey").cast("string")).alias("section")))
    text = n.select(
        F.lit("a.c").alias("file"), (F.col("n_nationkey") + 1).alias("line"),
        F.when(F.col("n_nationkey") % 6 == 0, F.lit("int x;")).otherwise(F.concat(F.lit("#include <"), "n_name", F.lit(">"))).alias("text"),
    )
    includes = tools.sort_includes(text)
    bounded = tools.bounded(s.select("name", "p_partkey"), 7, [F.desc("p_partkey")])
    nodes = n.select(F.col("n_nationkey").cast("bigint").alias("id"))
    edges = n.where("n_nationkey >= 4").select((F.col("n_nationkey") % 4).cast("bigint").alias("before"), F.col("n_nationkey").cast("bigint").alias("after"))
    levels = tools.topological_order(nodes, edges)
    trace = n.select(F.col("n_regionkey").alias("thread"), F.col("n_nationkey").alias("tsc"), F.lit("k").alias("kind"))
    threads = place(tools.sort_by_thread(trace), "thread", "tsc", "kind")
    return (
        symbols.union(sections.select(F.lit("sections"), "section", F.col("place").cast("bigint")))
        .union(includes.select(F.lit("includes"), "text", F.col("line").cast("bigint")))
        .union(bounded.select(F.lit("bounded"), "name", F.lit(0).cast("bigint")))
        .union(levels.select(F.lit("levels"), F.col("id").cast("string"), F.col("level").cast("bigint")))
        .union(threads.select(F.lit("threads"), F.col("tsc").cast("string"), F.col("place").cast("bigint")))
    )


ORDERS = f"""WITH {_SYMBOLS},
t AS (SELECT n_nationkey + 1 AS line, CASE WHEN n_nationkey % 6 = 0 THEN 'int x;' ELSE '#include <' || n_name || '>' END AS x, n_nationkey // 6 AS run, n_nationkey % 6 = 0 AS plain FROM nation)
SELECT 'symbols' AS "order", n_name AS value, row_number() OVER (ORDER BY n_name) AS place FROM nation UNION ALL
SELECT 'sections', '.ctors.' || n_regionkey || '.x.' || n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) FROM nation UNION ALL
SELECT 'includes', x, CASE WHEN plain THEN line ELSE min(line) OVER (PARTITION BY run, plain) + row_number() OVER (PARTITION BY run, plain ORDER BY x) - 1 END FROM t UNION ALL
SELECT 'bounded', name, 0 FROM (SELECT name FROM s ORDER BY p_partkey DESC LIMIT 7) UNION ALL
SELECT 'levels', CAST(n_nationkey AS VARCHAR), (n_nationkey >= 4)::INT FROM nation UNION ALL
SELECT 'threads', CAST(n_nationkey AS VARCHAR), row_number() OVER (ORDER BY n_regionkey, n_nationkey) FROM nation"""


def dependencies(spark, sf_dir):
    """One function with its callees as declarations; uses resolved to the nearest
    scope; an index of names across files; lookup of lines that are no addresses."""
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("k"), F.col("s_nationkey").cast("bigint").alias("nation"))
    functions = s.select(
        F.concat(F.lit("f"), F.col("k").cast("string")).alias("name"), F.lit("body").alias("body"),
        F.array(F.concat(F.lit("f"), (F.col("k") + 1).cast("string")), F.concat(F.lit("f"), (F.col("k") + 2).cast("string"))).alias("calls"),
    )
    one = tools.extract_function(functions, "f3").select(F.lit("extract").alias("kind"), F.concat_ws(":", "name", F.coalesce("body", F.lit("-"))).alias("value"))
    # a supplier's names are looked up in its nation, then in the region of the nation
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("nation"), (F.col("n_regionkey") + 100).cast("bigint").alias("region"))
    scopes = n.select(F.col("nation").alias("scope"), F.col("nation").alias("outer"), F.lit(0).alias("depth")).union(n.select("nation", "region", F.lit(1)))
    uses = s.select(F.col("k").alias("id"), F.concat(F.lit("x"), (F.col("k") % 3).cast("string")).alias("name"), F.col("nation").alias("scope"))
    definitions = n.where("nation % 2 = 0").select(F.col("nation").alias("id"), F.lit("x0").alias("name"), F.col("nation").alias("scope")).union(
        n.select("region").distinct().select((F.col("region") + 1000).alias("id"), F.explode(F.array(F.lit("x0"), F.lit("x1"))), "region")
    )
    resolved = tools.resolve_names(uses, definitions, scopes).select(F.lit("resolve"), F.concat_ws(">", F.col("id").cast("string"), F.coalesce(F.col("definition").cast("string"), F.lit("-"))))
    index = tools.name_index(s.select(F.concat(F.lit("n"), F.col("k").cast("string")).alias("name"), F.concat(F.lit("file"), F.col("nation").cast("string")).alias("file"), F.col("k").alias("line")))
    lines = s.select(F.when(F.col("k") % 3 == 0, F.concat(F.lit("at "), F.col("k").cast("string"))).otherwise(F.lower(F.hex(F.col("k") * 16 + 5))).alias("line"))
    ranges = s.select((F.col("k") * 16).alias("start_addr"), (F.col("k") * 16 + F.when(F.col("k") % 2 == 0, 16).otherwise(4)).alias("end_addr"), F.col("k").alias("cnt"))
    looked = records.lookup_lines(lines, ranges).select(F.lit("lookup"), F.concat_ws(">", "line", F.coalesce(F.col("cnt").cast("string"), F.lit("-"))))
    return one.union(resolved).union(index.select(F.lit("index"), F.concat_ws(":", "name", "file", F.col("line").cast("string")))).union(looked)


DEPENDENCIES = """
WITH s AS (SELECT s_suppkey AS k, s_nationkey AS nation, n_regionkey AS region FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT 'extract' AS kind, 'f' || k || CASE WHEN k = 3 THEN ':body' ELSE ':-' END AS value FROM s WHERE k BETWEEN 3 AND 5 UNION ALL
SELECT 'resolve', k || '>' || CASE WHEN k % 3 = 2 THEN '-' WHEN k % 3 = 0 AND nation % 2 = 0 THEN nation::VARCHAR ELSE (1100 + region)::VARCHAR END FROM s UNION ALL
SELECT 'index', 'n' || k || ':file' || nation || ':' || k FROM s UNION ALL
SELECT 'lookup', CASE WHEN k % 3 = 0 THEN 'at ' || k || '>-' ELSE lower(to_hex(k * 16 + 5)) || '>' || CASE WHEN k % 2 = 0 THEN k::VARCHAR ELSE '-' END END FROM s"""


def wide_ranges(spark, sf_dir):
    """Addresses in ranges of all widths, up to 2^40, that overlap."""
    o = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("k"))
    ranges = o.select((F.col("k") * 1000003).alias("start_addr"), (F.col("k") * 1000003 + F.expr("shiftleft(1L, cast(k % 41 as int))")).alias("end_addr"), F.col("k").alias("cnt"))
    asked = o.select((F.col("k") * 1000003 + 12345).alias("address"))
    found = records.lookup_addresses(asked, ranges)
    return found.groupBy("address").agg(F.count("cnt").alias("n"), F.sum("cnt").alias("total"))


WIDE_RANGES = """
WITH r AS (SELECT s_suppkey AS k, s_suppkey * 1000003::BIGINT AS lo, s_suppkey * 1000003::BIGINT + (1::BIGINT << (s_suppkey % 41)::INT) AS hi FROM supplier),
a AS (SELECT s_suppkey * 1000003::BIGINT + 12345 AS address FROM supplier)
SELECT address, count(k) AS n, CAST(sum(k) AS BIGINT) AS total FROM a LEFT JOIN r ON address >= lo AND address < hi GROUP BY 1"""


def nested_stacks(spark, sf_dir):
    """Distinct call stacks of nested calls: a thread for each order, a call for
    each line, each nested in the one before."""
    l = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("thread"), F.col("l_linenumber").cast("bigint").alias("d")).agg(
        F.min(F.ascii("l_returnflag") % 2).alias("flag")
    ).withColumn("func_id", F.col("d") * 10 + F.col("flag"))
    enter = l.select("thread", "func_id", F.lit("function-enter").alias("kind"), F.col("d").alias("tsc"))
    leave = l.select("thread", "func_id", F.lit("function-exit").alias("kind"), (F.lit(1000) - F.col("d")).alias("tsc"))
    trace = enter.union(leave)
    stacks = records.call_stacks(trace)
    return stacks.groupBy(F.array_join("stack", ",").alias("stack")).agg(F.count("*").alias("n"))


NESTED_STACKS = """
WITH l AS (SELECT l_orderkey AS t, l_linenumber AS d, l_linenumber * 10 + min(ascii(l_returnflag) % 2) AS f FROM lineitem GROUP BY 1, 2),
s AS (SELECT string_agg(f::VARCHAR, ',') OVER (PARTITION BY t ORDER BY d ROWS UNBOUNDED PRECEDING) AS stack FROM l)
SELECT stack, count(*) AS n FROM s GROUP BY 1"""


# aggregates


def tool_aggregates(spark, sf_dir):
    """Instruction counts, tallies, metrics, duplicates, cutoffs, coverage report
    with totals, counts of empty input, declared and checked reductions."""
    p = _table(spark, sf_dir, "part")
    remarks = p.select(
        F.when(F.col("p_size") % 2 == 0, "InstructionCount").otherwise("StackSize").alias("name"), F.col("p_type").alias("function"),
        F.create_map(F.when(F.col("p_size") % 2 == 0, "NumInstructions").otherwise("NumStackBytes"), F.col("p_size").cast("string")).alias("args"),
    )
    counts = records.instruction_counts(remarks).select(F.lit("instructions").alias("kind"), F.col("function").alias("key"), F.concat_ws("/", F.col("instructions").cast("string"), F.col("stack_bytes").cast("string")).alias("value"))
    o = _table(spark, sf_dir, "orders")
    tests = o.select(F.col("o_orderstatus").alias("status"), F.create_map(F.lit("price"), F.floor("o_totalprice").cast("bigint")).alias("data"))
    tally = tools.tally(tests).select(F.lit("tally"), "status", F.concat_ws("/", F.col("n").cast("string"), F.format_number("percent", 2)))
    metrics = tools.metrics(tests).select(F.lit("metric"), F.concat_ws(":", "status", "metric"), F.col("total").cast("string"))
    rows = p.select(F.col("p_partkey").alias("id"), "p_brand", "p_type")
    same = tools.structural_duplicates(rows, ["p_brand", "p_type"]).select(F.lit("distinct"), F.concat_ws("|", "p_brand", "p_type"), F.col("id").cast("string"))
    profiles = p.select(F.col("p_name").alias("name"), F.array(F.col("p_size"), F.lit(3)).cast("array<decimal(20,0)>").alias("counters"))
    cut = records.show_profile(profiles, 30).select(F.lit("cutoff"), F.lit(""), F.concat_ws("/", F.col("total_functions").cast("string"), F.col("maximum_function_count").cast("string")))
    cover = records.coverage_report(p.select(F.col("p_type").alias("file"), (F.col("p_size") % 4).alias("count"))).select(
        F.lit("coverage"), F.coalesce("file", F.lit("TOTALS")), F.concat_ws("/", F.col("functions").cast("string"), F.col("missed").cast("string"), F.format_number("percent", 2)))
    empty = records.count_remarks(remarks.withColumn("file", F.lit("x")).where("name = 'none'")).agg(F.count("*").alias("n")).select(F.lit("empty"), F.lit(""), F.col("n").cast("string"))
    spread = tools.declared_reduction(lambda v: float(v.max() - v.min()))
    own = p.groupBy("p_type").agg(spread(F.col("p_size").cast("double")).alias("v")).select(F.lit("declared"), "p_type", F.col("v").cast("bigint").cast("string"))
    checked = p.agg(*(tools.reduction(op, F.col("p_size").cast("bigint")).cast("bigint").alias(name) for name, op in (("a", "+"), ("b", "max"), ("c", "min"), ("d", "ior"), ("e", "ieor"), ("f", "iand"))))
    checked = checked.select(F.lit("reductions"), F.lit(""), F.concat_ws("/", *(F.col(c).cast("string") for c in "abcdef")))
    out = counts
    for rows in (tally, metrics, same, cut, cover, empty, own, checked):
        out = out.union(rows)
    return out


TOOL_AGGREGATES = """
SELECT 'instructions' AS kind, p_type AS key, (sum(p_size) FILTER (p_size % 2 = 0))::VARCHAR || '/' || (sum(p_size) FILTER (p_size % 2 = 1))::VARCHAR AS value FROM part GROUP BY p_type UNION ALL
SELECT 'tally', o_orderstatus, count(*) || '/' || printf('%.2f', round(100.0 * count(*) / (SELECT count(*) FROM orders), 2)) FROM orders GROUP BY o_orderstatus UNION ALL
SELECT 'metric', o_orderstatus || ':price', CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS VARCHAR) FROM orders GROUP BY o_orderstatus UNION ALL
SELECT 'distinct', p_brand || '|' || p_type, min(p_partkey)::VARCHAR FROM part GROUP BY p_brand, p_type UNION ALL
SELECT 'cutoff', '', count(*) || '/' || max(p_size) FROM part WHERE greatest(p_size, 3) >= 30 UNION ALL
SELECT 'coverage', coalesce(p_type, 'TOTALS'), count(*) || '/' || count(*) FILTER (p_size % 4 = 0) || '/' || printf('%.2f', round(100.0 * count(*) FILTER (p_size % 4 > 0) / count(*), 2)) FROM part GROUP BY ROLLUP (p_type) UNION ALL
SELECT 'empty', '', '0' UNION ALL
SELECT 'declared', p_type, (max(p_size) - min(p_size))::VARCHAR FROM part GROUP BY p_type UNION ALL
SELECT 'reductions', '', sum(p_size) || '/' || max(p_size) || '/' || min(p_size) || '/' || bit_or(p_size) || '/' || bit_xor(p_size) || '/' || bit_and(p_size) FROM part"""


# trees, records, callbacks


def query_shell(spark, sf_dir):
    """Named matchers, nested predicates and options of a query session."""
    n = _table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"), (F.col("n_regionkey") + 1000).cast("bigint").alias("parent"),
        F.lit("function").alias("kind"), F.col("n_name").alias("name"),
    )
    r = _table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).cast("bigint"), F.lit(None).cast("bigint"), F.lit("unit"), F.col("r_name"))
    shell = tree.QueryShell(n.union(r))
    shell.let("asian", tree.Matcher("function", inside=tree.Matcher("unit", name="ASIA")))
    named = shell.match("asian", "v").select(F.lit("named").alias("query"), "name", "binding")
    shell.set("bind-root", "false")
    bound = shell.match(tree.Matcher("unit", has=tree.Matcher("function", name="NATION_2")), "u").select(F.lit("option"), "name", "binding")
    return named.union(bound)


QUERY_SHELL = """
SELECT 'named' AS query, n_name AS name, b AS binding FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES ('v'), ('root')) t(b) WHERE r_name = 'ASIA'
UNION ALL SELECT 'option', r_name, 'u' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name = 'NATION_2'"""


def record_language(spark, sf_dir):
    """Records with templates, late-bound overrides, casts, typed sets, conditions
    and included sources; over parts."""
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", F.struct(F.col("p_size").alias("bla"), F.struct(F.col("p_brand").alias("blu")).alias("sub")).alias("a"))
    late = tools.override(p, {"p_size": F.col("p_size") + 100}, {"twice": lambda: F.col("p_size") * 2})
    made = tools.expand_templates(
        p.where("p_size <= 5").select(F.col("p_partkey").cast("string").alias("name")), _rows(spark, "template string, value int", [("_lo", 1), ("_hi", 2)])
    )
    wanted = tools.requirement("big && (!old || fast)", {"big", "fast"})
    included = p.where("p_partkey % 2 = 0").select("p_partkey").union(p.where("p_partkey % 2 = 1").select("p_partkey"))
    typed = tools.must_have(p.where("p_size > 45").select("p_partkey", F.lit("B").alias("kind")), "B")
    bits = p.select("p_partkey", (F.col("p_size") > 25).cast("int").alias("bit"), F.transform(F.array("p_size"), lambda x: x.cast("bigint")).alias("up"), F.shiftright(F.col("p_size").bitwiseAND(F.lit(6)), 1).alias("slice"))
    rows = [
        late.select(F.lit("override").alias("kind"), F.col("p_partkey").cast("string").alias("key"), (F.col("p_size") * 1000 + F.col("twice")).cast("bigint").alias("value")),
        made.select(F.lit("template"), "name", F.col("value").cast("bigint")),
        p.where(F.lit(wanted) & F.col("a.sub.blu").isNotNull()).select(F.lit("field"), F.col("a.sub.blu"), F.col("a.bla").cast("bigint")),
        included.select(F.lit("include"), F.col("p_partkey").cast("string"), F.lit(0).cast("bigint")),
        typed.select(F.lit("typed set"), "kind", F.col("p_partkey").cast("bigint")),
        bits.select(F.lit("bits"), F.col("p_partkey").cast("string"), F.col("bit") * 1000 + F.col("slice") * 100 + F.col("up")[0]),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


RECORD_LANGUAGE = """
SELECT 'override' AS kind, p_partkey::VARCHAR AS key, CAST((p_size + 100) * 1000 + (p_size + 100) * 2 AS BIGINT) AS value FROM part UNION ALL
SELECT 'template', p_partkey || t, v FROM part, (VALUES ('_lo', 1), ('_hi', 2)) x(t, v) WHERE p_size <= 5 UNION ALL
SELECT 'field', p_brand, p_size FROM part UNION ALL
SELECT 'include', p_partkey::VARCHAR, 0 FROM part UNION ALL
SELECT 'typed set', 'B', p_partkey FROM part WHERE p_size > 45 UNION ALL
SELECT 'bits', p_partkey::VARCHAR, (p_size > 25)::INT * 1000 + ((p_size & 6) >> 1) * 100 + p_size FROM part"""


def callbacks(spark, sf_dir):
    """Functions that users register: summaries by name, pattern and predicate,
    templates, children, resolvers, advisors, categories, rewrites, programs and
    mutators; over parts and orders."""
    p = _table(spark, sf_dir, "part")
    f = tools.Formatters(spark)
    f.register("Brand#11", lambda c: F.concat(F.lit("box "), c))
    f.register_pattern("Brand#2[0-9]", lambda c: F.concat(c, F.lit(" items")))
    f.register_when(lambda c: c.endswith("9"), lambda c: F.concat(F.lit("nine "), c))
    shown = f.summaries(p.select("p_brand", F.col("p_partkey").cast("string").alias("v")), "p_brand", "v")
    rows = [shown.select(F.lit("summary").alias("kind"), F.col("v").alias("key"), F.col("summary").alias("value"))]
    f.register_python("quillon_box", lambda x: f"<{x}>")
    rows.append(p.select(F.lit("python"), F.col("p_partkey").cast("string"), F.call_function("quillon_box", F.col("p_brand"))))
    template = tools.summary_template("${name} has ${#parts} parts")
    rows.append(p.select(F.col("p_brand").alias("name"), F.split("p_name", " ").alias("parts"), "p_partkey").select(F.lit("template"), F.col("p_partkey").cast("string"), template))
    kids = tools.children_provider(
        p.where("p_size <= 3").select("p_partkey", "p_size"), lambda r: r["p_size"], lambda r, i: (r["p_partkey"], i), "k long, i long"
    )
    rows.append(kids.select(F.lit("children"), F.col("k").cast("string"), F.col("i").cast("string")))

    class Places:
        """Lines of a name: every ``step``-th from ``step`` up to ``last``."""

        def eval(self, step: int, last: int):
            for line in range(step, last + 1, step):
                yield (line,)

    tools.resolver(spark, "quillon_places", Places, "line int")
    p.where("p_size between 1 and 4").select("p_partkey", "p_size").createOrReplaceTempView("quillon_asked")
    found = spark.sql("SELECT p_partkey, line FROM quillon_asked, LATERAL quillon_places(p_size, 9)")
    rows.append(found.select(F.lit("resolver"), F.col("p_partkey").cast("string"), F.col("line").cast("string")))

    def advisor():
        spent = 0

        def decide(row):
            nonlocal spent
            take = spent + row["price"] <= 500_000
            spent += row["price"] if take else 0
            return row["o_custkey"], row["o_orderkey"], bool(take)

        return decide

    o = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").cast("bigint").alias("price"))
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"), F.max("price").alias("price"))
    advice = tools.advise(first, "o_custkey", "o_orderkey", advisor, "o_custkey long, o_orderkey long, take boolean")
    rows.append(advice.select(F.lit("advisor"), F.col("o_orderkey").cast("string"), F.col("take").cast("string")))
    statuses = _table(spark, sf_dir, "orders").select("o_orderkey", tools.categories(F.col("o_orderstatus"), ["F", "O", "P"]).alias("c"))
    rows.append(statuses.select(F.lit("category"), F.col("o_orderkey").cast("string"), F.col("c").cast("string")))
    nodes = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("op"), F.lit(2).alias("n_args"))
    rules = _rows(spark, "op string, n_args int, new_op string", [("ECONOMY", 2, "SMALL"), ("SMALL", 2, "MEDIUM"), ("PROMO", 1, "x")])
    rows.append(tools.rewrite(nodes, rules).select(F.lit("rewrite"), F.col("id").cast("string"), "op"))
    judged = tools.by_program(p.select("p_partkey", "p_brand"), "p_brand", ["sed", "s/Brand#//"])
    rows.append(judged.select(F.lit("program"), F.col("p_partkey").cast("string"), "verdict"))
    rows.append(tools.mutate(p.select(F.col("p_partkey").cast("string").alias("k"), "p_brand"), "p_brand", F.reverse).select(F.lit("mutator"), "k", "p_brand"))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


CALLBACKS = """
SELECT 'summary' AS kind, p_partkey::VARCHAR AS key, CASE WHEN p_brand = 'Brand#11' THEN 'box ' || p_partkey WHEN p_brand LIKE 'Brand#2_' THEN p_partkey || ' items'
    WHEN p_partkey % 10 = 9 THEN 'nine ' || p_partkey END AS value FROM part UNION ALL
SELECT 'python', p_partkey::VARCHAR, '<' || p_brand || '>' FROM part UNION ALL
SELECT 'template', p_partkey::VARCHAR, p_brand || ' has ' || len(string_split(p_name, ' ')) || ' parts' FROM part UNION ALL
SELECT 'children', p_partkey::VARCHAR, i::VARCHAR FROM (SELECT p_partkey, unnest(range(0, p_size)) AS i FROM part WHERE p_size <= 3) UNION ALL
SELECT 'resolver', p_partkey::VARCHAR, i::VARCHAR FROM (SELECT p_partkey, unnest(range(p_size, 10, p_size)) AS i FROM part WHERE p_size BETWEEN 1 AND 4) UNION ALL
SELECT 'advisor', min(o_orderkey)::VARCHAR, (max(CAST(floor(o_totalprice) AS BIGINT)) <= 500000)::VARCHAR FROM orders GROUP BY o_custkey UNION ALL
SELECT 'category', o_orderkey::VARCHAR, CASE o_orderstatus WHEN 'F' THEN '0' WHEN 'O' THEN '1' ELSE '2' END FROM orders UNION ALL
SELECT 'rewrite', p_partkey::VARCHAR, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'MEDIUM' ELSE p_type END FROM part UNION ALL
SELECT 'program', p_partkey::VARCHAR, replace(p_brand, 'Brand#', '') FROM part UNION ALL
SELECT 'mutator', p_partkey::VARCHAR, reverse(p_brand) FROM part"""


# strings


def fn_string(spark, sf_dir):
    """Classes of characters, comparison of bytes, JSON equality, type names,
    markup, demangling, epoch texts; over parts."""
    p = _table(spark, sf_dir, "part")
    one = F.substring("p_name", 1, 1)
    size = F.col("p_size").cast("string")
    mangled = F.concat(F.lit("_ZN4part"), F.length("p_brand").cast("string"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("EiPKcRd"))
    a = F.concat(F.lit('{"a": '), size, F.lit(', "b": [1, 2]}'))
    b = F.concat(F.lit('{"b":[1,2],"a":'), F.when(F.col("p_size") % 2 == 0, size).otherwise("0"), F.lit("}"))
    return p.select(
        "p_partkey",
        *(tools.char_class(one, k).alias(f"is_{k}") for k in ("alpha", "digit", "alnum", "upper", "lower", "xdigit", "space", "punct", "print", "cntrl", "graph", "blank")),
        tools.memory_compare(F.col("p_name"), F.col("p_type")).alias("memcmp_"),
        tools.json_equal(a, b).alias("json_equal_"),
        tools.render_names(F.substring("p_type", 1, 1), {"S": "short", "M": "medium"}).alias("type_name_"),
        tools.render_markup(F.concat(F.lit("at {{{symbol:"), "p_brand", F.lit("}}}")), {"Brand#11": "first"}).alias("markup_"),
        tools.demangle(mangled).alias("demangle_"),
        tools.epoch_text(F.col("p_partkey") * 86400, 63).alias("epoch_"),
        F.instr("p_name", "a").alias("search_"),
        F.conv(F.hex(F.col("p_partkey")), 16, 10).cast("bigint").alias("hex_"),
        F.octet_length("p_name").alias("length_"),
    )


FN_STRING = """SELECT p_partkey, regexp_matches(p_name, '^[A-Za-z]') AS is_alpha, regexp_matches(p_name, '^[0-9]') AS is_digit,
    regexp_matches(p_name, '^[A-Za-z0-9]') AS is_alnum, regexp_matches(p_name, '^[A-Z]') AS is_upper, regexp_matches(p_name, '^[a-z]') AS is_lower,
    regexp_matches(p_name, '^[0-9A-Fa-f]') AS is_xdigit, regexp_matches(p_name, '^ ') AS is_space, false AS is_punct, true AS is_print,
    false AS is_cntrl, true AS is_graph, false AS is_blank,
    CASE WHEN p_name < p_type THEN -1 WHEN p_name > p_type THEN 1 ELSE 0 END AS memcmp_, p_size % 2 = 0 AS json_equal_,
    CASE substr(p_type, 1, 1) WHEN 'S' THEN 'short' WHEN 'M' THEN 'medium' ELSE substr(p_type, 1, 1) END AS type_name_,
    'at ' || CASE WHEN p_brand = 'Brand#11' THEN 'first' ELSE p_brand END AS markup_,
    'part::' || replace(p_brand, '#', '_') || '(int, char const*, double&)' AS demangle_,
    strftime(make_timestamp(CAST(p_partkey AS BIGINT) * 86400000000), '%Y-%m-%d %H:%M:%S') AS epoch_,
    instr(p_name, 'a') AS search_, CAST(p_partkey AS BIGINT) AS hex_, strlen(p_name) AS length_ FROM part"""


# functions


def fn_special(spark, sf_dir):
    """Special functions over the discounts and quantities of all line items."""
    l = _table(spark, sf_dir, "lineitem")
    x = F.col("l_discount") * 10 + 0.25
    z = F.struct((F.col("l_discount") + 1).alias("re"), (F.col("l_tax") - 0.5).alias("im"))
    q = S.remquo(F.col("l_extendedprice"), F.lit(7.0))
    found = {
        "erf_": S.erf(x), "erfc_": S.erfc(x), "erf_neg_": S.erf(-x), "lgamma_": S.lgamma(x - 2), "tgamma_": S.tgamma(x - 2),
        "lgamma_r_": S.lgamma_r(x - 2)["sign"].cast("double"), "nextafter_": (S.nextafter(x, F.lit(9.0)) - x) * float(1 << 50),
        "remquo_rem_": q["rem"], "remquo_quo_": q["quo"], "sincos_": S.sincos(x)["sin"] + S.sincos(x)["cos"] * 2,
        "j0_": S.bessel_j(0, x), "j1_": S.bessel_j(1, x), "jn_": S.bessel_j(3, x), "y0_": S.bessel_y(0, x), "y1_": S.bessel_y(1, x), "yn_": S.bessel_y(2, x),
        "cabs_": A.complex_abs(z), "conjg_": A.conjugate(z)["im"], "cmul_": A.complex_multiply(z, z)["re"], "cexp_": A.complex_exp(z)["im"],
        "clog_": A.complex_log(z)["im"], "csqrt_": A.complex_sqrt(z)["re"], "csin_": A.complex_sin(z)["re"], "ccos_": A.complex_cos(z)["im"],
        "rrspacing_": S.rrspacing(x) / float(1 << 53), "frexp_exponent_": S.frexp(F.col("l_extendedprice"))["exponent"].cast("double"),
        "cutoff_nan_": S.fdim(F.lit(S.NAN), x),
    }
    for name in ("cos", "sin", "tan", "exp", "exp2", "exp10", "log", "log2", "log10", "recip", "rsqrt", "sqrt"):
        for kind in ("half", "native"):
            found[f"{kind}_{name}_"] = S.ALIASES[f"{kind}_{name}"](x)
    for kind in ("half", "native"):
        found[f"{kind}_powr_"] = S.ALIASES[f"{kind}_powr"](x, F.lit(1.5))
        found[f"{kind}_divide_"] = S.ALIASES[f"{kind}_divide"](x, F.lit(3.0))
    return l.select("l_orderkey", "l_linenumber", *(F.round(c + 0.0, 6).alias(n) for n, c in found.items()))


def _fn_special_sql() -> str:
    """Power series and reflection formulas, independent of the functions' own."""
    x = "(l_discount * 10 + 0.25)"
    series = f"(2 / sqrt(pi()) * list_sum([pow(-1, n) * pow({x}, 2 * n + 1) / (gamma(n + 1.0) * (2 * n + 1)) for n in range(0, 60)]))"

    def j(k):
        return f"list_sum([pow(-1, m) / (gamma(m + 1.0) * gamma(m + {k} + 1.0)) * pow({x} / 2, 2 * m + {k}) for m in range(0, 40)])"

    euler = "0.5772156649015329"
    harmonic = "list_sum([1.0 / i for i in range(1, {0} + 1)])"
    y0 = f"(2 / pi() * ((ln({x} / 2) + {euler}) * {j(0)} - list_sum([pow(-1, k) * {harmonic.format('k')} * pow({x} / 2, 2 * k) / pow(gamma(k + 1.0), 2) for k in range(1, 40)])))"
    y1 = f"(2 / pi() * (ln({x} / 2) + {euler}) * {j(1)} - 2 / (pi() * {x}) - 1 / pi() * list_sum([pow(-1, k) * (coalesce({harmonic.format('k')}, 0) + {harmonic.format('(k + 1)')}) / (gamma(k + 1.0) * gamma(k + 2.0)) * pow({x} / 2, 2 * k + 1) for k in range(0, 40)]))"
    g = f"({x} - 2)"
    gamma = f"(CASE WHEN {g} > 0 THEN gamma({g}) WHEN {g} > -1 THEN gamma({g} + 1) / {g} ELSE gamma({g} + 2) / ({g} * ({g} + 1)) END)"
    re, im = "(l_discount + 1)", "(l_tax - 0.5)"
    quo = "round_even(l_extendedprice / 7, 0)"
    found = {
        "erf_": series, "erfc_": f"1 - {series}", "erf_neg_": f"-{series}", "lgamma_": f"ln(abs({gamma}))", "tgamma_": gamma,
        "lgamma_r_": f"sign({gamma})", "nextafter_": f"(nextafter(CAST({x} AS DOUBLE), CAST(9 AS DOUBLE)) - {x}) * 1125899906842624.0",
        "remquo_rem_": f"l_extendedprice - 7 * {quo}", "remquo_quo_": quo, "sincos_": f"sin({x}) + 2 * cos({x})",
        "j0_": j(0), "j1_": j(1), "jn_": j(3), "y0_": y0, "y1_": y1, "yn_": f"(2 / {x} * {y1} - {y0})",
        "cabs_": f"sqrt({re} * {re} + {im} * {im})", "conjg_": f"-{im}", "cmul_": f"{re} * {re} - {im} * {im}",
        "cexp_": f"exp({re}) * sin({im})", "clog_": f"atan2({im}, {re})",
        "csqrt_": f"sqrt((sqrt({re} * {re} + {im} * {im}) + {re}) / 2)",
        "csin_": f"sin({re}) * (exp({im}) + exp(-{im})) / 2", "ccos_": f"-sin({re}) * (exp({im}) - exp(-{im})) / 2",
        "rrspacing_": f"{x} / pow(2, floor(log2({x})) + 1)", "frexp_exponent_": "floor(log2(l_extendedprice)) + 1",
        "cutoff_nan_": "CAST('nan' AS DOUBLE)",
    }
    plain = {
        "cos": f"cos({x})", "sin": f"sin({x})", "tan": f"tan({x})", "exp": f"exp({x})", "exp2": f"pow(2, {x})", "exp10": f"pow(10, {x})",
        "log": f"ln({x})", "log2": f"log2({x})", "log10": f"log10({x})", "recip": f"1 / {x}", "rsqrt": f"1 / sqrt({x})",
        "sqrt": f"sqrt({x})", "powr": f"pow({x}, 1.5)", "divide": f"{x} / 3",
    }
    found |= {f"{kind}_{n}_": e for n, e in plain.items() for kind in ("half", "native")}
    columns = ", ".join(f"round(({e}) + 0.0, 6) AS {n}" for n, e in found.items())
    return f"SELECT l_orderkey, l_linenumber, {columns} FROM lineitem"


def fn_cast(spark, sf_dir):
    """Casts, arithmetic and aggregate access of the low-level language, over all
    line items."""
    l = _table(spark, sf_dir, "lineitem")
    k, p, n, x = F.col("l_orderkey").cast("bigint"), F.col("l_partkey").cast("bigint"), F.col("l_linenumber").cast("bigint"), F.col("l_extendedprice").cast("double")
    pair = F.struct(k.alias("a"), p.alias("b"))
    mask, new, old = F.array(n > 2, n > 4), F.array(k, k), F.array(p, p)
    vec = F.array(n.cast("double"), F.lit(2.0), F.lit(3.0), F.lit(4.0))
    special = F.when(n == 1, S.NAN).when(n == 2, S.INF).when(n == 3, -S.INF).when(n == 4, F.lit("-0.0").cast("double")).when(n == 5, 5e-324).otherwise(-x)
    return l.select(
        "l_orderkey", "l_linenumber",
        S.wrap(k * 1000003 + 2**40, 32).alias("add_"), S.wrap(p - k * 1000003, 32).alias("sub_"), S.wrap(k * p * 65537, 32).alias("mul_"),
        (-k - (-k) % 7).alias("sdiv_parts_"), S.urem(-k, n + 1).alias("urem_"), S.lshr(-k, 3).alias("lshr_"),
        F.round(x + 0.5, 4).alias("fadd_"), F.round(x - 0.5, 4).alias("fsub_"), F.round(x * 1.5, 4).alias("fmul_"), F.round(S.divide(x, n), 6).alias("fdiv_"), (-x).alias("fneg_"),
        S.trunc_bool(k).alias("trunc_bool_"), (k % 2 == 1).cast("int").alias("zext_bool_"), S.sign_extend_bool(k % 2 == 1).alias("sext_bool_"),
        F.round(S.fptrunc(x / 3).cast("double"), 3).alias("fptrunc_"), F.round(S.fptrunc(x).cast("double") * 2, 1).alias("fpext_"),
        S.fptosi(-x).alias("fptosi_"), S.fptosi(x, 8).alias("fptosi8_"), (-k).cast("double").alias("sitofp_"), S.uitofp(-k).alias("uitofp_"),
        pair["b"].alias("extractvalue_"), pair.withField("a", n)["a"].alias("insertvalue_"),
        F.when(n > 3, k).when(n > 1, p).otherwise(F.lit(0).cast("bigint")).alias("phi_"),
        A.masked(mask, new, old)[1].alias("masked_store_"), S.saturate(k * 3, 8).alias("ssat_"), S.saturate_unsigned(k - 100, 8).cast("bigint").alias("usat_"),
        S.clamp(x / 50000 - 0.5, 0.0, 1.0).alias("sat01_"), A.dot(vec, vec).alias("dot4_"), F.rint(x).cast("bigint").alias("lrint_"),
        S.fpclass(special).alias("fpclass_"), S.signbit(special).alias("signbit_"), S.isfinite(special).alias("isfinite_"), S.isnormal(special).alias("isnormal_"),
        F.typeof(x).alias("kind_"), F.typeof(F.array(F.array(x))).alias("rank_"), F.col("l_shipdate").isNotNull().alias("present_"),
        F.col("l_quantity").cast("double").alias("dble_"), A.component(F.array(pair), "b")[0].alias("component_"),
        S.bswap(k).alias("bswap_"), S.bitreverse(k).alias("bitreverse_"), S.popcount(-k).alias("popcount_neg_"), S.fma(x, n, 1.0).alias("mad_"),
        S.copysign(n.cast("double"), special).alias("copysign_"),
    )


FN_CAST = """
WITH l AS (SELECT *, CAST(l_orderkey AS BIGINT) AS k, CAST(l_partkey AS BIGINT) AS p, CAST(l_linenumber AS BIGINT) AS n, CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem),
u AS (SELECT *, ((k & 255) << 24) + (((k >> 8) & 255) << 16) + (((k >> 16) & 255) << 8) + ((k >> 24) & 255) AS sw,
      list_sum([CASE WHEN (k >> i) & 1 = 1 THEN 1::BIGINT << (31 - i) ELSE 0 END for i in range(0, 32)])::BIGINT AS br FROM l)
SELECT l_orderkey, l_linenumber,
  CAST((((k * 1000003 + 1099511627776 + 2147483648) % 4294967296 + 4294967296) % 4294967296) - 2147483648 AS BIGINT) AS add_,
  CAST((((p - k * 1000003 + 2147483648) % 4294967296 + 4294967296) % 4294967296) - 2147483648 AS BIGINT) AS sub_,
  CAST((((k * p * 65537 + 2147483648) % 4294967296 + 4294967296) % 4294967296) - 2147483648 AS BIGINT) AS mul_,
  -(k // 7) * 7 AS sdiv_parts_, (4294967296 - k) % 4294967296 % (n + 1) AS urem_, ((4294967296 - k) % 4294967296) >> 3 AS lshr_,
  round(x + 0.5, 4) AS fadd_, round(x - 0.5, 4) AS fsub_, round(x * 1.5, 4) AS fmul_, round(x / n, 6) AS fdiv_, -x AS fneg_,
  k % 2 = 1 AS trunc_bool_, CAST(k % 2 AS INT) AS zext_bool_, CAST(-(k % 2) AS INT) AS sext_bool_,
  round(CAST(CAST(x / 3 AS FLOAT) AS DOUBLE), 3) AS fptrunc_, round(CAST(CAST(x AS FLOAT) AS DOUBLE) * 2, 1) AS fpext_,
  -CAST(floor(x) AS BIGINT) AS fptosi_, least(CAST(floor(x) AS BIGINT), 127) AS fptosi8_, CAST(-k AS DOUBLE) AS sitofp_, CAST((4294967296 - k) % 4294967296 AS DOUBLE) AS uitofp_,
  p AS extractvalue_, n AS insertvalue_, CASE WHEN n > 3 THEN k WHEN n > 1 THEN p ELSE 0 END AS phi_,
  CASE WHEN n > 4 THEN k ELSE p END AS masked_store_, least(k * 3, 127) AS ssat_, greatest(least(k - 100, 255), 0) AS usat_,
  least(greatest(x / 50000 - 0.5, 0), 1) AS sat01_, CAST(n * n + 29 AS DOUBLE) AS dot4_, CAST(round_even(x, 0) AS BIGINT) AS lrint_,
  CASE n WHEN 1 THEN 'nan' WHEN 2 THEN '+inf' WHEN 3 THEN '-inf' WHEN 4 THEN '-zero' WHEN 5 THEN '+subnormal' ELSE '-normal' END AS fpclass_,
  n NOT IN (1, 2, 5) AS signbit_, n > 3 AS isfinite_, n > 5 AS isnormal_,
  'double' AS kind_, 'array<array<double>>' AS rank_, l_shipdate IS NOT NULL AS present_, CAST(l_quantity AS DOUBLE) AS dble_, p AS component_,
  CASE WHEN sw >= 2147483648 THEN sw - 4294967296 ELSE sw END AS bswap_, CASE WHEN br >= 2147483648 THEN br - 4294967296 ELSE br END AS bitreverse_,
  CAST(bit_count((4294967296 - k) % 4294967296) AS INT) AS popcount_neg_, x * n + 1 AS mad_, CASE WHEN n IN (1, 2, 5) THEN n ELSE -n END::DOUBLE AS copysign_
FROM u"""


def fn_vector(spark, sf_dir):
    """Vector functions whose results differ from row to row, over all embeddings."""
    v = F.col("embedding")
    found = {
        "norm_": A.normalize(v)[1], "cross_": A.cross(v, F.reverse(v))[0], "splat_": F.element_at(A.broadcast_scalar(v[2].cast("double"), 3), 3),
        "implied_": F.aggregate(A.implied_do(F.lit(1), (F.col("vec_id") % 5 + 1).cast("int"), lambda i: i * i), F.lit(0), lambda s, x: s + x).cast("double"),
        "strided_": F.element_at(F.transform(A.strided(5, 1, -2), lambda i: F.element_at(v, i)), 2).cast("double"),
        "sqrt_vec_": F.transform(v, lambda x: F.sqrt(F.abs(x.cast("double"))))[3], "log_vec_": F.transform(v, lambda x: F.ln(F.abs(x.cast("double")) + 1))[4],
        "argmax_": A.argmax(v).cast("double"),
    }
    return _table(spark, sf_dir, "embeddings").select("vec_id", *(F.round(c + 0.0, 6).alias(n) for n, c in found.items()))


FN_VECTOR = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT vec_id, round(v[2] / sqrt(list_dot_product(v, v)), 6) AS norm_, round(v[2] * v[-3] - v[3] * v[-2], 6) AS cross_, round(v[3], 6) AS splat_,
    round(CAST(list_sum([i * i for i in range(1, vec_id % 5 + 2)]) AS DOUBLE), 6) AS implied_, round(v[3], 6) AS strided_,
    round(sqrt(abs(v[4])), 6) AS sqrt_vec_, round(ln(abs(v[5]) + 1), 6) AS log_vec_, round(CAST(list_position(v, list_max(v)) - 1 AS DOUBLE), 6) AS argmax_ FROM e"""


def exchanges(spark, sf_dir):
    """Exchange and compare-and-exchange in an order: the last value, and the value
    after every cell of a line's number has been swapped in where it was expected."""
    l = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("bigint").alias("n")).agg(F.max("l_quantity").cast("bigint").alias("q"))
    swap = F.aggregate(
        F.array_sort(F.collect_list(F.struct("n", "q"))), F.lit(0).cast("bigint"),
        lambda held, x: F.when(held == x["n"] - 1, x["n"]).otherwise(held),
    )
    return l.groupBy("l_orderkey").agg(F.max_by("q", "n").alias("xchg_"), swap.alias("cmpxchg_"))


EXCHANGES = """
WITH l AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS n, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, arg_max(q, n) AS xchg_,
    CAST(coalesce(list_max(list_filter(list_sort(list(n)), lambda x, i: x = i)), 0) AS BIGINT) AS cmpxchg_ FROM l GROUP BY l_orderkey"""


def integer_domains(spark, sf_dir):
    """Loop domains, sums over parametric domains, affine and convex hulls, hulls
    of the points of each nation's suppliers."""
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("n"))
    triangle = domains.scan_domain(n, [("i", "0", "n", 1), ("j", "i", "n", 2)], "(i + j) % 3 = 0")
    rows = [triangle.select(F.lit("scan").alias("kind"), "n", F.col("i").alias("x"), F.col("j").alias("y"))]
    total = domains.sum_over_range(F.col("n"), lambda i: F.col("n") + i * i)
    rows.append(n.select(F.lit("sum"), "n", total, F.lit(None).cast("bigint")))
    c = _table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("n"), (F.col("c_custkey") % 97).cast("bigint").alias("x"), (F.col("c_custkey") % 89).cast("bigint").alias("y")
    )
    rows.append(domains.affine_hull(c, "n").select(F.lit("dimension"), "n", F.col("dimension").cast("bigint"), F.lit(None).cast("bigint")))
    flat = c.select("n", "x", (F.col("x") * 3 + F.col("n")).alias("y"))
    rows.append(domains.affine_hull(flat, "n").select(F.lit("line"), "n", F.col("dimension").cast("bigint"), F.lit(None).cast("bigint")))
    rows.append(domains.convex_hull(c, "n").groupBy("n").agg(F.min(F.struct("x", "y")).alias("a"), F.max(F.struct("x", "y")).alias("b")).select(F.lit("hull"), "n", F.col("a.x") * 1000 + F.col("a.y"), F.col("b.x") * 1000 + F.col("b.y")))
    small = c.where("x < 12 and y < 12")
    rows.append(domains.convex_hull(small, "n").select(F.lit("vertex"), "n", "x", "y"))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


INTEGER_DOMAINS = """
WITH n AS (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation),
c AS (SELECT CAST(c_nationkey AS BIGINT) AS n, CAST(c_custkey % 97 AS BIGINT) AS x, CAST(c_custkey % 89 AS BIGINT) AS y FROM customer),
s AS (SELECT DISTINCT * FROM c WHERE x < 12 AND y < 12),
lines AS (SELECT a.n, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM s a JOIN s b ON a.n = b.n AND (a.x, a.y) <> (b.x, b.y)),
-- a point is a vertex when it is no point of a segment and of no triangle of the others
inner_ AS (SELECT DISTINCT p.n, p.x, p.y FROM s p JOIN lines l ON l.n = p.n
  AND (l.bx - l.ax) * (p.y - l.ay) = (l.by_ - l.ay) * (p.x - l.ax)
  AND ((p.x, p.y) > (l.ax, l.ay)) AND ((p.x, p.y) < (l.bx, l.by_))
  UNION
  SELECT DISTINCT p.n, p.x, p.y FROM s p JOIN lines l ON l.n = p.n AND (l.ax, l.ay) < (l.bx, l.by_) AND (l.ax, l.ay) <> (p.x, p.y) AND (l.bx, l.by_) <> (p.x, p.y)
  JOIN s q ON q.n = p.n AND (q.x, q.y) > (l.bx, l.by_) AND (q.x, q.y) <> (p.x, p.y)
  WHERE sign((l.bx - l.ax) * (p.y - l.ay) - (l.by_ - l.ay) * (p.x - l.ax)) = sign((q.x - l.bx) * (p.y - l.by_) - (q.y - l.by_) * (p.x - l.bx))
    AND sign((l.bx - l.ax) * (p.y - l.ay) - (l.by_ - l.ay) * (p.x - l.ax)) = sign((l.ax - q.x) * (p.y - q.y) - (l.ay - q.y) * (p.x - q.x))
    AND (l.bx - l.ax) * (p.y - l.ay) <> (l.by_ - l.ay) * (p.x - l.ax)),
scan AS (SELECT n, i, unnest(range(i, n + 1, 2)) AS j FROM (SELECT n, unnest(range(0, n + 1)) AS i FROM n))
SELECT 'scan' AS kind, n, i AS x, j AS y FROM scan WHERE (i + j) % 3 = 0 UNION ALL
SELECT 'sum', n, CAST(n * n + (n - 1) * n * (2 * n - 1) // 6 AS BIGINT), NULL FROM n UNION ALL
SELECT 'dimension', n, CASE WHEN count(DISTINCT (x, y)) = 1 THEN 0
    WHEN (count(*) * sum(x * x) - sum(x) * sum(x)) * (count(*) * sum(y * y) - sum(y) * sum(y)) = (count(*) * sum(x * y) - sum(x) * sum(y)) * (count(*) * sum(x * y) - sum(x) * sum(y)) THEN 1 ELSE 2 END, NULL FROM c GROUP BY n UNION ALL
SELECT 'line', n, CASE WHEN count(DISTINCT x) = 1 THEN 0 ELSE 1 END, NULL FROM c GROUP BY n UNION ALL
SELECT 'hull', n, min(x * 1000 + y), max(x * 1000 + y) FROM c GROUP BY n UNION ALL
SELECT 'vertex', n, x, y FROM (SELECT * FROM s EXCEPT SELECT * FROM inner_)"""


QUERIES = {
    "source_remarks": source_remarks, "source_instr_profile": source_instr_profile, "source_sample_profile": source_sample_profile,
    "source_names": source_names, "source_numbers": source_numbers, "source_binary": source_binary, "source_sinks": source_sinks,
    "source_errors": source_errors, "symbol_filters": symbol_filters, "symbol_joins": symbol_joins, "report_lines": report_lines,
    "orders_and_limits": orders_and_limits, "dependencies": dependencies, "wide_ranges": wide_ranges, "nested_stacks": nested_stacks,
    "tool_aggregates": tool_aggregates, "query_shell": query_shell, "record_language": record_language, "callbacks": callbacks,
    "fn_string": fn_string, "fn_special": fn_special, "fn_cast": fn_cast, "fn_vector": fn_vector, "exchanges": exchanges,
    "integer_domains": integer_domains,
}


def oracle() -> dict[str, str]:
    return {
        "source_remarks": SOURCE_REMARKS, "source_instr_profile": SOURCE_PROFILE, "source_sample_profile": SOURCE_SAMPLES,
        "source_names": SOURCE_NAMES, "source_numbers": SOURCE_NUMBERS, "source_binary": SOURCE_BINARY, "source_sinks": SOURCE_SINKS,
        "source_errors": SOURCE_ERRORS, "symbol_filters": SYMBOL_FILTERS, "symbol_joins": SYMBOL_JOINS, "report_lines": REPORT_LINES,
        "orders_and_limits": ORDERS, "dependencies": DEPENDENCIES, "wide_ranges": WIDE_RANGES, "nested_stacks": NESTED_STACKS,
        "tool_aggregates": TOOL_AGGREGATES, "query_shell": QUERY_SHELL, "record_language": RECORD_LANGUAGE, "callbacks": CALLBACKS,
        "fn_string": FN_STRING, "fn_special": _fn_special_sql(), "fn_cast": FN_CAST, "fn_vector": FN_VECTOR, "exchanges": EXCHANGES,
        "integer_domains": INTEGER_DOMAINS,
    }
