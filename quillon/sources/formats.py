"""Readers and writers of record formats.

Each file is one row of ``spark.read.text(..., wholetext=True)`` (or
``binaryFile``) and is parsed where it lies, by an Arrow batch function; a
directory of files is read in parallel.  Malformed input raises ParseError in
FAILFAST mode and gives a row with ``error`` set in PERMISSIVE mode.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ParseError(ValueError):
    """Input that a reader cannot take."""


MAX_COUNT = (1 << 64) - 1


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value")
    )


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    """Files without a byte, which Spark's own readers pass over."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x for x in system.globStatus(where) or []]
    listed = [f for x in found for f in (system.listStatus(x.getPath()) if x.isDirectory() else [x])]
    hidden = lambda name: name.startswith(("_", "."))
    return [
        f.getPath().toString() for f in listed
        if f.isFile() and not f.getLen() and not hidden(f.getPath().getName()) and "part-" not in f.getPath().getName()
    ]


def parse_each(
    files: DataFrame, parse: Callable[[str], list[tuple]], schema: str, mode: str = "FAILFAST"
) -> DataFrame:
    """Rows of ``parse`` for each (file, value), with the file and an error column."""
    names = T.StructType.fromDDL(schema).names

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, value in zip(batch["file"], batch["value"]):
                try:
                    out += [(file, None, *row) for row in parse(value)]
                except ParseError as e:
                    if mode == "FAILFAST":
                        raise ParseError(f"{file}: {e}") from e
                    out.append((file, str(e), *[None] * len(names)))
            yield pd.DataFrame(out, columns=["file", "error", *names])

    return files.mapInPandas(rows, f"file string, error string, {schema}")


# remarks: YAML documents with a tag, a few keys and a list of arguments

REMARKS = "remark_type string, pass string, name string, function string, args map<string,string>"


def _scalar(text: str) -> str:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        quote = text[0]
        return text[1:-1].replace("''", "'") if quote == "'" else text[1:-1]
    return text


def parse_remarks(text: str) -> list[tuple]:
    """Remark documents.  An empty text, and a document without Pass, Name or
    Function, are malformed."""
    if not text.strip():
        raise ParseError("document root is not of mapping type")
    out = []
    for document in re.split(r"^--- ", text, flags=re.M)[1:]:
        tag, *lines = document.splitlines()
        keys: dict[str, str] = {}
        args: dict[str, str] = {}
        in_args = False
        for line in lines:
            if line.startswith("..."):
                break
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            item = re.match(r"\s+-\s+([^:]+):(.*)", line)
            if item and in_args:
                args[item[1].strip()] = _scalar(item[2])
            elif pair := re.match(r"([^\s:][^:]*):(.*)", line):
                in_args = pair[1] == "Args"
                keys[pair[1]] = _scalar(pair[2])
        for key in ("Pass", "Name", "Function"):
            if key not in keys:
                raise ParseError(f"remark without {key}")
        out.append((tag.strip().lstrip("!"), keys["Pass"], keys["Name"], keys["Function"], args))
    return out


def _unquoted(c):
    c = F.trim(c)
    single = F.replace(F.regexp_extract(c, "^'(.*)'$", 1), F.lit("''"), F.lit("'"))
    return (
        F.when(c.rlike("^'.*'$") & (F.length(c) > 1), single)
        .when(c.rlike('^".*"$') & (F.length(c) > 1), F.regexp_extract(c, '^"(.*)"$', 1))
        .otherwise(c)
    )


def read_remarks(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """remark_type, pass, name, function, args of each remark of YAML files.

    Files are split at the line that begins a document, so a file of any size is
    read by many tasks; documents are taken apart by column expressions.  Of an
    argument that occurs twice the last counts.  A document without Pass, Name or
    Function, and an empty file, are malformed (an empty part of a written folder
    is not)."""
    documents = (
        spark.read.option("lineSep", "\n--- ").text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^--- ", "").alias("value"))
        .where(F.col("value").rlike(r"(?m)^\s*[^#\s]"))  # not blank lines and comments alone
    )
    body = F.regexp_replace("value", r"(?ms)^\.\.\.\s*$.*", "")

    def key(name):
        pattern = rf"(?m)^{name}:[ \t]*(.*?)[ \t\r]*$"
        return F.when(body.rlike(pattern), _unquoted(F.regexp_extract(body, pattern, 1)))

    # arguments stand behind the line "Args:", indented
    listed = F.regexp_extract(body, r"(?ms)^Args:[^\n]*\n(.*)", 1)
    item = F.lit(r"(?m)^[ \t]+-[ \t]+([^:\n]+):[ \t]*(.*?)[ \t\r]*$")
    names = F.transform(F.regexp_extract_all(listed, item, F.lit(1)), F.trim)
    entries = F.zip_with(
        names, F.transform(F.regexp_extract_all(listed, item, F.lit(2)), _unquoted), lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    )
    parts = documents.select(
        "file",
        F.regexp_extract("value", r"^!?(\S*)", 1).alias("remark_type"),
        key("Pass").alias("pass"), key("Name").alias("name"), key("Function").alias("function"),
        entries.alias("entries"),
    )
    last = F.filter(
        "entries",
        lambda e, i: ~F.exists(F.slice(F.col("entries"), i + 2, F.size("entries")), lambda o: o["k"] == e["k"]),
    )
    missing = F.coalesce(*(F.when(F.col(c).isNull(), f"remark without {c.title()}") for c in ("pass", "name", "function")))
    empty = spark.createDataFrame(
        [(file, "document root is not of mapping type") for file in _empty_files(spark, path)], "file string, error string"
    )
    found = parts.select(
        "file", missing.alias("error"), "remark_type", "pass", "name", "function", F.map_from_entries(last).alias("args")
    ).unionByName(empty, allowMissingColumns=True)
    if mode == "FAILFAST":
        # in a filter, which is evaluated whatever columns are asked for
        raised = F.raise_error(F.concat_ws(": ", "file", "error")).cast("boolean")
        return found.where(F.when(F.col("error").isNotNull(), raised).otherwise(F.lit(True)))
    return found.select(
        "file", "error",
        *(F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("remark_type", "pass", "name", "function", "args")),
    )


# instrumentation profiles: name, hash, counters, value sites, one number a line

INSTR_PROFILE = (
    "name string, hash decimal(20,0), counters array<decimal(20,0)>, level string,"
    " value_sites array<struct<kind:int,site:int,target:string,count:decimal(20,0)>>"
)


def _number(text: str) -> int:
    try:
        value = int(text, 0)
    except ValueError:
        raise ParseError(f"not a number: {text}") from None
    if not 0 <= value <= MAX_COUNT:
        raise ParseError(f"not an unsigned 64-bit number: {text}")
    return value


def parse_instr_profile(text: str) -> list[tuple]:
    """Function records.  ``:ir``, ``:fe``, ``:csir`` and like lines are
    directives; ``#`` lines are comments; blank lines end nothing."""
    lines = [x.strip() for x in text.splitlines()]
    directives = [x[1:].lower() for x in lines if x.startswith(":")]
    lines = [x for x in lines if x and x[0] not in "#:"]
    level = next((d for d in directives if d in ("ir", "fe", "csir")), "fe")
    out, at = [], 0

    def take() -> str:
        nonlocal at
        if at >= len(lines):
            raise ParseError("truncated profile")
        at += 1
        return lines[at - 1]

    while at < len(lines):
        name, key = take(), _number(take())
        counters = [_number(take()) for _ in range(_number(take()))]
        sites: list[dict] = []
        if at + 2 < len(lines) and lines[at].isdigit() and lines[at + 1].isdigit() and lines[at + 2].isdigit():
            for _ in range(_number(take())):
                kind = _number(take())
                for site in range(_number(take())):
                    for _ in range(_number(take())):
                        target, _, n = take().rpartition(":")
                        sites.append({"kind": kind, "site": site, "target": target, "count": _number(n)})
        out.append((name, _dec(key), [_dec(c) for c in counters], level,
                    [s | {"count": _dec(s["count"])} for s in sites]))
    return out


def _dec(x: int):
    from decimal import Decimal

    return Decimal(x)


def read_instr_profile(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    return parse_each(_files(spark, path), parse_instr_profile, INSTR_PROFILE, mode)


def format_instr_profile(rows) -> str:
    """The text form of merged records (name, hash, counters)."""
    parts = []
    for r in rows:
        counters = "\n".join(str(int(c)) for c in r["counters"])
        parts.append(f"{r['name']}\n# Func Hash:\n{int(r['hash'])}\n# Num Counters:\n"
                     f"{len(r['counters'])}\n# Counter Values:\n{counters}\n")
    return "\n".join(parts)


# sample profiles: a tree by indentation

SAMPLE_PROFILE = (
    "path array<string>, sites array<string>, line string, samples bigint, total bigint,"
    " head bigint, call_targets map<string,bigint>"
)


def parse_sample_profile(text: str) -> list[tuple]:
    """One row for each function or inlined callee (line null) and each body
    line.  ``path`` names the callees from the outermost function in; ``sites``
    the lines at which they were inlined.  Blank lines are skipped."""
    out: list[tuple] = []
    stack: list[tuple[int, str, str]] = []
    for raw in text.splitlines():
        if not raw.strip() or raw.lstrip().startswith(("#", "!")):
            continue
        depth = len(raw) - len(raw.lstrip(" "))
        body = raw.strip()
        if depth == 0:
            name, total, head = body.rsplit(":", 2)
            stack = [(0, name, "")]
            out.append(([name], [], None, None, int(total), int(head), {}))
            continue
        if not stack:
            raise ParseError("a body line before any function")
        while stack[-1][0] >= depth:
            stack.pop()
        line, _, rest = body.partition(":")
        rest = rest.strip()
        path, sites = [s[1] for s in stack], [s[2] for s in stack[1:]]
        if match := re.fullmatch(r"(\d+)((?:\s+\S+:\d+)*)", rest):
            targets = dict(t.rsplit(":", 1) for t in match[2].split())
            out.append((path, sites, line, int(match[1]), None, None, {k: int(v) for k, v in targets.items()}))
        elif match := re.fullmatch(r"(\S+):(\d+)", rest):
            stack.append((depth, match[1], line))
            out.append(([*path, match[1]], [*sites, line], None, None, int(match[2]), None, {}))
        else:
            raise ParseError(f"not a line of a sample profile: {body}")
    return out


def read_sample_profile(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    return parse_each(_files(spark, path), parse_sample_profile, SAMPLE_PROFILE, mode)


# call traces

TRACE = "type int, func_id int, cpu int, thread int, kind string, tsc bigint"


def parse_trace(text: str) -> list[tuple]:
    out = []
    for body in re.findall(r"-\s*\{([^}]*)\}", text):
        pairs = dict(x.split(":", 1) for x in body.split(","))
        pairs = {k.strip(): v.strip() for k, v in pairs.items()}
        try:
            out.append((int(pairs.get("type", 0)), int(pairs["func-id"]), int(pairs["cpu"]),
                        int(pairs["thread"]), pairs["kind"], int(pairs["tsc"])))
        except (KeyError, ValueError) as e:
            raise ParseError(f"not a trace record: {body}") from e
    return out


def read_trace(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    return parse_each(_files(spark, path), parse_trace, TRACE, mode)


# sparse matrices in coordinate form

MATRIX = "i bigint, j bigint, re double, im double, rows bigint, cols bigint, nnz bigint, field string, symmetry string"


def parse_matrix(text: str) -> list[tuple]:
    lines = text.splitlines()
    head = lines[0].lower().split() if lines else []
    if len(head) != 5 or head[:3] != ["%%matrixmarket", "matrix", "coordinate"]:
        raise ParseError("not a coordinate matrix")
    field, symmetry = head[3], head[4]
    body = [x.split() for x in lines[1:] if x.strip() and not x.startswith("%")]
    if not body:
        raise ParseError("matrix without a size line")
    rows, cols, nnz = map(int, body[0])
    if len(body) - 1 != nnz:
        raise ParseError(f"{nnz} entries announced, {len(body) - 1} found")
    out = []
    for entry in body[1:]:
        re_ = float(entry[2]) if len(entry) > 2 else 1.0
        im = float(entry[3]) if field == "complex" else None
        out.append((int(entry[0]), int(entry[1]), re_, im, rows, cols, nnz, field, symmetry))
    return out


def read_matrix(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    return parse_each(_files(spark, path), parse_matrix, MATRIX, mode)


# address ranges with counts: a first line with the number of ranges, then hex

RANGES = "start_addr bigint, end_addr bigint, cnt bigint"


def parse_ranges(text: str) -> list[tuple]:
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    out = []
    if not lines:
        return out
    n = int(lines[0])
    for line in lines[1 : n + 1]:
        match = re.fullmatch(r"([0-9a-f]+)-([0-9a-f]+):(\d+)", line)
        if not match:
            raise ParseError(f"not a range: {line}")
        out.append((int(match[1], 16), int(match[2], 16), int(match[3])))
    if len(out) != n:
        raise ParseError(f"{n} ranges announced, {len(out)} found")
    return out


def read_ranges(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    return parse_each(_files(spark, path), parse_ranges, RANGES, mode)


def lines_of(spark: SparkSession, path: str, n: int) -> DataFrame:
    """file and value of texts that are records of ``n`` lines each, a row for each
    record: the lines of a file are numbered in one task, and parsed in many."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
    )
    in_file = Window.partitionBy("file").orderBy("block", "at")
    record = F.floor((F.row_number().over(in_file) - 1) / n)
    return (
        lines.withColumn("record", record).groupBy("file", "record")
        .agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("l"))
        .select("file", F.array_join(F.transform("l", lambda x: x["value"]), "\n").alias("value"))
    )


def read_stacks(spark: SparkSession, path: str) -> DataFrame:
    """file, frames (array of text) and warning of sampled stacks: blocks of lines
    between blank lines.  A stack with a line [truncated] keeps its other frames
    and has a warning."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.filter(F.transform(F.split("value", "\n"), F.trim), lambda x: x != "").alias("lines"),
    )
    cut = F.array_contains("lines", "[truncated]")
    return blocks.where(F.size("lines") > 0).select(
        "file", F.array_remove("lines", "[truncated]").alias("frames"), F.when(cut, "truncated stack").alias("warning")
    )


def read_symbol_list(spark: SparkSession, path: str) -> DataFrame:
    """One name a line; blank lines and # comments are skipped."""
    names = spark.read.text(path).select(F.trim("value").alias("name"))
    return names.where((F.col("name") != "") & ~F.col("name").startswith("#"))


def read_strings(spark: SparkSession, path: str, least: int = 4) -> DataFrame:
    """Runs of at least ``least`` printable ASCII bytes of binary files, with
    their byte offsets."""
    schema = "file string, offset bigint, string string"
    run = re.compile(rb"[\x20-\x7e\t]{%d,}" % least)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (file, m.start(), m[0].decode())
                for file, content in zip(batch["path"], batch["content"])
                for m in run.finditer(content)
            ]
            yield pd.DataFrame(out, columns=["file", "offset", "string"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, schema)


def _binary(spark: SparkSession, path: str, parse: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    names = T.StructType.fromDDL(schema).names

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                try:
                    out = [(file, *r) for r in parse(content)]
                except (struct.error, IndexError) as e:
                    raise ParseError(f"{file}: {e}") from e
                yield pd.DataFrame(out, columns=["file", *names])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, f"file string, {schema}")


def parse_coverage(content: bytes) -> list[tuple]:
    """Addresses of a coverage file: a magic number that tells the width of a
    word, then words."""
    (magic,) = struct.unpack_from("<Q", content)
    # Magic numbers of files with 64-bit and 32-bit words.
    width = {0xC0BFFFFFFFFFFF64: 8, 0xC0BFFFFFFFFFFF32: 4}.get(magic)
    if width is None or (len(content) - 8) % width:
        raise ParseError("not a coverage file")
    words = struct.unpack_from(f"<{(len(content) - 8) // width}{'Q' if width == 8 else 'I'}", content, 8)
    return [(w,) for w in words]


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """file and address of each covered point."""
    return _binary(spark, path, parse_coverage, "address bigint")


SYMBOLS = "name string, value bigint, size bigint, type string, binding string, section int"


def parse_symbols(content: bytes) -> list[tuple]:
    """The symbol table of a 64-bit little-endian ELF file; an undefined symbol
    has no section."""
    if content[:6] != b"\x7fELF\x02\x01":
        raise ParseError("not a 64-bit little-endian ELF file")
    (table,) = struct.unpack_from("<Q", content, 40)
    size, count = struct.unpack_from("<HH", content, 58)
    sections = [struct.unpack_from("<IIQQQQIIQQ", content, table + k * size) for k in range(count)]
    kinds, bindings = ["notype", "object", "func", "section", "file"], ["local", "global", "weak"]
    out = []
    for section in sections:
        if section[1] != 2:  # a symbol table
            continue
        names = sections[section[6]]
        text = content[names[4] : names[4] + names[5]]
        for at in range(section[4] + 24, section[4] + section[5], 24):  # the first entry is empty
            name, info, _, place, value, length = struct.unpack_from("<IBBHQQ", content, at)
            kind, binding = info & 15, info >> 4
            out.append((
                text[name : text.index(b"\0", name)].decode(), value, length,
                kinds[kind] if kind < len(kinds) else str(kind),
                bindings[binding] if binding < len(bindings) else str(binding),
                place or None,
            ))
    return out


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """The symbols of object files."""
    return _binary(spark, path, parse_symbols, SYMBOLS)


def split_file(text_df: DataFrame) -> DataFrame:
    """Parts of multi-document texts (column value): a line ``//--- name`` (or
    ``#--- name``) begins the part ``name``; line endings are kept."""
    pieces = F.split("value", r"(?m)^(?://|#|;)---[ \t]+")
    return (
        text_df.select(F.posexplode(pieces).alias("n", "piece"))
        .where("n > 0")
        .select(
            F.regexp_extract("piece", r"^([^\r\n]*?)[ \t]*\r?\n", 1).alias("name"),
            F.regexp_replace("piece", r"^[^\r\n]*\r?\n", "").alias("content"),
        )
    )


# sinks


def _check_output(source: str | None, target: str) -> None:
    if source is not None and source.rstrip("/") == target.rstrip("/"):
        raise ValueError("input and output are the same file")


def write_lines(df: DataFrame, path: str, source: str | None = None) -> None:
    """Text sink of a one-column frame; writing onto the source is refused."""
    _check_output(source, path)
    df.write.text(path)


def append_csv(df: DataFrame, path: str) -> None:
    """A row of statistics appended to a CSV folder."""
    df.write.mode("append").csv(path, header=False)


def write_json(df: DataFrame, path: str, source: str | None = None) -> None:
    _check_output(source, path)
    df.write.json(path)


def write_profile(df: DataFrame, path: str, source: str | None = None) -> None:
    """The binary form: Parquet, read back with ``spark.read.parquet``."""
    _check_output(source, path)
    df.write.parquet(path)


def format_sample_profile(samples: DataFrame) -> DataFrame:
    """The text form of flat sample profiles (name, total, head, lines: array of
    (line, samples)), a row for each function."""
    lines = F.transform(
        F.array_sort("lines"), lambda x: F.concat(F.lit(" "), x["line"].cast("string"), F.lit(": "), x["samples"].cast("string"))
    )
    head = F.concat_ws(":", "name", F.col("total").cast("string"), F.col("head").cast("string"))
    return samples.select(F.concat_ws("\n", head, lines).alias("value"))


def instr_profile_lines(profiles: DataFrame) -> DataFrame:
    """The text form of instrumentation profiles (name, hash, counters), a row of
    lines for each record, for ``write_lines``."""
    digits = F.transform("counters", lambda c: c.cast("string"))
    return profiles.select(
        F.concat_ws(
            "\n", "name", F.lit("# Func Hash:"), F.col("hash").cast("string"), F.lit("# Num Counters:"),
            F.size("counters").cast("string"), F.lit("# Counter Values:"), digits, F.lit(""),
        ).alias("value")
    )


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """Rescan of ``write_profile``."""
    return spark.read.parquet(path)


def lcov_lines(functions: DataFrame) -> DataFrame:
    """Coverage export in lcov form of (file, function, line, count), as one
    column of lines a file."""
    per_file = functions.groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct("line", "function", "count"))).alias("f")
    )
    return per_file.select(
        F.array_join(
            F.concat(
                F.array(F.concat(F.lit("SF:"), "file")),
                F.transform("f", lambda x: F.concat_ws(",", F.concat(F.lit("FN:"), x["line"].cast("string")), x["function"])),
                F.transform("f", lambda x: F.concat_ws(",", F.concat(F.lit("FNDA:"), x["count"].cast("string")), x["function"])),
                F.array(F.concat(F.lit("FNF:"), F.size("f").cast("string"))),
                F.array(F.concat(F.lit("FNH:"), F.size(F.filter("f", lambda x: x["count"] > 0)).cast("string"))),
                F.array(F.lit("end_of_record")),
            ),
            "\n",
        ).alias("value")
    )
