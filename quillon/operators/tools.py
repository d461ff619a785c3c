"""Smaller operators of the surveyed tools: symbols, reports, names, order."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark import InheritableThread

# filters over symbols and reports


def undefined_only(symbols: DataFrame) -> DataFrame:
    return symbols.where("section is null")


def external_only(symbols: DataFrame) -> DataFrame:
    """Symbols that others can see: hidden ones stay, internal and local ones go."""
    return symbols.where(~F.col("linkage").isin("internal", "private", "local"))


def of_architecture(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col("arch") == name)


def report(remarks: DataFrame, pattern: str | None = None, suppressed: tuple[str, ...] = ()) -> DataFrame:
    """Remarks whose pass matches ``pattern``, without the suppressed names."""
    if pattern is not None:
        remarks = remarks.where(F.col("pass").rlike(pattern))
    return remarks.where(~F.col("name").isin(*suppressed)) if suppressed else remarks


def extract_function(functions: DataFrame, name: str) -> DataFrame:
    """One function whole; what it is called with becomes a declaration (its
    row without a body)."""
    wanted = functions.where(F.col("name") == name)
    called = wanted.select(F.explode("calls").alias("name")).distinct()
    declared = functions.where(F.col("name") != name).join(called, "name", "left_semi")
    return wanted.unionByName(declared.withColumn("body", F.lit(None).cast("string")))


def sort_symbols(symbols: DataFrame) -> DataFrame:
    """By name, case-sensitive."""
    return symbols.orderBy("name")


def remarks_by_line(lines: DataFrame, remarks: DataFrame) -> DataFrame:
    """Source lines (file, line, text) with the remarks placed on them; lines
    without one are kept."""
    marks = remarks.groupBy("file", "line").agg(
        F.array_sort(F.collect_set("name")).alias("remarks")
    )
    return lines.join(marks, ["file", "line"], "left")


def number_lines(text: DataFrame) -> DataFrame:
    """file, line (from 1) and text of whole files (file, value)."""
    return text.select("file", F.posexplode(F.split("value", "\r?\n")).alias("at", "text")).select(
        "file", (F.col("at") + 1).alias("line"), "text"
    )


def without_sections(rows: DataFrame, *sections: str) -> DataFrame:
    """Rows of a report without some of its sections."""
    return rows.where(~F.col("section").isin(*sections))


def with_trait(nodes: DataFrame, traits: DataFrame, trait: str) -> DataFrame:
    """Nodes whose operation (op) has a trait; ``traits`` (op, trait)."""
    having = traits.where(F.col("trait") == trait).select("op")
    return nodes.join(having, "op", "left_semi")


def by_name(refs: DataFrame, records: DataFrame, kind: str) -> DataFrame:
    """References (id, name) with the record (name, kind, ...) of that name; a
    name that no record has, or one of another kind, raises."""
    found = refs.join(records.withColumnRenamed("kind", "_kind"), "name", "left")
    checked = F.when(F.col("_kind") == kind, F.col("name")).otherwise(
        F.raise_error(F.concat(F.lit(f"not a {kind}: "), "name"))
    )
    return found.withColumn("name", checked).drop("_kind")


def exists_by_name(refs: DataFrame, records: DataFrame, kind: str) -> DataFrame:
    """References with ``found``: whether a record of that kind has the name."""
    names = records.where(F.col("kind") == kind).select("name").distinct().withColumn("_there", F.lit(True))
    return refs.join(names, "name", "left").withColumn("found", F.coalesce("_there", F.lit(False))).drop("_there")


# names


def char_class(column: Column, name: str) -> Column:
    """Whether a one-character string is of a class of the C locale."""
    classes = {
        "alpha": "[A-Za-z]", "digit": "[0-9]", "alnum": "[A-Za-z0-9]", "upper": "[A-Z]", "lower": "[a-z]",
        "xdigit": "[0-9A-Fa-f]", "space": r"[ \t-\r]", "blank": r"[ \t]", "cntrl": r"[\x00-\x1f\x7f]",
        "punct": r"[!-/:-@\[-`{-~]", "graph": "[!-~]", "print": "[ -~]",
    }
    return column.rlike(f"^{classes[name]}\\z")


def memory_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the bytes of two strings."""
    x, y = a.cast("binary"), b.cast("binary")
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def json_equal(a: Column, b: Column) -> Column:
    """Whether two texts are equal as JSON: order of keys and blanks don't count.
    Null where one is not JSON."""
    return F.to_json(F.try_parse_json(a)) == F.to_json(F.try_parse_json(b))


def demangle(column: Column) -> Column:
    """Names of the public C++ ABI: plain and nested names, parameters of
    built-in, named, pointer and reference types; other names stay."""

    @F.pandas_udf("string")
    def apply(names):
        return names.map(lambda x: x if x is None else _demangled(x))

    return apply(column)


def _demangled(name: str) -> str:
    at = 2

    def source() -> str:
        nonlocal at
        digits = re.compile(r"\d+").match(name, at)
        if not digits:
            raise ValueError(name)
        at = digits.end() + int(digits[0])
        if at > len(name):
            raise ValueError(name)
        return name[digits.end() : at]

    def nested() -> str:
        nonlocal at
        if name[at : at + 1] != "N":
            return source()
        at += 1
        parts = []
        while name[at : at + 1] != "E":
            parts.append(source())
        at += 1
        return "::".join(parts)

    def kind() -> str:
        nonlocal at
        mark = name[at : at + 1]
        if mark in ("P", "R", "K"):
            at += 1
            return kind() + {"P": "*", "R": "&", "K": " const"}[mark]
        if mark in TYPE_NAMES:
            at += 1
            return TYPE_NAMES[mark]
        return nested()

    if not name.startswith("_Z"):
        return name
    try:
        out, kinds = nested(), []
        while at < len(name):
            kinds.append(kind())
    except ValueError:
        return name
    if not kinds:
        return out
    return f"{out}({', '.join(kinds) if kinds != ['void'] else ''})"


def render_names(column: Column, names: dict[str, str]) -> Column:
    """Whole values looked up; others stay."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair)) if names else None
    return F.coalesce(F.try_element_at(table, column), column) if names else column


#: One-letter type names of the public C++ ABI.
TYPE_NAMES = {
    "v": "void", "b": "bool", "c": "char", "a": "signed char", "h": "unsigned char", "s": "short",
    "t": "unsigned short", "i": "int", "j": "unsigned int", "l": "long", "m": "unsigned long",
    "x": "long long", "y": "unsigned long long", "f": "float", "d": "double", "e": "long double",
}


def render_markup(column: Column, symbols: dict[str, str]) -> Column:
    """``{{{symbol:name}}}`` elements replaced by the looked-up name or the name."""
    out = column
    for old, new in symbols.items():
        out = F.replace(out, F.lit("{{{symbol:" + old + "}}}"), F.lit(new))
    return F.regexp_replace(out, r"\{\{\{symbol:([^}]*)\}\}\}", "$1")


def resolve_names(uses: DataFrame, definitions: DataFrame, scopes: DataFrame) -> DataFrame:
    """Each use (id, name, scope) with the definition (name, scope) in the
    innermost enclosing scope; ``scopes`` (scope, outer, depth) lists for each
    scope all that enclose it, itself at depth 0."""
    seen = uses.join(scopes, "scope").join(
        definitions.select("name", F.col("scope").alias("outer"), F.col("id").alias("definition")), ["name", "outer"]
    )
    nearest = seen.groupBy("id").agg(F.min_by("definition", "depth").alias("definition"))
    return uses.join(nearest, "id", "left")


def name_index(records: DataFrame) -> DataFrame:
    return records.select("name", "file", "line").orderBy("name", "file", "line")


# expressions and records


def requirement(expression: str, features: set[str]) -> bool:
    """Value of a feature expression: names, !, &&, ||, parentheses."""
    parts = re.findall(r"[\w.+-]+|&&|\|\||!|\(|\)", expression)
    if "".join(parts) != re.sub(r"\s+", "", expression):
        raise ValueError(f"not a requirement: {expression}")
    at = 0

    def peek():
        return parts[at] if at < len(parts) else None

    def take():
        nonlocal at
        at += 1
        return parts[at - 1]

    def unary():
        if peek() is None:
            raise ValueError(f"unexpected end: {expression}")
        x = take()
        if x == "!":
            return not unary()
        if x == "(":
            value = either()
            if peek() != ")":
                raise ValueError(f"missing ): {expression}")
            take()
            return value
        if x in ("&&", "||", ")"):
            raise ValueError(f"unexpected {x}: {expression}")
        return x in features

    def both():
        value = unary()
        while peek() == "&&":
            take()
            value = unary() and value
        return value

    def either():
        value = both()
        while peek() == "||":
            take()
            value = both() or value
        return value

    result = either()
    if peek() is not None:
        raise ValueError(f"unexpected {peek()}: {expression}")
    return result


def override(df: DataFrame, new: dict[str, Column], derived: dict[str, Callable[[], Column]]) -> DataFrame:
    """Source columns replaced, then the columns derived from them computed again."""
    df = df.withColumns(new)
    for name, make in derived.items():
        df = df.withColumn(name, make())
    return df


def expand_templates(names: DataFrame, templates: DataFrame) -> DataFrame:
    """One record for each name and template row (template, value): a template
    list is small, so it is held in each task; its size is checked."""
    rows = templates.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 template rows")
    body = F.array(*(F.struct(F.lit(r["template"]).alias("template"), F.lit(r["value"]).alias("value")) for r in rows))
    return names.withColumn("t", F.explode(body)).select(F.concat("name", "t.template").alias("name"), "t.value")


def must_have(found: DataFrame, kind: str, column: str = "kind") -> DataFrame:
    """Rows, or an error where a row is not of the kind that is asked for."""
    checked = F.when(F.col(column) == kind, F.col(column)).otherwise(
        F.raise_error(F.concat(F.lit(f"not a {kind}: "), F.col(column)))
    )
    return found.withColumn(column, checked)


# order and limits


def _checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by files in the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-checkpoint-"))
    return df.checkpoint()


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Level of each node (id): one more than the largest level of those it
    depends on.  ``edges`` (before, after).  A cycle raises."""
    level = nodes.select("id", F.lit(None).cast("int").alias("level"))
    open_before = None
    for k in count():
        blocked = (
            edges.select("before", "after")
            .join(level.where("level is null"), F.col("before") == F.col("id"), "left_semi")
            .select("after")
            .distinct()
        )
        settled = F.when(F.col("after").isNull(), F.lit(k))
        level = _checkpointed(
            level.join(blocked, F.col("id") == F.col("after"), "left").select(
                "id", F.coalesce("level", settled).alias("level")
            )
        )
        still_open = level.where("level is null").count()
        if not still_open:
            return level
        # each round settles a node unless all that are open wait for each other
        if still_open == open_before:
            raise ValueError("the dependencies have a cycle")
        open_before = still_open


def sort_includes(text: DataFrame) -> DataFrame:
    """Lines (file, line, text) with every run of #include lines in order; other
    lines, and lines between ``// clang-format off`` and ``on``, keep their places."""
    each = Window.partitionBy("file").orderBy("line")
    switch = F.when(F.col("text").rlike(r"^\s*//\s*clang-format\s+off"), 1).when(
        F.col("text").rlike(r"^\s*//\s*clang-format\s+on"), 0
    )
    marked = text.withColumn("off", F.coalesce(F.last(switch, ignorenulls=True).over(each), F.lit(0)))
    marked = marked.withColumn("inc", F.col("text").rlike(r"^\s*#\s*include\b") & (F.col("off") == 0))
    begins = F.col("inc") & ~F.coalesce(F.lag("inc").over(each), F.lit(False))
    runs = marked.withColumn("run", F.sum(begins.cast("int")).over(each))
    rank = F.row_number().over(Window.partitionBy("file", "run", "inc").orderBy("text", "line"))
    first = F.min("line").over(Window.partitionBy("file", "run", "inc"))
    place = F.when(F.col("inc"), first + rank - 1).otherwise(F.col("line"))
    return runs.withColumn("place", place).select("file", F.col("place").cast("int").alias("line"), "text")


def sort_sections(sections: DataFrame) -> DataFrame:
    """Input sections (section, ...) by name, constructors with a priority by it."""
    priority = F.regexp_extract("section", r"\.(\d+)$", 1)
    return sections.withColumn(
        "place",
        F.row_number().over(
            Window.partitionBy(F.regexp_replace("section", r"\.\d+$", "")).orderBy(
                F.when(priority != "", priority.cast("int")), "section"
            )
        ),
    )


def sort_by_thread(trace: DataFrame) -> DataFrame:
    """Records by thread, then time: the order in which traces are compared."""
    return trace.orderBy("thread", "tsc", "kind")


def with_deadline(spark: SparkSession, action: Callable, seconds: float):
    """``action()``, or None where it takes longer: its Spark jobs are cancelled."""
    import threading
    import uuid

    group = f"deadline-{uuid.uuid4().hex}"
    out: dict = {}
    late = threading.Event()

    def run():
        spark.sparkContext.setJobGroup(group, "with a deadline", interruptOnCancel=True)
        try:
            out["value"] = action()
        except Exception as e:
            if not late.is_set():
                out["error"] = e

    worker = InheritableThread(target=run)
    worker.start()
    worker.join(seconds)
    if worker.is_alive():
        late.set()
        while worker.is_alive():  # a job that begins only now is cancelled too
            spark.sparkContext.cancelJobGroup(group)
            worker.join(0.2)
        return None
    if "error" in out:
        raise out["error"]
    return out.get("value")


def bounded(df: DataFrame, n: int, order: list) -> DataFrame:
    if n < 0:
        raise ValueError("a limit below zero")
    return df.orderBy(*order).limit(n)


def epoch_text(column: Column, width: int = 32) -> Column:
    """Epoch seconds of ``width`` bits (without a sign, 63 at most) as UTC text;
    other values raise."""
    fits = (column >= 0) & (column <= (1 << width) - 1)
    time = F.timestamp_seconds(column)
    text = F.concat(F.year(time).cast("string"), F.date_format(time, "-MM-dd HH:mm:ss"))  # yyyy has a plus from 10000 on
    return F.when(fits, text).otherwise(F.raise_error(F.lit(f"not a {width}-bit time")))


def metrics(results: DataFrame) -> DataFrame:
    """Tests by status, with the sum of each user metric (map column ``data``)."""
    return results.select("status", F.explode_outer("data").alias("metric", "value")).groupBy("status", "metric").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    )


def tally(results: DataFrame) -> DataFrame:
    """Tests by status, with their share of all in percent."""
    whole = F.sum(F.count("*")).over(Window.partitionBy(F.lit(1)))  # over a row for each status
    return results.groupBy("status").agg(F.count("*").alias("n"), F.round(100.0 * F.count("*") / whole, 2).alias("percent"))


#: Reductions that a parallel loop may declare, as aggregates.
REDUCTIONS: dict[str, Callable] = {
    "+": F.sum, "*": F.product, "max": F.max, "min": F.min, "iand": F.bit_and, "ior": F.bit_or,
    "ieor": F.bit_xor, ".and.": F.bool_and, ".or.": F.bool_or,
}


def reduction(operator: str, column: Column | str) -> Column:
    """The aggregate of a declared reduction; operators that are not commutative,
    or are no reductions, raise.  A subtraction is one of them."""
    if operator == "-":
        raise ValueError("the minus reduction operator is no longer supported")
    if operator not in REDUCTIONS:
        raise ValueError(f"not a reduction operator: {operator}")
    return REDUCTIONS[operator](column)


def declared_reduction(combine: Callable, kind: str = "double") -> Callable:
    """An aggregate from a user's function over a numpy array of a group's values."""

    def apply(values: pd.Series) -> float:
        return combine(values.to_numpy())

    return F.pandas_udf(apply, kind)


def structural_duplicates(rows: DataFrame, structure: list[str]) -> DataFrame:
    """The first row (by id) of each structure; unequal types are unequal."""
    w = Window.partitionBy(*structure).orderBy("id")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# functions that users register


class Formatters:
    """Summaries chosen by type name or by a pattern over type names."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.by_name: dict[str, Callable] = {}
        self.by_pattern: list[tuple[str, Callable]] = []
        self.by_predicate: list[tuple[Callable, Callable]] = []

    def register(self, type_name: str, summary: Callable[[Column], Column]) -> None:
        self.by_name[type_name] = summary

    def register_pattern(self, pattern: str, summary: Callable[[Column], Column]) -> None:
        self.by_pattern.append((pattern, summary))

    def register_when(self, predicate: Callable[[Column], Column], summary: Callable[[Column], Column]) -> None:
        """A summary for values that a predicate picks; the first that holds counts."""
        self.by_predicate.append((predicate, summary))

    def register_python(self, name: str, f: Callable, kind: str = "string") -> None:
        self.spark.udf.register(name, f, kind)

    def summaries(self, df: DataFrame, type_column: str, value: str) -> DataFrame:
        """A summary for each row, by exact name first, then by pattern, then by
        predicate; null without one."""
        chosen = F.lit(None).cast("string")
        for holds, f in reversed(self.by_predicate):
            chosen = F.when(holds(F.col(value)), f(F.col(value))).otherwise(chosen)
        for pattern, f in reversed(self.by_pattern):
            chosen = F.when(F.col(type_column).rlike(f"^(?:{pattern})$"), f(F.col(value))).otherwise(chosen)
        for name, f in self.by_name.items():
            chosen = F.when(F.col(type_column) == name, f(F.col(value))).otherwise(chosen)
        return df.withColumn("summary", chosen)


def children_provider(df: DataFrame, count: Callable, child: Callable, schema: str) -> DataFrame:
    """One row for each child of each row: ``count(row)`` and ``child(row, i)``."""
    import pandas as pd

    names = T.StructType.fromDDL(schema).names

    def expand(batches):
        for batch in batches:
            rows = [child(r, i) for r in batch.to_dict("records") for i in range(count(r))]
            yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(expand, schema)


def summary_template(template: str) -> Column:
    """A declared summary: ``${field}`` stands for a field, ``${#field}`` for the
    number of elements of an array; the rest is text."""
    parts = re.split(r"(\$\{#?[\w.]+\})", template)
    out = []
    for part in filter(None, parts):
        if name := re.fullmatch(r"\$\{(#?)([\w.]+)\}", part):
            field = F.col(name[2])
            out.append((F.size(field) if name[1] else field).cast("string"))
        else:
            out.append(F.lit(part))
    return F.concat(*out)


def resolver(spark: SparkSession, name: str, cls: type, schema: str) -> None:
    """A class with arguments as a table function: ``cls.eval(self, *args)`` yields
    rows of ``schema``; SQL calls it by ``name``."""
    spark.udtf.register(name, F.udtf(cls, returnType=schema))


def advise(df: DataFrame, key: str, order: str, advisor: Callable, schema: str) -> DataFrame:
    """Decisions of an advisor with memory: ``advisor()`` makes one for each key,
    which is called with every row (a dict) of the key in order."""
    names = T.StructType.fromDDL(schema).names

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        one = advisor()
        return pd.DataFrame([one(r) for r in rows.sort_values(order).to_dict("records")], columns=names)

    return df.groupBy(key).applyInPandas(run, schema)


def categories(column: Column, names: list[str]) -> Column:
    """Place of a value in an enumeration; a value outside it raises."""
    table = F.create_map(*(F.lit(x) for pair in zip(names, range(len(names))) for x in pair))
    return F.coalesce(
        F.try_element_at(table, column), F.raise_error(F.concat(F.lit("no such category: "), column)).cast("int")
    )


def rewrite(nodes: DataFrame, rules: DataFrame, rounds: int = 100) -> DataFrame:
    """Operations (id, op, n_args) rewritten by rules (op, n_args, new_op) until no
    rule matches; rules that go on for more than ``rounds`` raise."""
    new = rules.select("op", "n_args", "new_op")
    for _ in range(rounds):
        found = nodes.join(new, ["op", "n_args"], "left")
        if found.where("new_op is not null").isEmpty():
            return nodes
        nodes = _checkpointed(found.select("id", F.coalesce("new_op", "op").alias("op"), "n_args"))
    raise ValueError("the rules do not come to an end")


def by_program(df: DataFrame, column: str, command: list[str]) -> DataFrame:
    """Rows with the line (verdict) that a program answers to each value: it gets
    a line for each row and must write as many."""
    schema = T.StructType([*df.schema.fields, T.StructField("verdict", T.StringType())])

    def run(batches):
        import subprocess

        for batch in batches:
            text = "".join(f"{x}\n" for x in batch[column])
            done = subprocess.run(command, input=text, capture_output=True, text=True, check=True)
            yield batch.assign(verdict=done.stdout.splitlines())

    return df.mapInPandas(run, schema)


def mutate(df: DataFrame, column: str, mutator: Callable[[Column], Column]) -> DataFrame:
    """A column changed by a user's mutator."""
    return df.withColumn(column, mutator(F.col(column)))
