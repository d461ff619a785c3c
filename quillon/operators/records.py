"""Operators over remarks, profiles, traces, coverage and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

LIMIT = "cast(18446744073709551615 as decimal(38,0))"


# remarks


def filter_remarks(
    remarks: DataFrame,
    name: str | None = None,
    name_regex: str | None = None,
    pass_name: str | None = None,
    pass_regex: str | None = None,
    remark_type: str | None = None,
) -> DataFrame:
    """Exact or whole-value regular-expression filters, all of which must hold."""
    for column, value in (("name", name), ("pass", pass_name), ("remark_type", remark_type)):
        if value is not None:
            remarks = remarks.where(F.col(column) == value)
    for column, pattern in (("name", name_regex), ("pass", pass_regex)):
        if pattern is not None:
            remarks = remarks.where(F.col(column).rlike(f"^(?:{pattern})$"))
    return remarks


def count_remarks(remarks: DataFrame, group_by: str = "source") -> DataFrame:
    """Counts by 'function', 'source' or 'function-with-loc' (file:function)."""
    key = {
        "function": F.col("function"),
        "source": F.col("file"),
        "function-with-loc": F.concat_ws(":", "file", "function"),
    }[group_by]
    return remarks.groupBy(key.alias("key")).agg(F.count("*").alias("count"))


def instruction_counts(remarks: DataFrame) -> DataFrame:
    """Instruction and stack sizes by function; a value that is not a whole
    number raises."""
    wanted = remarks.where(F.col("name").isin("InstructionCount", "StackSize"))
    value = F.coalesce(F.col("args")["NumInstructions"], F.col("args")["NumStackBytes"])
    value = F.when(value.isNull(), F.raise_error("expected an integer value")).otherwise(
        value.cast("bigint")
    )
    return wanted.groupBy("function").agg(
        F.sum(F.when(F.col("name") == "InstructionCount", value)).alias("instructions"),
        F.sum(F.when(F.col("name") == "StackSize", value)).alias("stack_bytes"),
    )


def size_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Functions whose sizes differ, or that one side lacks, with both values
    and the differences.  A side without instruction counts raises."""
    sides = []
    for side in (before, after):
        sizes = instruction_counts(side)
        sides.append(sizes.where("instructions is not null"))
    if any(s.isEmpty() for s in sides):
        raise ValueError("file did not contain any instruction-count remarks")
    a, b = (
        s.select("function", F.col("instructions").alias(f"instructions_{k}"),
                 F.col("stack_bytes").alias(f"stack_bytes_{k}"))
        for s, k in zip(sides, ("a", "b"))
    )
    both = a.join(b, "function", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.withColumns(
        {
            "instructions_diff": zero("instructions_b") - zero("instructions_a"),
            "stack_bytes_diff": zero("stack_bytes_b") - zero("stack_bytes_a"),
        }
    ).where("not (instructions_a <=> instructions_b and stack_bytes_a <=> stack_bytes_b)")


# instrumentation profiles


def remap_names(df: DataFrame, remap: DataFrame, column: str = "name") -> DataFrame:
    """Names replaced by ``remap`` (old, new); others stay."""
    new = remap.select(F.col("old").alias(column), "new")
    return df.join(new, column, "left").withColumn(column, F.coalesce("new", column)).drop("new")


def merge_profiles(profiles: DataFrame, weight: str | None = None) -> DataFrame:
    """Element-wise counter sums by (name, hash), saturating at 2^64 - 1.

    Records of one key with unequal counter lengths raise."""
    w = F.col(weight) if weight else F.lit(1)
    each = profiles.select(
        "name", "hash", F.size("counters").alias("n"), w.cast("decimal(10,0)").alias("w"),
        F.posexplode("counters").alias("at", "value"),
    )
    summed = each.groupBy("name", "hash", "at").agg(
        F.expr(f"least(sum(value * w), {LIMIT})").cast("decimal(20,0)").alias("value"),
        F.min("n").alias("low"),
        F.max("n").alias("high"),
    )
    merged = summed.groupBy("name", "hash").agg(
        F.array_sort(F.collect_list(F.struct("at", "value"))).alias("c"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )
    checked = F.when(
        F.col("low") != F.col("high"), F.raise_error(F.lit("function basic block count change detected (counter mismatch)"))
    ).otherwise(F.transform("c", lambda x: x["value"]))
    return merged.select("name", "hash", checked.alias("counters"))


def show_profile(profiles: DataFrame, cutoff: int = 0) -> DataFrame:
    """Totals: functions, the largest first counter and the largest other counter."""
    most = F.array_max("counters")
    return profiles.where(most >= cutoff).agg(
        F.count("*").alias("total_functions"),
        F.max(F.get("counters", F.lit(0))).alias("maximum_function_count"),
        F.max(F.array_max(F.slice("counters", 2, 1 << 30))).alias("maximum_internal_block_count"),
    )


def covered_functions(profiles: DataFrame) -> DataFrame:
    return profiles.where(F.exists("counters", lambda c: c > 0))


def profile_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Shared share of two profiles: the sum over counters of the smaller share."""
    def shares(p):
        each = p.select("name", "hash", F.posexplode("counters").alias("at", "v"))
        total = p.select(F.explode("counters").alias("v")).agg(F.sum("v").alias("total"))
        return each.crossJoin(F.broadcast(total)).select(  # one row of totals
            "name", "hash", "at", (F.col("v").cast("double") / F.col("total").cast("double")).alias("share")
        )

    x, y = shares(a).withColumnRenamed("share", "sa"), shares(b).withColumnRenamed("share", "sb")
    return x.join(y, ["name", "hash", "at"], "full_outer").agg(
        F.sum(F.least(F.coalesce("sa", F.lit(0.0)), F.coalesce("sb", F.lit(0.0)))).alias("overlap")
    )


# sample profiles


def remap_samples(samples: DataFrame, remap: DataFrame) -> DataFrame:
    """Every name of a path and every call target replaced by ``remap`` (old,
    new), then equal rows summed."""
    keyed = samples.withColumn("row", F.xxhash64("path", "sites", "line", "total", "samples", "head"))
    new = remap.select("old", "new")
    parts = keyed.select("row", F.posexplode("path").alias("at", "old")).distinct().join(new, "old", "left")
    paths = parts.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("new", "old").alias("n")))).alias("p")
    )
    calls = (
        keyed.select("row", F.explode("call_targets").alias("old", "n"))
        .join(new, "old", "left")
        .groupBy("row", F.coalesce("new", "old").alias("target"))
        .agg(F.sum("n").alias("n"))
        .groupBy("row")
        .agg(F.map_from_entries(F.collect_list(F.struct("target", "n"))).alias("calls"))
    )
    renamed = keyed.join(paths, "row").join(calls, "row", "left").select(
        F.transform("p", lambda x: x["n"]).alias("path"), "sites", "line", "samples", "total", "head",
        F.coalesce("calls", F.create_map().cast("map<string,bigint>")).alias("call_targets"),
    )
    return merge_samples(renamed)


def merge_samples(samples: DataFrame) -> DataFrame:
    """Sums by path, sites and line; call targets add up by name."""
    key = ["path", "sites", "line"]
    totals = samples.groupBy(*key).agg(F.sum("samples").alias("samples"), F.sum("total").alias("total"), F.sum("head").alias("head"))
    calls = (
        samples.select(*key, F.explode("call_targets").alias("target", "n"))
        .groupBy(*key, "target").agg(F.sum("n").alias("n"))
        .groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", "n")))).alias("call_targets"))
    )
    same = [totals[k].eqNullSafe(calls[k]) for k in key]
    return totals.join(calls, same[0] & same[1] & same[2], "left").select(
        *(totals[k] for k in key), "samples", "total", "head",
        F.coalesce("call_targets", F.create_map().cast("map<string,bigint>")).alias("call_targets"),
    )


def flatten_samples(samples: DataFrame) -> DataFrame:
    """Samples by leaf function, whatever it was inlined into."""
    return samples.where("line is not null").groupBy(F.element_at("path", -1).alias("function")).agg(
        F.sum("samples").alias("samples")
    )


def order_samples(samples: DataFrame) -> DataFrame:
    """Functions by falling total, then name."""
    return samples.where("size(path) = 1 and line is null").orderBy(F.desc("total"), F.col("path")[0])


def drop_generated(samples: DataFrame) -> DataFrame:
    """Rows without a compiler-generated name in their path."""
    return samples.where(~F.exists("path", lambda p: p.rlike("^__(cxx_global_var_init|tls_init)")))


# traces


def pair_calls(trace: DataFrame) -> DataFrame:
    """Each function-enter with its exit in the same thread, by nesting depth."""
    order = Window.partitionBy("thread").orderBy("tsc")
    step = F.when(F.col("kind") == "function-enter", 1).otherwise(-1)
    deep = trace.withColumn("step", step).withColumn("after", F.sum("step").over(order))
    depth = F.when(F.col("step") == 1, F.col("after")).otherwise(F.col("after") + 1)
    deep = deep.withColumn("depth", depth)
    pair = Window.partitionBy("thread", "depth").orderBy("tsc")
    return (
        deep.withColumns({"exit_tsc": F.lead("tsc").over(pair), "exit_kind": F.lead("kind").over(pair)})
        .where("kind = 'function-enter'")
        .select("thread", "func_id", "depth", F.col("tsc").alias("enter_tsc"),
                F.when(F.col("exit_kind") != "function-enter", F.col("exit_tsc")).alias("exit_tsc"))
    )


def call_stacks(trace: DataFrame) -> DataFrame:
    """thread, enter_tsc, func_id and the stack (functions from the outermost in)
    of each call.

    The function at each depth of a stack is the last one entered at that depth,
    so a stack is read off running maxima, one for each depth that a thread
    reaches; no call is compared with another."""
    calls = pair_calls(trace)
    deepest = calls.agg(F.max("depth")).head()[0] or 0
    if deepest > 1000:
        raise ValueError("a call stack of more than 1,000 calls")
    order = Window.partitionBy("thread").orderBy("enter_tsc")
    at = [
        F.last(F.when(F.col("depth") == d, F.col("func_id")), ignorenulls=True).over(order)
        for d in range(1, deepest + 1)
    ]
    every = F.array(*at) if at else F.array().cast("array<int>")
    return calls.select(
        "thread", "enter_tsc", "func_id", "depth", every.alias("every")
    ).select("thread", "enter_tsc", "func_id", F.slice("every", 1, F.col("depth").cast("int")).alias("stack"))


def unique_stacks(trace: DataFrame) -> DataFrame:
    """Number of distinct call stacks; an empty trace raises."""
    if trace.isEmpty():
        raise ValueError("No instrumented calls were accounted in the input file")
    return call_stacks(trace).agg(F.count_distinct("stack").alias("unique_stacks"))


# coverage


def coverage_stats(edges: DataFrame) -> DataFrame:
    """All and covered edges and functions of (edge_id, function, covered)."""
    return edges.agg(
        F.count("*").alias("all_edges"),
        F.count_if("covered").alias("cov_edges"),
        F.count_distinct("function").alias("all_functions"),
        F.count_distinct(F.when(F.col("covered"), F.col("function"))).alias("cov_functions"),
    )


def not_covered(functions: DataFrame, covered: DataFrame, key: str = "function") -> DataFrame:
    return functions.join(covered, key, "left_anti")


def coverage_report(functions: DataFrame) -> DataFrame:
    """Lines, missed lines and percentage by file, with a totals row (file null)."""
    return functions.rollup("file").agg(
        F.count("*").alias("functions"),
        F.count_if(F.col("count") == 0).alias("missed"),
        F.round(100.0 * F.count_if(F.col("count") > 0) / F.count("*"), 2).alias("percent"),
    )


# symbols and addresses


#: Sizes of pieces by which ranges are found: a range is cut at multiples of the
#: smallest size that is not below its own, so into two pieces at most.
PIECE_BITS = (8, 16, 24, 32, 40, 48, 63)


def lookup_addresses(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """All ranges [start_addr, end_addr) that hold each address; addresses
    without one keep a row of nulls.

    Ranges of like width are joined on the number of the piece that an address
    lies in: equal keys, at most two rows for a range and one for an address and
    a width class, however wide the ranges are."""
    width = F.col("end_addr") - F.col("start_addr")
    bits = F.coalesce(*(F.when(width <= 1 << b, b) for b in PIECE_BITS[:-1]), F.lit(PIECE_BITS[-1]))

    def piece(column, bits):
        return F.expr(f"shiftright({column}, {bits})")

    cut = (
        ranges.where("end_addr > start_addr")
        .withColumn("bits", bits)
        .withColumn("piece", F.explode(F.array_distinct(F.array(piece("start_addr", "bits"), piece("end_addr - 1", "bits")))))
    )
    asked = addresses.withColumn("asked", F.monotonically_increasing_id())
    classes = F.explode(F.array(*map(F.lit, PIECE_BITS))).alias("bits")
    found = (
        addresses.select("address").distinct().select("address", classes)
        .withColumn("piece", piece("address", "bits"))
        .join(cut, ["bits", "piece"])
        .where("address >= start_addr and address < end_addr")
        .drop("bits", "piece")
    )
    return asked.join(found, "address", "left").drop("asked").select(
        *addresses.columns, *ranges.columns
    )


def lookup_lines(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lookup of text lines: a line that is a hexadecimal address gets its
    ranges, any other line passes through as it is."""
    address = F.when(
        F.col("line").rlike("^(0x)?[0-9a-fA-F]{1,15}$"),
        F.conv(F.regexp_replace("line", "^0x", ""), 16, 10).cast("bigint"),
    )
    asked = lines.withColumn("address", address)
    plain = asked.where("address is null")
    return lookup_addresses(asked.where("address is not null"), ranges).unionByName(plain, allowMissingColumns=True)


def correspond(before: DataFrame, after: DataFrame, normal) -> DataFrame:
    """Names of two symbol lists that have one normal form."""
    a = before.select(F.col("name").alias("old"), normal(F.col("name")).alias("key"))
    b = after.select(F.col("name").alias("new"), normal(F.col("name")).alias("key"))
    return a.join(b, "key").where("old <> new").select("old", "new")


def ambiguous(names: DataFrame, normal) -> DataFrame:
    """Normal forms that more than one name has."""
    return (
        names.select("name", normal(F.col("name")).alias("key")).distinct()
        .groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    )


def unmatched(before: DataFrame, after: DataFrame, normal) -> DataFrame:
    a = before.select("name", normal(F.col("name")).alias("key"))
    return a.join(after.select(normal(F.col("name")).alias("key")), "key", "left_anti").select("name")


def module_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Named rows (name, body) that one side lacks or that differ; unnamed
    rows are left out."""
    a = left.where("name is not null").select("name", F.col("body").alias("left_body"))
    b = right.where("name is not null").select("name", F.col("body").alias("right_body"))
    return a.join(b, "name", "full_outer").where("not (left_body <=> right_body)").select(
        "name", F.when(F.col("left_body").isNull(), "only right").when(F.col("right_body").isNull(), "only left").otherwise("differs").alias("difference")
    )
