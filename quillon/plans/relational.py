"""Standard relational and streaming queries over the driver's tables.

The surveyed project has no counterpart of these; they are kept apart from the
queries of its own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import asof
from ..streaming import windows


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q1_pricing_summary(spark, sf_dir):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        _t(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.round(F.sum(price), 2).alias("revenue"),
            F.count("*").alias("n_rows"),
        )
    )


def q3_top_orders(spark, sf_dir):
    """The ten orders of a segment with the largest revenue."""
    customer = _t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    line = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
        .groupBy("l_orderkey", "o_orderdate")
        .agg(F.round(revenue, 2).alias("revenue"))
        .orderBy(F.desc("revenue"), "l_orderkey")
        .limit(10)
    )


def q5_nation_revenue(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount")
    return (
        line.join(_t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name", "n_name")
        .agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    )


def joins(spark, sf_dir):
    """Row counts of every join kind between customers and orders."""
    c = _t(spark, sf_dir, "customer").select("c_custkey")
    o = _t(spark, sf_dir, "orders").where("o_totalprice > 100000").select("o_orderkey", "o_custkey")
    on = F.col("c_custkey") == F.col("o_custkey")
    kinds = ["inner", "left_outer", "right_outer", "full_outer", "left_semi", "left_anti"]
    counts = [
        c.join(o, on, kind).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        for kind in kinds
    ]
    out = counts[0]
    for part in counts[1:]:
        out = out.union(part)
    return out


def rollup_cube(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem")
    r = line.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    c = line.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    return r.select(F.lit("rollup").alias("how"), "*").union(c.select(F.lit("cube"), "*"))


def distinct_aggregates(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"),
        F.sum_distinct("l_linenumber").alias("line_sum"), F.min("l_shipdate").cast("date").alias("first_day"),
        F.round(F.avg("l_quantity"), 6).alias("mean_qty"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd_qty"),
    )


def window_functions(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return _t(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.row_number().over(w).alias("rn"), F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"),
        F.ntile(4).over(w).alias("quarter"), F.lag("o_orderkey").over(w).alias("prev"),
        F.lead("o_orderkey").over(w).alias("next"),
        F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last3"),
        F.first("o_orderkey").over(w).alias("first_order"),
    )


def top_k_per_group(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return (
        _t(spark, sf_dir, "customer").withColumn("rn", F.row_number().over(w)).where("rn <= 3")
        .select("c_nationkey", "c_custkey", "rn")
    )


def set_operations(spark, sf_dir):
    a = _t(spark, sf_dir, "lineitem").where("l_quantity > 25").select("l_partkey")
    b = _t(spark, sf_dir, "lineitem").where("l_discount > 0.05").select("l_partkey")
    parts = {
        "union": a.union(b).distinct(), "union_all": a.union(b), "intersect": a.intersect(b),
        "intersect_all": a.intersectAll(b), "except": a.subtract(b), "except_all": a.exceptAll(b),
    }
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = row if out is None else out.union(row)
    return out


def dates(spark, sf_dir):
    d = F.col("o_orderdate")
    return _t(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("d"),
        F.quarter(d).alias("q"), F.date_trunc("month", d).cast("date").alias("month_start"),
        F.date_format(d, "yyyy-MM-dd").alias("text"), F.datediff(F.lit("1999-01-01").cast("date"), d.cast("date")).alias("days"),
        F.add_months(d.cast("date"), 1).alias("later"), F.unix_timestamp(d.cast("timestamp")).alias("epoch"),
    )


def strings(spark, sf_dir):
    p = F.col("p_name")
    return _t(spark, sf_dir, "part").select(
        "p_partkey", F.upper(p).alias("up"), F.length(p).alias("n"), F.substring(p, 2, 3).alias("mid"),
        F.instr(p, "e").alias("at"), F.regexp_replace(p, "[aeiou]", "_").alias("masked"),
        F.split_part("p_type", F.lit(" "), F.lit(1)).alias("word"), p.contains("a").alias("has_a"),
        F.rpad(F.lpad("p_brand", 12, "*"), 14, "-").alias("padded"),
    )


def pivot(spark, sf_dir):
    return (
        _t(spark, sf_dir, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"])
        .agg(F.count(F.lit(1)))
        .select("l_linestatus", *(F.col(x).alias(f"n_{x.lower()}") for x in "ANR"))
    )


def asof_join(spark, sf_dir):
    """Each event with the user's previous event."""
    e = _t(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id")
    return asof.asof_join(e, e, ["user_id"], "t").select("event_id", "event_id_right")


def event_windows(spark, sf_dir):
    return windows.batch_windows(_t(spark, sf_dir, "events"))


def event_stream(spark, sf_dir):
    return windows.stream_windows(spark, f"{sf_dir}/events.parquet")


def event_sessions(spark, sf_dir):
    return windows.sessions(_t(spark, sf_dir, "events"))


QUERIES = {
    f.__name__: f
    for f in (
        q1_pricing_summary, q3_top_orders, q5_nation_revenue, joins, rollup_cube, distinct_aggregates,
        window_functions, top_k_per_group, set_operations, dates, strings, pivot, asof_join,
        event_windows, event_stream, event_sessions,
    )
}

_WINDOWS = """SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01'))::BIGINT AS window_start, event_type,
       count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"""

ORACLE_SQL = {
    "q1_pricing_summary": """
        SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
               round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_rows
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "q3_top_orders": """
        SELECT l_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        WHERE c_mktsegment = 'BUILDING' GROUP BY ALL ORDER BY revenue DESC, l_orderkey LIMIT 10""",
    "q5_nation_revenue": """
        SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "joins": """
        WITH o AS (SELECT * FROM orders WHERE o_totalprice > 100000)
        SELECT 'inner' AS kind, count(*) AS n FROM customer JOIN o ON c_custkey = o_custkey
        UNION ALL SELECT 'left_outer', count(*) FROM customer LEFT JOIN o ON c_custkey = o_custkey
        UNION ALL SELECT 'right_outer', count(*) FROM customer RIGHT JOIN o ON c_custkey = o_custkey
        UNION ALL SELECT 'full_outer', count(*) FROM customer FULL JOIN o ON c_custkey = o_custkey
        UNION ALL SELECT 'left_semi', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o)
        UNION ALL SELECT 'left_anti', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM o)""",
    "rollup_cube": """
        SELECT 'rollup' AS how, l_returnflag, l_linestatus, count(*) AS n, GROUPING(l_returnflag, l_linestatus)::BIGINT AS gid
        FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
        UNION ALL SELECT 'cube', l_returnflag, l_linestatus, count(*), GROUPING(l_returnflag, l_linestatus)
        FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
    "distinct_aggregates": """
        SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers,
               CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS line_sum, CAST(min(l_shipdate) AS DATE) AS first_day,
               round(avg(l_quantity), 6) AS mean_qty, round(stddev_samp(l_quantity), 6) AS sd_qty
        FROM lineitem GROUP BY 1""",
    "window_functions": """
        SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER w AS INT) AS rk,
               CAST(dense_rank() OVER w AS INT) AS dr, CAST(ntile(4) OVER w AS INT) AS quarter,
               lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS next,
               round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                     ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3,
               first(o_orderkey) OVER w AS first_order
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "top_k_per_group": """
        SELECT c_nationkey, c_custkey, CAST(rn AS INT) AS rn FROM (
          SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer)
        WHERE rn <= 3""",
    "set_operations": """
        WITH a AS (SELECT l_partkey FROM lineitem WHERE l_quantity > 25),
             b AS (SELECT l_partkey FROM lineitem WHERE l_discount > 0.05)
        SELECT 'union' AS op, count(*) AS n FROM (FROM a UNION FROM b)
        UNION ALL SELECT 'union_all', count(*) FROM (FROM a UNION ALL FROM b)
        UNION ALL SELECT 'intersect', count(*) FROM (FROM a INTERSECT FROM b)
        UNION ALL SELECT 'intersect_all', count(*) FROM (FROM a INTERSECT ALL FROM b)
        UNION ALL SELECT 'except', count(*) FROM (FROM a EXCEPT FROM b)
        UNION ALL SELECT 'except_all', count(*) FROM (FROM a EXCEPT ALL FROM b)""",
    "dates": """
        SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m,
               CAST(day(o_orderdate) AS INT) AS d, CAST(quarter(o_orderdate) AS INT) AS q,
               CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, strftime(o_orderdate, '%Y-%m-%d') AS text,
               CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS INT) AS days,
               CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS later, CAST(epoch(o_orderdate) AS BIGINT) AS epoch
        FROM orders""",
    "strings": """
        SELECT p_partkey, upper(p_name) AS up, CAST(length(p_name) AS INT) AS n, substr(p_name, 2, 3) AS mid,
               CAST(strpos(p_name, 'e') AS INT) AS "at", regexp_replace(p_name, '[aeiou]', '_', 'g') AS masked,
               split_part(p_type, ' ', 1) AS word, contains(p_name, 'a') AS has_a,
               rpad(lpad(p_brand, 12, '*'), 14, '-') AS padded FROM part""",
    "pivot": """
        SELECT l_linestatus, nullif(count(*) FILTER (l_returnflag = 'A'), 0) AS n_a,
               nullif(count(*) FILTER (l_returnflag = 'N'), 0) AS n_n,
               nullif(count(*) FILTER (l_returnflag = 'R'), 0) AS n_r FROM lineitem GROUP BY 1""",
    "asof_join": """
        SELECT e.event_id, (SELECT max(x.event_id) FROM events x WHERE x.user_id = e.user_id AND x.ts =
               (SELECT max(y.ts) FROM events y WHERE y.user_id = e.user_id AND y.ts < e.ts)) AS event_id_right FROM events e""",
    "event_windows": _WINDOWS,
    "event_stream": _WINDOWS,
    "event_sessions": """
        WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE
                   THEN 0 ELSE 1 END AS fresh FROM events),
             n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM s)
        SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS n FROM n GROUP BY user_id, k""",
}
