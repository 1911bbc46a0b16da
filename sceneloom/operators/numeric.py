"""Numeric programs: sums, summaries, gaps, shares, ranges, formulas, fractions, integrals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import gcd
from ..registry import query, table


@query(
    "pairwise_comparison_count",
    "P06",
    ("counting", "comparison"),
    "WITH s AS (SELECT l_partkey, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS r, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'N') AS n FROM lineitem GROUP BY l_partkey) SELECT count(*) FILTER (WHERE r > n) AS r_wins, count(*) FILTER (WHERE r < n) AS n_wins FROM s",
)
def pairwise_comparison_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned items where one series beats the other: one shuffle with conditional averages."""
    price = lambda flag: F.avg(F.when(F.col("l_returnflag") == flag, F.col("l_extendedprice")))
    s = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(price("R").alias("r"), price("N").alias("n"))
    return s.agg(F.count_if(F.col("r") > F.col("n")).alias("r_wins"), F.count_if(F.col("r") < F.col("n")).alias("n_wins"))


@query("group_sum", "P07", ("aggregation",), "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS total, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY ALL")
def group_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.sum("l_quantity").cast("long").alias("qty"))


@query("median_value", "P08", ("aggregation",), "SELECT o_orderpriority, round(median(o_totalprice), 4) AS med, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderpriority")
def median_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact median and percentile, both interpolated; percentile_approx is the form for groups beyond memory."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.median("o_totalprice"), 4).alias("med"), F.round(F.percentile("o_totalprice", F.lit(0.9)), 4).alias("p90"))


@query("leave_out_mean", "P08+P26", ("aggregation", "state_update"), "SELECT c_mktsegment, round((sum(c_acctbal) - max(c_acctbal)) / (count(*) - 1), 4) AS rest_mean FROM customer GROUP BY c_mktsegment")
def leave_out_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of what remains when the largest is removed."""
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.round((F.sum("c_acctbal") - F.max("c_acctbal")) / (F.count("*") - 1), 4).alias("rest_mean"))


@query("mode_value", "P09", ("aggregation", "ranking"), "SELECT p_type, arg_max(p_size, (n, -p_size)) AS mode_size FROM (SELECT p_type, p_size, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_type")
def mode_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent value; ties go to the smaller."""
    return table(spark, sf_dir, "part").groupBy("p_type", "p_size").agg(F.count("*").alias("n")).groupBy("p_type").agg(F.max_by("p_size", F.struct("n", -F.col("p_size"))).alias("mode_size"))


@query(
    "group_gap",
    "P13",
    ("formula_evaluation",),
    "SELECT n_regionkey, round(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal ELSE 0 END) - sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal ELSE 0 END), 4) AS change, round(abs(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal ELSE 0 END) - sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal ELSE 0 END)), 4) AS gap FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey",
)
def group_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed change and gap of two supports."""
    part = lambda s: F.sum(F.when(F.col("c_mktsegment") == s, F.col("c_acctbal")).otherwise(0.0))
    change = part("BUILDING") - part("MACHINERY")
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_regionkey").agg(F.round(change, 4).alias("change"), F.round(F.abs(change), 4).alias("gap"))


@query(
    "share_pct",
    "P14",
    ("formula_evaluation",),
    "SELECT o_orderpriority, round(100.0 * sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / sum(o_totalprice), 6) AS pct, CAST(floor(360 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*)) AS BIGINT) AS degrees FROM orders GROUP BY o_orderpriority",
)
def share_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share in percent, and its sector's angle rounded down."""
    done = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.round(F.lit(100.0) * F.sum(F.when(done, F.col("o_totalprice")).otherwise(0.0)) / F.sum("o_totalprice"), 6).alias("pct"), F.floor(F.lit(360) * F.count_if(done) / F.count("*")).alias("degrees")
    )


@query("range_spread", "P15", ("formula_evaluation",), "SELECT s_nationkey, round(max(s_acctbal) - min(s_acctbal), 4) AS spread, round(quantile_cont(s_acctbal, 0.75) - quantile_cont(s_acctbal, 0.25), 4) AS iqr FROM supplier GROUP BY s_nationkey")
def range_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda p: F.percentile("s_acctbal", F.lit(p))
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.round(F.max("s_acctbal") - F.min("s_acctbal"), 4).alias("spread"), F.round(q(0.75) - q(0.25), 4).alias("iqr"))


@query(
    "l1_shift",
    "P13",
    ("formula_evaluation", "comparison"),
    "WITH s AS (SELECT l_shipmode_key, count(*) FILTER (WHERE l_linestatus = 'O') AS a, count(*) FILTER (WHERE l_linestatus = 'F') AS b FROM (SELECT CAST(l_quantity AS BIGINT) % 10 AS l_shipmode_key, l_linestatus FROM lineitem) GROUP BY l_shipmode_key) SELECT CAST(sum(abs(a - b)) AS BIGINT) AS distance FROM s",
)
def l1_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 distance of two compositions over the same segments."""
    s = table(spark, sf_dir, "lineitem").groupBy((F.col("l_quantity").cast("long") % 10).alias("k")).agg(F.count_if(F.col("l_linestatus") == "O").alias("a"), F.count_if(F.col("l_linestatus") == "F").alias("b"))
    return s.agg(F.sum(F.abs(F.col("a") - F.col("b"))).alias("distance"))


@query(
    "derived_formula",
    "P27",
    ("formula_evaluation",),
    "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, round(avg(l_extendedprice / nullif(l_quantity, 0)), 4) AS unit_price FROM lineitem GROUP BY l_returnflag",
)
def derived_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount")) * (1 + c("l_tax"))), 2).alias("charge"), F.round(F.avg(F.try_divide("l_extendedprice", "l_quantity")), 4).alias("unit_price")
    )


@query(
    "solve_unknown",
    "P27",
    ("formula_evaluation",),
    "SELECT o_orderkey, CAST(round(100 * (o_totalprice - sum(l_extendedprice))) AS BIGINT) AS cents, count(*) AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice HAVING count(*) >= 6",
)
def solve_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x in total = sum + n * x, in closed form, as an exact fraction: cents over parts."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"), F.count("*").alias("n")).where("n >= 6")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(lines, "o_orderkey").select("o_orderkey", F.round(F.lit(100) * (F.col("o_totalprice") - F.col("s"))).cast("long").alias("cents"), F.col("n").alias("parts"))


def reduced(num: Column, den: Column) -> Column:
    """num/den in lowest terms, as text."""
    g = gcd(num, den)
    return F.concat((num / g).cast("long").cast("string"), F.lit("/"), (den / g).cast("long").cast("string"))


@query(
    "event_fraction",
    "P33",
    ("formula_evaluation", "counting"),
    "WITH e AS (SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'R') AS num, count(*) AS den FROM lineitem WHERE l_discount > 0.05 GROUP BY l_linestatus) SELECT l_linestatus, CAST(num // gcd(num, den) AS VARCHAR) || '/' || CAST(den // gcd(num, den) AS VARCHAR) AS probability FROM e",
)
def event_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(event | sample space) as a reduced fraction."""
    e = table(spark, sf_dir, "lineitem").where("l_discount > 0.05").groupBy("l_linestatus").agg(F.count_if(F.col("l_returnflag") == "R").alias("num"), F.count("*").alias("den"))
    return e.select("l_linestatus", reduced(F.col("num"), F.col("den")).alias("probability"))


@query(
    "trapezoid_area",
    "P40",
    ("formula_evaluation", "aggregation"),
    "WITH p AS (SELECT user_id, event_id AS x, value AS y, lag(event_id) OVER w AS px, lag(value) OVER w AS py FROM events WHERE event_id BETWEEN 1000 AND 6000 WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, round(sum((x - px) * (y + py) / 2), 3) AS area FROM p GROUP BY user_id",
)
def trapezoid_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trapezoids between the points inside a closed interval; nothing is interpolated at its ends."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    p = table(spark, sf_dir, "events").where(F.col("event_id").between(1000, 6000)).select("user_id", (F.col("event_id") - F.lag("event_id").over(w)).alias("dx"), (F.col("value") + F.lag("value").over(w)).alias("sy"))
    return p.groupBy("user_id").agg(F.round(F.sum(F.col("dx") * F.col("sy") / 2), 3).alias("area"))


@query(
    "hierarchy_totals",
    "P07+P23",
    ("aggregation",),
    "SELECT r_name, n_name, round(sum(c_acctbal), 2) AS total, CAST(grouping(n_name) AS INTEGER) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
)
def hierarchy_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent totals of a hierarchy by rollup."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.rollup("r_name", "n_name").agg(F.round(F.sum("c_acctbal"), 2).alias("total"), F.grouping("n_name").cast("int").alias("level"))


@query("cube_counts", "P07", ("aggregation",), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
