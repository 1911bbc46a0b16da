"""Selection and ranking programs: extremes, ranks, nearest, option matching, rule violations, progressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, table


@query(
    "extremum_label",
    "P09",
    ("ranking",),
    "SELECT c_nationkey, arg_max(c_name, (c_acctbal, c_name)) AS richest, arg_min(c_name, (c_acctbal, c_name)) AS poorest FROM customer GROUP BY c_nationkey",
)
def extremum_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label of the extreme metric in each group; ties go to the later label for the largest, the earlier for the smallest."""
    by = F.struct("c_acctbal", "c_name")
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.max_by("c_name", by).alias("richest"), F.min_by("c_name", by).alias("poorest"))


@query("extreme_metric_value", "P09", ("ranking",), "SELECT p_type, max(p_retailprice) AS hi, min(p_retailprice) AS lo FROM part GROUP BY p_type")
def extreme_metric_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.max("p_retailprice").alias("hi"), F.min("p_retailprice").alias("lo"))


@query(
    "winner_gap",
    "P09",
    ("ranking", "comparison"),
    "WITH r AS (SELECT c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey DESC) AS rn, max(c_acctbal) OVER w - min(c_acctbal) OVER w AS span FROM customer WINDOW w AS (PARTITION BY c_mktsegment)) SELECT c_mktsegment, round(max(c_acctbal) - min(c_acctbal), 4) AS gap, round((max(c_acctbal) - min(c_acctbal)) / greatest(max(span), 1e-9), 6) AS normalized_gap FROM r WHERE rn <= 2 GROUP BY c_mktsegment",
)
def winner_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap between winner and runner-up, plain and over the span, by aggregates that combine on the map side: the runner-up's value is the winner's where several rows have it, else the best below it."""
    values = table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_acctbal").agg(F.count("*").alias("n"))
    top = values.groupBy("c_mktsegment").agg(F.max("c_acctbal").alias("best"), F.max_by("n", "c_acctbal").alias("holders"), (F.max("c_acctbal") - F.min("c_acctbal")).alias("span"))
    below = values.join(top.select("c_mktsegment", "best"), "c_mktsegment").where("c_acctbal < best").groupBy("c_mktsegment").agg(F.max("c_acctbal").alias("second"))
    stats = top.join(below, "c_mktsegment", "left")
    # One row alone has no runner-up but itself.
    gap = F.when(F.col("holders") > 1, F.lit(0.0)).otherwise(F.col("best") - F.coalesce("second", "best"))
    return stats.select("c_mktsegment", F.round(gap, 4).alias("gap"), F.round(gap / F.greatest("span", F.lit(1e-9)), 6).alias("normalized_gap"))


@query(
    "ranked_item",
    "P10",
    ("ranking",),
    "SELECT n_regionkey, c_name, c_acctbal FROM (SELECT n_regionkey, c_name, c_acctbal, dense_rank() OVER (PARTITION BY n_regionkey ORDER BY c_acctbal DESC) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE k = 3",
)
def ranked_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-th rank over distinct values (dense)."""
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.dense_rank().over(Window.partitionBy("n_regionkey").orderBy(F.desc("c_acctbal")))
    return rows.withColumn("k", k).where("k = 3").select("n_regionkey", "c_name", "c_acctbal")


@query(
    "ranked_value",
    "P10",
    ("ranking",),
    "SELECT p_size, p_retailprice FROM (SELECT p_size, p_retailprice, dense_rank() OVER (PARTITION BY p_size ORDER BY p_retailprice) AS k FROM (SELECT DISTINCT p_size, p_retailprice FROM part)) WHERE k = 2",
)
def ranked_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order statistic over distinct values."""
    k = F.dense_rank().over(Window.partitionBy("p_size").orderBy("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_size", "p_retailprice").distinct().withColumn("k", k).where("k = 2").drop("k")


@query(
    "ranked_difference",
    "P10+P13",
    ("ranking", "formula_evaluation"),
    "WITH r AS (SELECT n_nationkey, sum(c_acctbal) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey), k AS (SELECT s, row_number() OVER (ORDER BY s DESC, n_nationkey) AS k FROM r) SELECT round(max(s) FILTER (WHERE k = 1) - max(s) FILTER (WHERE k = 4), 4) AS diff FROM k",
)
def ranked_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of the first and the fourth rank: a top-k of four rows, so no full sort."""
    sums = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("s"))
    top = sums.orderBy(F.desc("s"), "c_nationkey").limit(4)
    return top.agg(F.round(F.max("s") - F.min("s"), 4).alias("diff"))


@query(
    "topk_then_sum",
    "P11",
    ("ranking", "aggregation"),
    "WITH q AS (SELECT l_suppkey, sum(l_quantity) AS qty, sum(l_extendedprice) AS price FROM lineitem GROUP BY l_suppkey ORDER BY qty DESC, l_suppkey LIMIT 3) SELECT round(sum(price), 2) AS total, count(*) AS k FROM q",
)
def topk_then_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top k by one measure, then the sum of another."""
    q = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"))
    return q.orderBy(F.desc("qty"), "l_suppkey").limit(3).agg(F.round(F.sum("price"), 2).alias("total"), F.count("*").alias("k"))


@query(
    "nearest_value_label",
    "P12",
    ("ranking", "comparison"),
    "SELECT p_type, arg_min(p_name, (abs(p_retailprice - 950.0), p_partkey)) AS nearest, arg_max(p_name, (abs(p_retailprice - 950.0), p_partkey)) AS farthest FROM part GROUP BY p_type",
)
def nearest_value_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.struct(F.abs(F.col("p_retailprice") - 950.0), "p_partkey")
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.min_by("p_name", by).alias("nearest"), F.max_by("p_name", by).alias("farthest"))


@query(
    "option_match",
    "P28",
    ("matching",),
    "WITH v AS (SELECT l_returnflag, count(*) // 1000 AS answer FROM lineitem GROUP BY l_returnflag), o AS (SELECT chr(65 + CAST(i AS INTEGER)) AS label, i * 10 AS lo, i * 10 + 9 AS hi FROM range(26) t(i)) SELECT l_returnflag, label FROM v JOIN o ON answer BETWEEN lo AND hi",
)
def option_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The option letter whose band holds the computed value: bands are equal, so the match is an equi-join on the band's number."""
    options = spark.range(26).select(F.char(F.lit(65) + F.col("id")).alias("label"), F.col("id").alias("band"))
    value = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.floor(F.floor(F.count("*") / 1000) / 10).alias("band"))
    return value.join(F.broadcast(options), "band").select("l_returnflag", "label")


@query(
    "rule_violation",
    "P29",
    ("filtering", "comparison"),
    "SELECT p_type, count(*) AS n FROM part WHERE p_size > 45 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) GROUP BY p_type",
)
def rule_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that break the rule "every large part is in a large line": anti-join."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").where("p_size > 45").join(lines, "p_partkey", "left_anti").groupBy("p_type").agg(F.count("*").alias("n"))


@query(
    "unique_odd_one_out",
    "P29",
    ("comparison",),
    "SELECT l_orderkey, any_value(l_partkey) AS l_partkey FROM (SELECT l_orderkey, l_returnflag, min(l_partkey) AS l_partkey, count(*) AS n, count(*) OVER (PARTITION BY l_orderkey) AS kinds, sum(count(*)) OVER (PARTITION BY l_orderkey) AS total FROM lineitem GROUP BY l_orderkey, l_returnflag) WHERE n = 1 AND kinds = 2 AND total >= 5 GROUP BY l_orderkey",
)
def unique_odd_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one item of a group whose signature no other item has."""
    kinds = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"), F.min("l_partkey").alias("l_partkey"))
    order = kinds.groupBy("l_orderkey").agg(F.count("*").alias("kinds"), F.sum("n").alias("total"), F.min(F.when(F.col("n") == 1, F.col("l_partkey"))).alias("l_partkey"))
    return order.where("kinds = 2 AND total >= 5 AND l_partkey IS NOT NULL").select("l_orderkey", "l_partkey")


@query(
    "progression_completion",
    "P30",
    ("transformation", "matching"),
    "WITH r AS (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, 2 * event_id - p AS next_value FROM r WHERE k = 1 AND p IS NOT NULL",
)
def progression_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next term of an arithmetic progression, from the last two."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    r = table(spark, sf_dir, "events").select("user_id", "event_id", F.lag("event_id").over(w).alias("p"), F.lead("event_id").over(w).alias("after"))
    return r.where("after IS NULL AND p IS NOT NULL").select("user_id", (F.lit(2) * F.col("event_id") - F.col("p")).alias("next_value"))


@query(
    "unanswerable_lookup",
    "P01+P09",
    ("direct_retrieval",),
    "WITH w AS (SELECT CAST(i AS BIGINT) AS c_nationkey FROM range(30) t(i)) SELECT w.c_nationkey, coalesce(arg_max(c_name, (c_acctbal, c_name)), 'unanswerable') AS answer FROM w LEFT JOIN customer c ON c.c_nationkey = w.c_nationkey GROUP BY w.c_nationkey",
)
def unanswerable_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer, or "unanswerable" where the asked-for key has no support."""
    best = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("c_nationkey")).agg(F.max_by("c_name", F.struct("c_acctbal", "c_name")).alias("answer"))
    asked = spark.range(30).select(F.col("id").alias("c_nationkey"))
    return asked.join(best, "c_nationkey", "left").select("c_nationkey", F.coalesce("answer", F.lit("unanswerable")).alias("answer"))
