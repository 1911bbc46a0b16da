"""Counting and filtering programs: lookup, cardinality, thresholds, Boolean composition, group predicates.

Each is one pass with conditional aggregates, so that Catalyst prunes columns and combines partially before a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table


def truth(p: Column) -> Column:
    """Two-valued truth of a predicate: null counts as false."""
    return F.coalesce(p, F.lit(False))


def boolean(kind: str, a: Column, b: Column) -> Column:
    """A, B combined by kind: and, or, xor, exclusion (A without B), complement (neither)."""
    a, b = truth(a), truth(b)
    return {"and": a & b, "or": a | b, "xor": a != b, "exclusion": a & ~b, "complement": ~(a | b)}[kind]


@query("filtered_mean", "P05+P08", ("filtering", "aggregation"), "SELECT round(avg(l_extendedprice), 4) AS mean_price, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def filtered_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a target column over rows whose filter column lies in a closed interval."""
    return table(spark, sf_dir, "lineitem").where(F.col("l_quantity").between(10, 20)).agg(F.round(F.avg("l_extendedprice"), 4).alias("mean_price"), F.count("*").alias("n"))


@query("lookup_value", "P01", ("direct_retrieval",), "SELECT n_nationkey, n_regionkey FROM nation WHERE n_name = 'NATION_3'")
def lookup_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value at a key."""
    return table(spark, sf_dir, "nation").where(F.col("n_name") == "NATION_3").select("n_nationkey", "n_regionkey")


@query("direct_cardinality", "P02", ("counting",), "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def direct_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count of units with one role."""
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").agg(F.count("*").alias("n"))


@query("single_attribute_membership", "P02", ("counting", "filtering"), "SELECT p_type, count(*) AS n FROM part WHERE p_size IN (1, 2, 3, 5, 8, 13) GROUP BY p_type")
def single_attribute_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count of units whose one attribute lies in a set."""
    return table(spark, sf_dir, "part").where(F.col("p_size").isin(1, 2, 3, 5, 8, 13)).groupBy("p_type").agg(F.count("*").alias("n"))


@query(
    "scoped_attribute_count",
    "P02",
    ("counting", "filtering"),
    "SELECT count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 AND c_mktsegment = 'BUILDING'",
)
def scoped_attribute_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named scope first, then units by attribute."""
    scope = table(spark, sf_dir, "nation").where("n_regionkey = 2")
    units = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return units.join(scope, units["c_nationkey"] == scope["n_nationkey"], "left_semi").agg(F.count("*").alias("n"))


@query(
    "relation_attribute_count",
    "P02",
    ("counting", "filtering"),
    "SELECT c_mktsegment, count(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT') GROUP BY c_mktsegment",
)
def relation_attribute_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units selected by a relation to another unit."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(urgent, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query(
    "reference_metric_count",
    "P02",
    ("counting", "comparison"),
    "SELECT count(*) AS n FROM part WHERE p_retailprice > (SELECT p_retailprice FROM part WHERE p_partkey = 7)",
)
def reference_metric_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units whose metric exceeds that of a reference unit: the reference is one row by its key."""
    part = table(spark, sf_dir, "part")
    reference = part.where("p_partkey = 7").agg(F.max("p_retailprice").alias("ref"))
    return part.join(F.broadcast(reference), part["p_retailprice"] > reference["ref"]).agg(F.count("*").alias("n"))


@query(
    "threshold_count",
    "P02+P05",
    ("counting", "filtering"),
    "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n_above, count(*) FILTER (WHERE l_quantity < 10) AS n_below FROM lineitem GROUP BY l_returnflag",
)
def threshold_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict one-sided thresholds, both in one pass."""
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(q > 25).alias("n_above"), F.count_if(q < 10).alias("n_below"))


@query(
    "interval_count",
    "P02+P05",
    ("counting", "filtering"),
    "SELECT l_linestatus, count(*) FILTER (WHERE l_discount BETWEEN 0.03 AND 0.06) AS n_in, count(*) FILTER (WHERE l_quantity BETWEEN 5 AND 15) AS n_qty FROM lineitem GROUP BY l_linestatus",
)
def interval_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed intervals."""
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.count_if(F.col("l_discount").between(0.03, 0.06)).alias("n_in"), F.count_if(F.col("l_quantity").between(5, 15)).alias("n_qty"))


@query("distinct_category_count", "P03", ("counting",), "SELECT p_type, count(DISTINCT p_brand) AS n_brands FROM part GROUP BY p_type")
def distinct_category_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct categories; approx_count_distinct is the form for unbounded ones."""
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count_distinct("p_brand").alias("n_brands"))


_SQL_BOOL = {"and": "a AND b", "or": "a OR b", "xor": "a <> b", "exclusion": "a AND NOT b", "complement": "NOT (a OR b)"}


def _boolean_query(kind: str) -> None:
    @query(
        f"bool_{kind}_count",
        "P04",
        ("counting", "logical_composition"),
        f"WITH t AS (SELECT p_type, coalesce(p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4'), false) AS a, coalesce(p_size > 20, false) AS b FROM part) SELECT p_type, count(*) FILTER (WHERE {_SQL_BOOL[kind]}) AS n FROM t GROUP BY p_type",
    )
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = boolean(kind, F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3", "Brand#4"), F.col("p_size") > 20)
        return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count_if(p).alias("n"))


for _kind in _SQL_BOOL:
    _boolean_query(_kind)


@query(
    "group_predicate_count",
    "P34",
    ("counting", "aggregation"),
    "SELECT count(*) AS n_groups FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 4 AND sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) >= 2)",
)
def group_predicate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose members satisfy a predicate on the group: two-level aggregate."""
    groups = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    return groups.where("n >= 4 AND r >= 2").agg(F.count("*").alias("n_groups"))


@query(
    "counterfactual_count",
    "P26+P02",
    ("counting", "state_update"),
    "SELECT o_orderstatus, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' AND o_totalprice > 300000 THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderpriority <> '5-LOW') GROUP BY o_orderstatus",
)
def counterfactual_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit (removed and relabelled units), then the count in the edited state."""
    edited = table(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'").withColumn("o_orderstatus", F.when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 300000), "F").otherwise(F.col("o_orderstatus")))
    return edited.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(
    "count_arithmetic",
    "P02+P13",
    ("counting", "formula_evaluation"),
    "SELECT event_type, count(*) FILTER (WHERE value > 50) - count(*) FILTER (WHERE value < 5) AS diff, 2 * count(*) FILTER (WHERE user_id < 10) + count(*) FILTER (WHERE user_id >= 140) AS combined FROM events GROUP BY event_type",
)
def count_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic of selector counts, all in one pass."""
    v, u = F.col("value"), F.col("user_id")
    return table(spark, sf_dir, "events").groupBy("event_type").agg((F.count_if(v > 50) - F.count_if(v < 5)).alias("diff"), (F.lit(2).cast("long") * F.count_if(u < 10) + F.count_if(u >= 140)).alias("combined"))
