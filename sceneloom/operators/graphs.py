"""Graph and tree programs: degrees, reachability, path lengths, components, and grouped kernels for what Catalyst can't express."""

from __future__ import annotations

from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..registry import query, table
from ..session import checkpointed

#: Bound of the oracles' recursion: the graphs below have 25 nodes.
DEPTH = 25
_EDGES = "e AS (SELECT n_nationkey AS src, (n_nationkey * 2 + 1) % 25 AS dst FROM nation WHERE n_nationkey % 4 <> 3 UNION SELECT n_nationkey, (n_nationkey + 7) % 25 FROM nation WHERE n_regionkey = 2)"


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directed graph over the nations."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    a = n.where(key % 4 != 3).select(key.alias("src"), ((key * 2 + 1) % 25).alias("dst"))
    return a.union(n.where("n_regionkey = 2").select(key.alias("src"), ((key + 7) % 25).alias("dst"))).distinct()


@query(
    "degree_filter_count",
    "P19+P02",
    ("counting", "topology"),
    "WITH d AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS degree FROM lineitem WHERE l_quantity > 45 GROUP BY l_suppkey) SELECT degree, count(*) AS n FROM d GROUP BY degree",
)
def degree_filter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees in a bipartite graph, and how many nodes have each."""
    d = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("degree"))
    return d.groupBy("degree").agg(F.count("*").alias("n"))


@query(
    "common_neighbour_count",
    "P19",
    ("topology", "counting"),
    "WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) SELECT a.s AS s1, b.s AS s2, count(*) AS n FROM e a JOIN e b ON a.p = b.p AND a.s < b.s GROUP BY ALL",
)
def common_neighbour_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours that two nodes share: self-join on the neighbour."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s1"), F.col("l_partkey").alias("p")).distinct()
    return e.join(e.withColumnRenamed("s1", "s2"), "p").where("s1 < s2").groupBy("s1", "s2").agg(F.count("*").alias("n"))


def reach(edges: DataFrame, start: int) -> DataFrame:
    """node, depth: smallest number of steps from start to every node that can be reached.

    Each step joins the last step's nodes with the edges and takes off all nodes seen before; it ends when no new node is
    found, so a node costs one expansion, and cycles none.
    """
    edges = edges.select(F.col("src").cast("long").alias("node"), F.col("dst").cast("long").alias("dst")).distinct()
    last = seen = edges.sparkSession.range(start, start + 1).select(F.col("id").alias("node"), F.lit(0).alias("depth"))
    for step in count(1):
        new = last.join(edges, "node").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        last = checkpointed(new.select("node", F.lit(step).alias("depth")))
        if last.isEmpty():
            return seen
        seen = seen.union(last)


_REACH = f"r(node, depth) AS (SELECT 1, 0 UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < {DEPTH})"


@query("reachable_set", "P20", ("topology",), f"WITH RECURSIVE {_EDGES}, {_REACH} SELECT DISTINCT CAST(node AS INTEGER) AS node FROM r")
def reachable_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach(nation_edges(spark, sf_dir), 1).select(F.col("node").cast("int").alias("node"))


@query("shortest_path_length", "P21", ("topology", "formula_evaluation"), f"WITH RECURSIVE {_EDGES}, {_REACH} SELECT CAST(node AS INTEGER) AS node, CAST(min(depth) AS INTEGER) AS steps FROM r GROUP BY node")
def shortest_path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach(nation_edges(spark, sf_dir), 1).select(F.col("node").cast("int").alias("node"), F.col("depth").cast("int").alias("steps"))


@query("distance_filter_count", "P21+P02", ("topology", "counting"), f"WITH RECURSIVE {_EDGES}, {_REACH} SELECT steps, count(*) AS n FROM (SELECT node, CAST(min(depth) AS INTEGER) AS steps FROM r GROUP BY node) GROUP BY steps")
def distance_filter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes lie at each exact distance."""
    return reach(nation_edges(spark, sf_dir), 1).groupBy(F.col("depth").cast("int").alias("steps")).agg(F.count("*").alias("n"))


@query("reachable_after_edit", "P20+P26", ("topology", "state_update"), f"WITH RECURSIVE {_EDGES.replace('e AS', 'e0 AS')}, e AS (SELECT src, dst FROM e0 WHERE NOT (src = 1 AND dst = 3) UNION SELECT 1, 20), {_REACH} SELECT count(DISTINCT node) AS n FROM r")
def reachable_after_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge taken away, one put in, then the reachable set."""
    edited = nation_edges(spark, sf_dir).where("NOT (src = 1 AND dst = 3)").union(spark.sql("SELECT 1, 20"))
    return reach(edited, 1).agg(F.count("*").alias("n"))


@query(
    "join_path_length",
    "P21",
    ("topology",),
    "WITH RECURSIVE f(a, b) AS (VALUES ('lineitem','orders'),('orders','customer'),('customer','nation'),('nation','region'),('lineitem','supplier'),('supplier','nation'),('lineitem','part')), u AS (SELECT a, b FROM f UNION SELECT b, a FROM f), r(node, d) AS (SELECT 'part', 0 UNION SELECT u.b, d + 1 FROM r JOIN u ON u.a = r.node WHERE d < 6) SELECT node, CAST(min(d) AS INTEGER) AS joins FROM r GROUP BY node",
)
def join_path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joins between two tables of a schema, in a graph of its foreign keys."""
    return spark.sql("WITH RECURSIVE f(a, b) AS (VALUES ('lineitem','orders'),('orders','customer'),('customer','nation'),('nation','region'),('lineitem','supplier'),('supplier','nation'),('lineitem','part')), u AS (SELECT a, b FROM f UNION SELECT b, a FROM f), r(node, d) AS (SELECT 'part', 0 UNION ALL SELECT DISTINCT u.b, d + 1 FROM r JOIN u ON u.a = r.node WHERE d < 6) SELECT node, CAST(min(d) AS INTEGER) AS joins FROM r GROUP BY node")


@query(
    "tree_lca",
    "P23",
    ("topology",),
    "WITH RECURSIVE p AS (SELECT o_orderkey AS k, 1 + o_orderkey % 1000 AS a0, 1 + o_custkey % 1000 AS b0 FROM orders), r AS (SELECT k, a0 AS a, b0 AS b FROM p UNION ALL SELECT k, CASE WHEN a > b THEN a // 2 ELSE a END, CASE WHEN b >= a THEN b // 2 ELSE b END FROM r WHERE a <> b) SELECT k, CAST(a AS BIGINT) AS lca FROM r WHERE a = b",
)
def tree_lca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest common ancestor in a binary tree: the longest common prefix of the two root paths."""
    a, b = F.bin(1 + F.pmod("o_orderkey", F.lit(1000))), F.bin(1 + F.pmod("o_custkey", F.lit(1000)))
    same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.length("a"), F.length("b"))), lambda i: F.col("a").substr(F.lit(1), i) == F.col("b").substr(F.lit(1), i)))
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), a.alias("a"), b.alias("b"))
    return p.select("k", F.conv(F.col("a").substr(F.lit(1), same), 2, 10).cast("long").alias("lca"))


@query(
    "tree_subtree_totals",
    "P23+P07",
    ("aggregation", "topology"),
    "WITH RECURSIVE n AS (SELECT 1 + c_custkey % 127 AS node, sum(c_acctbal) AS v FROM customer GROUP BY 1), r AS (SELECT node, node AS anc, v FROM n UNION ALL SELECT node, anc // 2, v FROM r WHERE anc > 1) SELECT CAST(anc AS BIGINT) AS node, round(sum(v), 2) AS total, count(*) AS n FROM r GROUP BY anc",
)
def tree_subtree_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of every subtree: each node is exploded to its ancestors, which its path names."""
    node = F.bin(1 + F.pmod("c_custkey", F.lit(127)))
    n = table(spark, sf_dir, "customer").groupBy(node.alias("path")).agg(F.sum("c_acctbal").alias("v"))
    up = n.select("v", F.explode(F.transform(F.sequence(F.lit(1), F.length("path")), lambda i: F.conv(F.col("path").substr(F.lit(1), i), 2, 10).cast("long"))).alias("node"))
    return up.groupBy("node").agg(F.round(F.sum("v"), 2).alias("total"), F.count("*").alias("n"))


def per_graph(edges: DataFrame, key: str, kernel, schema: str) -> DataFrame:
    """A kernel over the edge list of every small graph (one group each); the graphs are many and small."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = kernel(pdf)
        out.insert(0, key, pdf[key].iloc[0])
        return out

    return edges.groupBy(key).applyInPandas(run, f"{key} bigint, {schema}")


def trade_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted graph for each customer nation: regions of supply joined through orders, as src, dst, weight."""
    lines = table(spark, sf_dir, "lineitem")
    e = lines.select(F.pmod("l_orderkey", F.lit(40)).alias("graph"), F.pmod("l_suppkey", F.lit(12)).cast("int").alias("src"), F.pmod("l_partkey", F.lit(12)).cast("int").alias("dst"), F.col("l_quantity").cast("long").alias("weight"))
    return e.where("src <> dst").groupBy("graph", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("weight").alias("weight")).where("weight < 20")


@query("mst_weight", "P22", ("topology", "formula_evaluation"))
def mst_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and edges of a minimum spanning forest of each graph."""
    return per_graph(trade_graphs(spark, sf_dir), "graph", lambda p: pd.DataFrame([kernels.spanning_forest(p[["src", "dst", "weight"]].values.tolist())], columns=["weight", "edges"]), "weight bigint, edges bigint")


@query("cut_structure_count", "P22", ("topology", "counting"))
def cut_structure_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridges and articulation points of each graph."""
    return per_graph(trade_graphs(spark, sf_dir).where("weight < 9"), "graph", lambda p: pd.DataFrame([kernels.cut_counts(p[["src", "dst"]].values.tolist())], columns=["bridges", "articulations"]), "bridges bigint, articulations bigint")


@query("max_flow_value", "P22", ("topology", "formula_evaluation"))
def max_flow_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest flow from node 0 to node 11, edges directed from the smaller to the larger node."""
    return per_graph(trade_graphs(spark, sf_dir), "graph", lambda p: pd.DataFrame([[kernels.max_flow(p[["src", "dst", "weight"]].values.tolist(), 0, 11)]], columns=["flow"]), "flow bigint")


@query("strong_components", "P22", ("topology", "counting"))
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected components of a directed graph and whether its topological order is unique."""
    e = table(spark, sf_dir, "lineitem").select(F.pmod("l_orderkey", F.lit(40)).alias("graph"), F.pmod("l_suppkey", F.lit(9)).cast("int").alias("src"), F.pmod("l_partkey", F.lit(9)).cast("int").alias("dst")).where("src <> dst").distinct()
    one = e.where("src + 2 * dst < 14")
    return per_graph(one, "graph", lambda p: pd.DataFrame([[kernels.strong_component_count(p[["src", "dst"]].values.tolist()), kernels.unique_topological_order(p[["src", "dst"]].values.tolist()) is not None]], columns=["components", "ordered"]), "components bigint, ordered boolean")


@query("weighted_path_cost", "P21", ("topology", "formula_evaluation"))
def weighted_path_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest path costs from node 0, and how many cheapest paths there are."""
    return per_graph(trade_graphs(spark, sf_dir), "graph", lambda p: pd.DataFrame(kernels.cheapest_paths(p[["src", "dst", "weight"]].values.tolist(), 0), columns=["node", "cost", "paths"]), "node bigint, cost bigint, paths bigint")


@query("component_count", "P20", ("topology", "counting"))
def component_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of each graph and the size of the largest."""
    return per_graph(trade_graphs(spark, sf_dir).where("weight < 5"), "graph", lambda p: pd.DataFrame([kernels.component_sizes(p[["src", "dst"]].values.tolist())], columns=["components", "largest"]), "components bigint, largest bigint")
