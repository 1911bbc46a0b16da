"""Programs over several relations: interval overlap, as-of, set algebra, division, semi and anti joins, path joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..joins import asof_join, overlap_counts, overlapping_pairs, present_in_every
from ..registry import query, table

_SESSIONS = "s AS (SELECT user_id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) // 86400 AS day, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY ALL)"


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.unix_timestamp("ts") / 86400).alias("day")
    return table(spark, sf_dir, "events").groupBy("user_id", day).agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))


@query("interval_overlap_count", "P24", ("counting", "spatial_relations"), f"WITH {_SESSIONS} SELECT a.day, count(*) AS pairs FROM s a JOIN s b ON a.day = b.day AND a.user_id < b.user_id AND greatest(a.lo, b.lo) <= least(a.hi, b.hi) GROUP BY a.day")
def interval_overlap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of closed intervals that overlap within a key, counted by running sums."""
    return overlapping_pairs(_sessions(spark, sf_dir), "lo", "hi", ["day"])


@query(
    "max_disjoint_intervals",
    "P24",
    ("ranking", "state_update"),
    f"WITH RECURSIVE {_SESSIONS}, o AS (SELECT user_id, lo, hi, row_number() OVER (PARTITION BY user_id ORDER BY hi, lo) AS i FROM s), r AS (SELECT user_id, i, hi AS last, 1 AS n FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, CASE WHEN o.lo > r.last THEN o.hi ELSE r.last END, CASE WHEN o.lo > r.last THEN r.n + 1 ELSE r.n END FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1) SELECT user_id, CAST(max(n) AS BIGINT) AS n FROM r GROUP BY user_id",
)
def max_disjoint_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most intervals without overlap: earliest end first, as a fold over the sorted array of each key."""
    ordered = _sessions(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("hi", "lo"))).alias("a"))
    start = F.struct(F.lit(-1).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda s, x: F.when(x["lo"] > s["last"], F.struct(x["hi"].alias("last"), (s["n"] + 1).alias("n"))).otherwise(s)
    return ordered.select("user_id", F.aggregate("a", start, step, lambda s: s["n"]).alias("n"))


@query(
    "asof_last_purchase",
    "P12+P18",
    ("direct_retrieval",),
    "SELECT e.event_id, p.event_id AS purchase_id, p.value AS purchase_value FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts",
)
def asof_last_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase at or before each error."""
    e = table(spark, sf_dir, "events")
    errors = e.where("event_type = 'error'").select("user_id", "ts", "event_id")
    buys = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"), F.col("event_id").alias("id"), F.col("value").alias("val"))
    return asof_join(errors, buys, ["user_id"], "ts", "bought", ["id", "val"]).select("event_id", F.col("asof_id").alias("purchase_id"), F.col("asof_val").alias("purchase_value")).where("purchase_id IS NOT NULL")


@query(
    "interval_hits",
    "P24",
    ("spatial_relations", "matching"),
    f"WITH {_SESSIONS}, p AS (SELECT event_id AS a, event_id + 3 AS b FROM events WHERE event_type = 'error') SELECT a AS event_id, count(*) AS n FROM p JOIN s ON greatest(a, lo) <= least(b, hi) GROUP BY a",
)
def interval_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sessions overlap a short interval around each error: starts up to its end, less ends before its start."""
    p = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", F.col("event_id").alias("a"), (F.col("event_id") + 3).alias("b"))
    return overlap_counts(p, _sessions(spark, sf_dir), "event_id", ("a", "b"), ("lo", "hi"), 4096).where("n > 0")


@query("set_intersect", "set", ("matching",), "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return a.intersect(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")))


@query("set_except", "set", ("matching",), "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return a.exceptAll(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct())


@query("set_union", "set", ("matching",), "SELECT p_partkey FROM part WHERE p_size = 1 UNION SELECT l_partkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").where("p_size = 1").select("p_partkey")
    return a.union(table(spark, sf_dir, "lineitem").where("l_quantity = 50 AND l_discount = 0.1").select("l_partkey")).distinct()


@query("subset_check", "set", ("matching",), "SELECT user_id, count(DISTINCT event_type) FILTER (WHERE event_type IN ('click', 'view', 'error')) = 3 AS holds FROM events WHERE value > 100 GROUP BY user_id")
def subset_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a wanted set contained in what each group has."""
    wanted = F.array(*[F.lit(x) for x in ("click", "view", "error")])
    return table(spark, sf_dir, "events").where("value > 100").groupBy("user_id").agg((F.size(F.array_except(wanted, F.collect_set("event_type"))) == 0).alias("holds"))


@query("venn_regions", "set+P04", ("counting", "logical_composition"), "WITH m AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS f, bool_or(o_orderpriority = '1-URGENT') AS u, bool_or(o_totalprice > 400000) AS x FROM orders GROUP BY o_custkey) SELECT f, u, x, count(*) AS n FROM m GROUP BY ALL")
def venn_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every region of a three-set Venn diagram."""
    m = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("f"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("u"), F.bool_or(F.col("o_totalprice") > 400000).alias("x"))
    return m.groupBy("f", "u", "x").agg(F.count("*").alias("n"))


@query("present_in_every_panel", "P34", ("filtering", "aggregation"), "SELECT p_brand FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) = (SELECT count(DISTINCT p_type) FROM part)")
def present_in_every_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relational division."""
    return present_in_every(table(spark, sf_dir, "part"), "p_brand", "p_type")


@query(
    "two_hop_flow",
    "P07+P20",
    ("aggregation", "topology"),
    "WITH a AS (SELECT c_nationkey AS src, o_orderkey, o_totalprice AS first FROM orders JOIN customer ON o_custkey = c_custkey), b AS (SELECT l_orderkey, s_nationkey AS dst, sum(l_extendedprice) AS second FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) SELECT src, dst, round(sum(least(first, second)), 2) AS flow, count(*) AS routes FROM a JOIN b ON o_orderkey = l_orderkey GROUP BY ALL HAVING count(*) >= 2",
)
def two_hop_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow source to middle to target, each route as wide as its narrower half, for pairs with two routes or more."""
    a = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("src"), "o_orderkey", F.col("o_totalprice").alias("first"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    b = lines.groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("s_nationkey").alias("dst")).agg(F.sum("l_extendedprice").alias("second"))
    flow = a.join(b, "o_orderkey").groupBy("src", "dst").agg(F.round(F.sum(F.least("first", "second")), 2).alias("flow"), F.count("*").alias("routes"))
    return flow.where("routes >= 2")


@query(
    "lookup_chain",
    "P09+P01",
    ("ranking", "direct_retrieval"),
    "WITH k AS (SELECT c_mktsegment, arg_max(c_custkey, (c_acctbal, c_custkey)) AS c_custkey FROM customer GROUP BY c_mktsegment) SELECT c_mktsegment, count(o_orderkey) AS n_orders FROM k LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment",
)
def lookup_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extreme in one panel selects the key that is read in another."""
    k = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("c_custkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return k.join(orders, "c_custkey", "left").groupBy("c_mktsegment").agg(F.count("o_orderkey").alias("n_orders"))


@query(
    "full_outer_counts",
    "P06",
    ("comparison", "counting"),
    "WITH a AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_discount = 0.1 GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_tax = 0 GROUP BY 1) SELECT count(*) FILTER (WHERE a.n IS NULL) AS only_b, count(*) FILTER (WHERE b.n IS NULL) AS only_a, count(*) FILTER (WHERE a.n = b.n) AS equal FROM a FULL JOIN b ON a.k = b.k",
)
def full_outer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested against observed counts: full outer join of two aggregates."""
    lines = table(spark, sf_dir, "lineitem")
    a = lines.where("l_discount = 0.1").groupBy("l_partkey").agg(F.count("*").alias("na"))
    b = lines.where("l_tax = 0").groupBy("l_partkey").agg(F.count("*").alias("nb"))
    return a.join(b, "l_partkey", "full").agg(F.count_if(F.col("na").isNull()).alias("only_b"), F.count_if(F.col("nb").isNull()).alias("only_a"), F.count_if(F.col("na") == F.col("nb")).alias("equal"))
