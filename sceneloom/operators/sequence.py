"""Sequence programs over ordered units: running totals, streaks, crossings, neighbours, turning points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, table


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count("*").alias("n"))


_DAILY = "d AS (SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, count(*) AS n FROM orders GROUP BY ALL)"
def _w():
    return Window.partitionBy("o_orderpriority").orderBy("y", "m")


@query("running_total", "P16", ("aggregation", "state_update"), f"WITH {_DAILY} SELECT o_orderpriority, y, m, CAST(sum(n) OVER (PARTITION BY o_orderpriority ORDER BY y, m ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM d")
def running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of monthly counts: the window sees the aggregate, not the rows."""
    return _daily(spark, sf_dir).select("o_orderpriority", "y", "m", F.sum("n").over(_w().rowsBetween(Window.unboundedPreceding, 0)).alias("total"))


@query(
    "cumulative_rank_bin",
    "P16",
    ("ranking", "aggregation"),
    "WITH b AS (SELECT p_type, p_size, count(*) AS n FROM part GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY p_type ORDER BY p_size) AS cum, sum(n) OVER (PARTITION BY p_type) AS total FROM b) SELECT p_type, min(p_size) AS bin FROM c WHERE 2 * cum >= total GROUP BY p_type",
)
def cumulative_rank_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram bin in which the middle rank falls."""
    b = table(spark, sf_dir, "part").groupBy("p_type", "p_size").agg(F.count("*").alias("n"))
    w = Window.partitionBy("p_type")
    c = b.withColumn("cum", F.sum("n").over(w.orderBy("p_size"))).withColumn("total", F.sum("n").over(w))
    return c.where("2 * cum >= total").groupBy("p_type").agg(F.min("p_size").alias("bin"))


@query(
    "monotone_streak",
    "P17",
    ("topology", "counting"),
    f"WITH {_DAILY}, f AS (SELECT *, CASE WHEN n > lag(n) OVER w THEN 0 ELSE 1 END AS brk FROM d WINDOW w AS (PARTITION BY o_orderpriority ORDER BY y, m)), g AS (SELECT *, sum(brk) OVER (PARTITION BY o_orderpriority ORDER BY y, m ROWS UNBOUNDED PRECEDING) AS run FROM f) SELECT o_orderpriority, max(len) AS streak FROM (SELECT o_orderpriority, run, count(*) AS len FROM g GROUP BY ALL) GROUP BY o_orderpriority",
)
def monotone_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest strictly rising run: breaks, their running count, and group sizes."""
    f = _daily(spark, sf_dir).withColumn("brk", F.when(F.col("n") > F.lag("n").over(_w()), 0).otherwise(1))
    g = f.withColumn("run", F.sum("brk").over(_w().rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("o_orderpriority", "run").agg(F.count("*").alias("len")).groupBy("o_orderpriority").agg(F.max("len").alias("streak"))


@query(
    "turning_point_count",
    "P17",
    ("counting",),
    f"WITH {_DAILY}, f AS (SELECT o_orderpriority, n, lag(n) OVER w AS p, lead(n) OVER w AS q FROM d WINDOW w AS (PARTITION BY o_orderpriority ORDER BY y, m)) SELECT o_orderpriority, count(*) FILTER (WHERE (n > p AND n > q) OR (n < p AND n < q)) AS turns FROM f GROUP BY o_orderpriority",
)
def turning_point_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _daily(spark, sf_dir).select("o_orderpriority", "n", F.lag("n").over(_w()).alias("p"), F.lead("n").over(_w()).alias("q"))
    return f.groupBy("o_orderpriority").agg(F.count_if(F.expr("(n > p AND n > q) OR (n < p AND n < q)")).alias("turns"))


@query(
    "condition_run_extremum",
    "P17+P09",
    ("ranking", "counting"),
    "WITH f AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS brk FROM events), g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f), r AS (SELECT user_id, run, count(*) FILTER (WHERE event_type = 'click') AS len FROM g GROUP BY ALL) SELECT user_id, max(len) AS longest FROM r GROUP BY user_id",
)
def condition_run_extremum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of units that satisfy a condition, by row."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.col("event_type") == "click"
    g = table(spark, sf_dir, "events").select("user_id", hit.alias("hit"), F.sum(F.when(hit, 0).otherwise(1)).over(w).alias("run"))
    return g.groupBy("user_id", "run").agg(F.count_if("hit").alias("len")).groupBy("user_id").agg(F.max("len").alias("longest"))


@query(
    "first_crossing",
    "P18",
    ("filtering", "ranking"),
    "WITH f AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, min(event_id) AS first_up, count(*) AS crossings FROM f WHERE p <= 60 AND value > 60 GROUP BY user_id",
)
def first_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First upward crossing of a threshold between neighbours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    f = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.lag("value").over(w).alias("p"))
    return f.where("p <= 60 AND value > 60").groupBy("user_id").agg(F.min("event_id").alias("first_up"), F.count("*").alias("crossings"))


@query(
    "ordered_adjacent_pairs",
    "P19",
    ("counting", "topology"),
    "WITH f AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT a, b, count(*) AS n FROM f WHERE b IS NOT NULL GROUP BY a, b",
)
def ordered_adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered pairs of neighbours by their attributes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b")).where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))


@query(
    "adjacency_relation_label",
    "P19",
    ("topology", "direct_retrieval"),
    "WITH f AS (SELECT user_id, event_type, event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, before, after FROM f WHERE event_type = 'signup' AND before IS NOT NULL AND after IS NOT NULL",
)
def adjacency_relation_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predecessor and successor of the selected units."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    f = table(spark, sf_dir, "events").select("event_type", "event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id").over(w).alias("after"))
    return f.where("event_type = 'signup' AND before IS NOT NULL AND after IS NOT NULL").select("event_id", "before", "after")


@query(
    "linear_interpolation",
    "P40",
    ("formula_evaluation",),
    "WITH p AS (SELECT user_id, event_id AS x, value AS y, lag(event_id) OVER w AS px, lag(value) OVER w AS py FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), b AS (SELECT user_id, arg_min(value, event_id) AS y0, arg_max(value, event_id) AS y1, min(event_id) AS x0, max(event_id) AS x1 FROM events GROUP BY user_id) SELECT b.user_id, round(CASE WHEN 5000 <= x0 THEN y0 WHEN 5000 >= x1 THEN y1 ELSE max(py + (y - py) * (5000 - px) / (x - px)) END, 4) AS y FROM b LEFT JOIN p ON p.user_id = b.user_id AND px < 5000 AND 5000 <= x GROUP BY b.user_id, x0, x1, y0, y1",
)
def linear_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value of a sampled curve at a place, with the ends held beyond the samples."""
    at = 5000
    w = Window.partitionBy("user_id").orderBy("event_id")
    p = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("x"), F.col("value").alias("y"), F.lag("event_id").over(w).alias("px"), F.lag("value").over(w).alias("py"))
    inside = F.when((F.col("px") < at) & (F.col("x") >= at), F.col("py") + (F.col("y") - F.col("py")) * (F.lit(at) - F.col("px")) / (F.col("x") - F.col("px")))
    ends = F.when(F.min("x") >= at, F.min_by("y", "x")).when(F.max("x") <= at, F.max_by("y", "x")).otherwise(F.max(inside))
    return p.groupBy("user_id").agg(F.round(ends, 4).alias("y"))
