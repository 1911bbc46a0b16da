"""Spatial programs: inside, crossings, areas, distances, transforms of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import rotate_left, shoelace
from ..registry import query, table


@query("point_in_box_count", "P31", ("counting", "spatial_relations"), "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 10 AND l_quantity < 20 AND l_extendedprice > 20000 AND l_extendedprice < 40000) AS n FROM lineitem GROUP BY l_returnflag")
def point_in_box_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points strictly inside a box."""
    inside = F.expr("l_quantity > 10 AND l_quantity < 20 AND l_extendedprice > 20000 AND l_extendedprice < 40000")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(inside).alias("n"))


@query("point_in_circle_count", "P31", ("counting", "spatial_relations"), "SELECT l_linestatus, count(*) AS n FROM lineitem WHERE (l_quantity - 25) * (l_quantity - 25) + (l_tax * 100 - 4) * (l_tax * 100 - 4) < 64 - 1e-7 GROUP BY l_linestatus")
def point_in_circle_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strictly inside: what lies on the edge, within tolerance, is outside."""
    dx, dy = F.col("l_quantity") - 25, F.col("l_tax") * 100 - 4
    return table(spark, sf_dir, "lineitem").where(dx * dx + dy * dy < 64 - 1e-7).groupBy("l_linestatus").agg(F.count("*").alias("n"))


#: A polygon that is not convex.
POLYGON = ((5.0, 1.5), (45.0, 0.5), (40.0, 7.5), (25.0, 3.25), (10.0, 8.5))


def _edges() -> list[tuple[float, float, float, float]]:
    return [(*a, *b) for a, b in zip(POLYGON, POLYGON[1:] + POLYGON[:1], strict=True)]


_CROSS_SQL = " + ".join(f"CASE WHEN ({y0} > y) <> ({y1} > y) AND x < ({x1} - {x0}) * (y - {y0}) / ({y1} - {y0}) + {x0} THEN 1 ELSE 0 END" for x0, y0, x1, y1 in _edges())


@query("point_in_polygon_count", "P31", ("counting", "spatial_relations"), f"SELECT l_returnflag, count(*) FILTER (WHERE ({_CROSS_SQL}) % 2 = 1) AS n FROM (SELECT l_returnflag, l_quantity + 0.01 AS x, l_tax * 100 + 0.013 AS y FROM lineitem) GROUP BY l_returnflag")
def point_in_polygon_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parity of the edges that a ray crosses, as one expression per point: no join with the edges."""
    x, y = F.col("l_quantity") + 0.01, F.col("l_tax") * 100 + 0.013
    crossed = F.lit(0)
    for x0, y0, x1, y1 in _edges():
        crossed = crossed + F.when(((F.lit(y0) > y) != (F.lit(y1) > y)) & (x < (y - y0) * (x1 - x0) / (y1 - y0) + x0), 1).otherwise(0)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_if(crossed % 2 == 1).alias("n"))


@query(
    "crossings_count",
    "P35",
    ("counting", "spatial_relations"),
    "WITH t AS (SELECT p_brand AS g, p_partkey AS id, p_size AS a, p_partkey * 7 % 50 AS b FROM part) SELECT x.g, count(*) AS crossings FROM t x JOIN t y ON x.g = y.g AND x.id < y.id AND sign(x.a - y.a) * sign(x.b - y.b) < 0 GROUP BY x.g",
)
def crossings_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossing polylines between two axes: pairs whose orders differ. Counted per value pair with cumulative sums, so pairs are never formed."""
    t = table(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), F.col("p_size").cast("long").alias("a"), F.pmod(F.col("p_partkey") * 7, F.lit(50)).alias("b"))
    cells = t.groupBy("g", "a", "b").agg(F.count("*").alias("n"))
    # For each value of b: how many stand at smaller a; 50 values bound the grid.
    grid = cells.select("g", "a", "n", "b")
    below = grid.select("g", F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("n").alias("n2"))
    return grid.join(below, "g").where("a < a2 AND b > b2").groupBy("g").agg(F.sum(F.col("n") * F.col("n2")).alias("crossings"))


@query(
    "polygon_area",
    "P31+P27",
    ("formula_evaluation", "spatial_relations"),
    "WITH v AS (SELECT user_id, row_number() OVER w AS i, value AS y, CAST(event_id % 100 AS DOUBLE) AS x, lead(value) OVER w AS ny, CAST(lead(event_id) OVER w % 100 AS DOUBLE) AS nx, first_value(value) OVER w AS fy, CAST(first_value(event_id) OVER w % 100 AS DOUBLE) AS fx FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, round(abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) / 2, 3) AS area FROM v GROUP BY user_id",
)
def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shoelace area of each closed polygon, as a fold over its ordered corners."""
    corners = F.array_sort(F.collect_list(F.struct("event_id", "value")))
    p = table(spark, sf_dir, "events").groupBy("user_id").agg(corners.alias("c"))
    xs, ys = F.transform("c", lambda v: F.pmod(v["event_id"], F.lit(100)).cast("double")), F.transform("c", lambda v: v["value"])
    return p.withColumns({"xs": xs, "ys": ys}).select("user_id", F.round(shoelace(F.col("xs"), F.col("ys")), 3).alias("area"))


@query(
    "nearest_neighbour",
    "P12+P31",
    ("ranking", "spatial_relations"),
    "SELECT n_name, arg_min(s_name, (sqrt(power(s_suppkey % 10 - n_nationkey % 5, 2) + power(s_acctbal / 1000 - n_nationkey / 3.0, 2)), s_suppkey)) AS nearest FROM nation CROSS JOIN supplier GROUP BY n_name",
)
def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest unit of a large set to each of 25 references: the references are few by the schema and are broadcast, the large side is read once."""
    n = table(spark, sf_dir, "nation").select("n_name", "n_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_name", "s_suppkey", "s_acctbal")
    d = F.hypot(F.pmod("s_suppkey", F.lit(10)) - F.pmod("n_nationkey", F.lit(5)), F.col("s_acctbal") / 1000 - F.col("n_nationkey") / 3.0)
    return s.join(F.broadcast(n)).groupBy("n_name").agg(F.min_by("s_name", F.struct(d, "s_suppkey")).alias("nearest"))


_FLAGS = "a AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_returnflag) AS f FROM lineitem GROUP BY l_orderkey)"


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(rows, lambda r: r["l_returnflag"]).alias("f"))


@query("rotate_sequence", "P32", ("transformation",), f"WITH {_FLAGS} SELECT l_orderkey, array_to_string(list_concat(f[1 + 2 % len(f):], f[:2 % len(f)]), '') AS rotated, array_to_string(list_reverse(f), '') AS mirrored FROM a")
def rotate_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sequence rotated left by two, and mirrored."""
    return _flags(spark, sf_dir).select("l_orderkey", F.concat_ws("", rotate_left(F.col("f"), 2)).alias("rotated"), F.concat_ws("", F.reverse("f")).alias("mirrored"))


@query("canonical_rotation", "P32+P28", ("transformation", "matching"), f"WITH {_FLAGS}, r AS (SELECT l_orderkey, array_to_string(f, '') AS s, unnest(range(len(f))) AS k FROM a) SELECT min_s AS canonical, count(*) AS n FROM (SELECT l_orderkey, min(substr(s, k + 1) || substr(s, 1, k)) AS min_s FROM r GROUP BY l_orderkey) GROUP BY min_s")
def canonical_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences that are rotations of each other share a canonical form: the least of all rotations."""
    every = F.transform(F.sequence(F.lit(0), F.size("f") - 1), lambda k: F.concat_ws("", F.concat(F.slice("f", k + 1, F.size("f")), F.slice("f", F.lit(1), k))))
    return _flags(spark, sf_dir).select(F.array_min(every).alias("canonical")).groupBy("canonical").agg(F.count("*").alias("n"))


@query("overlay_union", "P32", ("transformation",), "SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(coalesce(list(o_orderpriority) FILTER (WHERE o_orderstatus = 'F'), []), coalesce(list(o_orderpriority) FILTER (WHERE o_orderstatus = 'P'), [])))), ',') AS cells FROM orders GROUP BY o_custkey")
def overlay_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of two sheets' cells."""
    sheet = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.concat_ws(",", F.array_sort(F.array_union(sheet("F"), sheet("P")))).alias("cells"))


@query("symbol_decode", "P36", ("direct_retrieval", "matching"), "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'a' WHEN '2-HIGH' THEN 'b' WHEN '3-MEDIUM' THEN 'c' WHEN '4-NOT SPECIFIED' THEN 'd' ELSE '?' END AS symbol, count(*) AS n FROM orders GROUP BY 1")
def symbol_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols read by a code table; what it doesn't hold is '?'."""
    code = F.create_map(*[F.lit(x) for kv in (("1-URGENT", "a"), ("2-HIGH", "b"), ("3-MEDIUM", "c"), ("4-NOT SPECIFIED", "d")) for x in kv])
    return table(spark, sf_dir, "orders").groupBy(F.coalesce(F.try_element_at(code, F.col("o_orderpriority")), F.lit("?")).alias("symbol")).agg(F.count("*").alias("n"))


@query(
    "clock_readout",
    "P36+P27",
    ("formula_evaluation",),
    "WITH m AS (SELECT event_id, CAST(hour(ts) * 60 + minute(ts) AS BIGINT) AS t FROM events) SELECT event_id, printf('%02d:%02d', (t + 95) % 1440 // 60, (t + 95) % 60) AS later, least(abs(t % 720 * 0.5 - t % 60 * 6.0), 360 - abs(t % 720 * 0.5 - t % 60 * 6.0))::DOUBLE AS angle FROM m",
)
def clock_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock arithmetic: a time 95 minutes later, and the smaller angle between the hands."""
    from ..functions.scalar import clock_add, clock_text, hand_angle

    t = (F.hour("ts") * 60 + F.minute("ts")).cast("long")
    m = table(spark, sf_dir, "events").select("event_id", t.alias("t"))
    return m.select("event_id", clock_text(clock_add(F.col("t"), F.lit(95))).alias("later"), hand_angle(F.col("t")).cast("double").alias("angle"))


@query(
    "candidate_values",
    "P39",
    ("filtering", "logical_composition"),
    "WITH p AS (SELECT DISTINCT o_orderpriority FROM orders), c AS (SELECT c_custkey FROM customer) SELECT c_custkey, coalesce(string_agg(p.o_orderpriority, ',' ORDER BY p.o_orderpriority) FILTER (WHERE o.o_custkey IS NULL), '') AS candidates FROM c CROSS JOIN p LEFT JOIN (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) o ON o.o_custkey = c_custkey AND o.o_orderpriority = p.o_orderpriority GROUP BY c_custkey",
)
def candidate_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the domain still allows: all values without those of the peers."""
    domain = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    used = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderpriority").alias("used"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(used, "c_custkey", "left")
    return c.select("c_custkey", F.concat_ws(",", F.array_except(domain, F.coalesce("used", F.array().cast("array<string>")))).alias("candidates"))


@query(
    "fold_state_update",
    "P25",
    ("state_update",),
    "WITH RECURSIVE e AS (SELECT user_id, CAST(event_id AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), r AS (SELECT user_id, i, (v * 7 + 3) % 1009 AS s FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, CASE WHEN e.v % 5 = 0 THEN (r.s + e.v) % 1009 ELSE (r.s * 31 + e.v * 7 + 3) % 1009 END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) SELECT user_id, CAST(arg_max(s, i) AS BIGINT) AS state FROM r GROUP BY user_id",
)
def fold_state_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state machine folded over each key's ordered events."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("a"))
    step = lambda s, x: F.when(x["event_id"] % 5 == 0, F.when(s < 0, x["event_id"] * 7 + 3).otherwise(s + x["event_id"]) % 1009).otherwise((F.when(s < 0, 0).otherwise(s) * 31 + x["event_id"] * 7 + 3) % 1009)
    return e.select("user_id", F.aggregate("a", F.lit(-1).cast("long"), step).alias("state"))


@query(
    "legal_targets",
    "P37",
    ("filtering", "topology"),
    "WITH c AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_quantity > 5), b AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 20) SELECT p, CAST(min(s) AS BIGINT) AS first_target, count(*) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.p = c.p AND b.s <= c.s) GROUP BY p",
)
def legal_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets along a ray before the first blocker: the smallest blocking step, then a filter."""
    lines = table(spark, sf_dir, "lineitem")
    c = lines.where("l_quantity > 5").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).distinct()
    b = lines.where("l_returnflag = 'R' AND l_quantity > 20").groupBy(F.col("l_partkey").alias("p")).agg(F.min("l_suppkey").alias("stop"))
    return c.join(b, "p", "left").where("stop IS NULL OR s < stop").groupBy("p").agg(F.min("s").alias("first_target"), F.count("*").alias("n"))
