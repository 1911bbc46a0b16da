"""Rules of games, circuits and simple physics as Column programs: each scene is a row or a small group of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query, table


def whole_where(condition: Column, value: Column) -> Column:
    """value where the condition says that it is a whole number, else null."""
    return F.when(condition, value)


@query(
    "circuit_equivalent",
    "P27",
    ("formula_evaluation",),
    "SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS in_series, round(1 / sum(1 / l_quantity), 6) AS in_parallel FROM lineitem GROUP BY l_orderkey",
)
def circuit_equivalent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resistors of each circuit in series and in parallel; capacitors follow the same two formulas the other way round."""
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(q.cast("long")).alias("in_series"), F.round(1 / F.sum(1 / q), 6).alias("in_parallel"))


@query(
    "temperature_convert",
    "P27",
    ("formula_evaluation",),
    "SELECT p_size, count(*) AS n, CASE WHEN p_size % 5 = 0 THEN p_size * 9 // 5 + 32 END AS fahrenheit, CASE WHEN (p_size - 32) % 9 = 0 THEN (p_size - 32) * 5 // 9 END AS celsius FROM part GROUP BY p_size",
)
def temperature_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings converted both ways where the result is a whole number; otherwise null."""
    p = F.col("p_size")
    up = whole_where(p % 5 == 0, F.floor(p / 5) * 9 + 32).cast("int")
    down = whole_where((p - 32) % 9 == 0, F.floor((p - 32) / 9) * 5).cast("int")
    return table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("n")).select("p_size", "n", up.alias("fahrenheit"), down.alias("celsius"))


@query(
    "motion_segments",
    "P27+P17",
    ("formula_evaluation", "counting"),
    "WITH s AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) - 25 AS v, lag(CAST(l_quantity AS BIGINT) - 25) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS u FROM lineitem) SELECT l_orderkey, count(*) FILTER (WHERE abs(v) > abs(u)) AS speeding_up, count(*) FILTER (WHERE abs(v) < abs(u)) AS slowing_down, CAST(coalesce(sum((u + v) // 2) FILTER (WHERE (u + v) % 2 = 0), 0) AS BIGINT) AS whole_area FROM s WHERE u IS NOT NULL GROUP BY l_orderkey",
)
def motion_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a velocity graph: speeding up compares absolute velocities; areas count only where they are whole numbers."""
    v = F.col("l_quantity").cast("long") - 25
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", v.alias("v"), F.lag(v).over(w).alias("u")).where("u IS NOT NULL")
    area = F.when((F.col("u") + F.col("v")) % 2 == 0, F.floor((F.col("u") + F.col("v")) / 2)).otherwise(0)
    return s.groupBy("l_orderkey").agg(F.count_if(F.abs("v") > F.abs("u")).alias("speeding_up"), F.count_if(F.abs("v") < F.abs("u")).alias("slowing_down"), F.sum(area).alias("whole_area"))


@query(
    "gear_direction",
    "P27+P25",
    ("formula_evaluation", "state_update"),
    "SELECT CASE WHEN (n - 1) % 2 = 0 THEN 'same' ELSE 'opposite' END AS direction, count(*) AS trains FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY 1",
)
def gear_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the last gear of each train turns against the first: every mesh reverses."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return n.groupBy(F.when((F.col("n") - 1) % 2 == 0, "same").otherwise("opposite").alias("direction")).agg(F.count("*").alias("trains"))


@query(
    "buoyancy_density",
    "P27",
    ("formula_evaluation", "filtering"),
    "SELECT density, count(*) AS n FROM (SELECT CASE WHEN num > 0 AND num < den AND liquid * num % den = 0 THEN liquid * num // den END AS density FROM (SELECT p_size AS liquid, p_partkey % 7 AS num, 1 + p_partkey % 9 AS den FROM part)) GROUP BY density",
)
def buoyancy_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenths of density of a floating body from the share that is under water: only proper shares with a whole result count; others are null."""
    liquid, num, den = F.col("p_size").cast("long"), F.pmod("p_partkey", F.lit(7)), 1 + F.pmod("p_partkey", F.lit(9))
    fits = (num > 0) & (num < den) & (liquid * num % den == 0)
    return table(spark, sf_dir, "part").select(whole_where(fits, F.floor(liquid * num / den)).alias("density")).groupBy("density").agg(F.count("*").alias("n"))


@query(
    "transfer_stations",
    "P20+P02",
    ("topology", "counting"),
    "SELECT routes, count(*) AS stations FROM (SELECT l_partkey, count(DISTINCT l_suppkey) AS routes FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 2) GROUP BY routes",
)
def transfer_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations that lie on two routes or more, by the number of routes."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("routes")).where("routes >= 2")
    return s.groupBy("routes").agg(F.count("*").alias("stations"))


_TILES = "t AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, l_partkey % 7 AS a, l_suppkey % 7 AS b FROM lineitem)"


@query(
    "domino_joins",
    "P28+P29",
    ("matching", "counting"),
    f"WITH {_TILES}, j AS (SELECT *, lag(b) OVER (PARTITION BY g ORDER BY i) AS before FROM t) SELECT g, count(*) AS tiles, count(*) FILTER (WHERE a = b) AS doubles, count(*) FILTER (WHERE before <> a) AS invalid_joins, CAST(arg_max(b, i) AS BIGINT) AS open_end FROM j GROUP BY g",
)
def domino_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles laid in a row: doubles, joins whose touching pips differ, and the open end."""
    order = Window.partitionBy("g").orderBy("line", "part", "supp")
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.pmod("l_partkey", F.lit(7)).alias("a"), F.pmod("l_suppkey", F.lit(7)).alias("b"))
    j = t.withColumn("before", F.lag("b").over(order))
    return j.groupBy("g").agg(F.count("*").alias("tiles"), F.count_if(F.col("a") == F.col("b")).alias("doubles"), F.count_if(F.col("before") != F.col("a")).alias("invalid_joins"), F.max_by("b", F.struct("line", "part", "supp")).cast("long").alias("open_end"))


@query(
    "domino_chain_end",
    "P25+P28",
    ("state_update", "matching"),
    f"WITH RECURSIVE {_TILES}, r AS (SELECT g, i, b AS e, 1 AS n FROM t WHERE i = 1 UNION ALL SELECT t.g, t.i, CASE WHEN t.a = r.e THEN t.b WHEN t.b = r.e THEN t.a ELSE r.e END, r.n + CASE WHEN t.a = r.e OR t.b = r.e THEN 1 ELSE 0 END FROM r JOIN t ON t.g = r.g AND t.i = r.i + 1) SELECT g, CAST(arg_max(e, i) AS BIGINT) AS open_end, CAST(max(n) AS BIGINT) AS played FROM r GROUP BY g",
)
def domino_chain_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles offered in turn are played where one half fits the open end, which becomes the other half: a double keeps it."""
    tiles = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    halves = F.transform(tiles, lambda t: F.struct(F.pmod(t["l_partkey"], F.lit(7)).cast("long").alias("a"), F.pmod(t["l_suppkey"], F.lit(7)).cast("long").alias("b")))
    start = F.struct(F.lit(-1).cast("long").alias("e"), F.lit(0).cast("long").alias("n"))

    def play(s: Column, t: Column) -> Column:
        end = F.when((s["e"] == -1) | (t["a"] == s["e"]), t["b"]).when(t["b"] == s["e"], t["a"]).otherwise(s["e"])
        return F.struct(end.alias("e"), (s["n"] + F.when((s["e"] == -1) | (t["a"] == s["e"]) | (t["b"] == s["e"]), 1).otherwise(0)).alias("n"))

    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("g")).agg(F.aggregate(halves, start, play).alias("s"))
    return rows.select("g", F.col("s.e").alias("open_end"), F.col("s.n").alias("played"))


_BOARD = "b AS (SELECT l_orderkey // 32 AS g, CAST(l_partkey % 8 AS INTEGER) AS x, CAST(l_suppkey % 8 AS INTEGER) AS y, min(CASE WHEN l_linestatus = 'F' THEN 'B' ELSE 'W' END) AS disc FROM lineitem GROUP BY ALL)"
_RAYS = "filter(flatten(transform(sequence(-1, 1), dx -> transform(sequence(-1, 1), dy -> struct(dx, dy)))), d -> d.dx <> 0 OR d.dy <> 0)"


def board_discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards of 8 x 8 cells with black and white discs: g, x, y, disc."""
    colour = F.when(F.col("l_linestatus") == "F", "B").otherwise("W")
    return table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 32).alias("g"), F.pmod("l_partkey", F.lit(8)).cast("int").alias("x"), F.pmod("l_suppkey", F.lit(8)).cast("int").alias("y")).agg(F.min(colour).alias("disc"))


def flips(boards: DataFrame, mover: str) -> DataFrame:
    """g, x, y, flipped: the legal moves of a colour and how many discs each turns.

    Discs tell the cells on their rays how far they are; on each ray of an empty cell the nearest gap and the nearest
    own disc decide. Everything happens in aggregates by board and cell: the discs of one board are at most 64.
    """
    steps = F.explode(F.sequence(F.lit(1), F.lit(7)))
    told = boards.select("g", F.col("x").alias("dx0"), F.col("y").alias("dy0"), "disc", F.explode(F.expr(_RAYS)).alias("d")).withColumn("k", steps)
    told = told.select("g", (F.col("dx0") - F.col("k") * F.col("d.dx")).cast("int").alias("x"), (F.col("dy0") - F.col("k") * F.col("d.dy")).cast("int").alias("y"), "d", "k", "disc")
    told = told.where("x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7")
    own = F.min(F.when(F.col("disc") == mover, F.col("k")))
    rays = told.groupBy("g", "x", "y", "d").agg(own.alias("own"), F.collect_set(F.when(F.col("disc") != mover, F.col("k"))).alias("others"))
    # All cells before the nearest own disc must hold the other colour.
    rays = rays.where("own > 1").where(F.size(F.filter("others", lambda k: k < F.col("own"))) == F.col("own") - 1)
    moves = rays.groupBy("g", "x", "y").agg(F.sum(F.col("own") - 1).alias("flipped"))
    return moves.join(boards.select("g", "x", "y"), ["g", "x", "y"], "left_anti")


@query(
    "reversi_moves",
    "P37",
    ("filtering", "topology"),
    f"WITH {_BOARD}, e AS (SELECT q.g, a.x, c.y FROM (SELECT DISTINCT g FROM b) q, (SELECT CAST(range AS INTEGER) AS x FROM range(8)) a, (SELECT CAST(range AS INTEGER) AS y FROM range(8)) c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.g = q.g AND b.x = a.x AND b.y = c.y)), rays AS (SELECT e.g, e.x, e.y, dx, dy, k, o.disc FROM e, (SELECT CAST(range AS INTEGER) AS dx FROM range(-1, 2)), (SELECT CAST(range AS INTEGER) AS dy FROM range(-1, 2)), (SELECT CAST(range AS INTEGER) AS k FROM range(1, 8)) JOIN b o ON o.g = e.g AND o.x = e.x + k * dx AND o.y = e.y + k * dy WHERE dx <> 0 OR dy <> 0), n AS (SELECT g, x, y, dx, dy, min(k) FILTER (WHERE disc = 'B') AS own FROM rays GROUP BY ALL), f AS (SELECT n.g, n.x, n.y, n.own, (SELECT count(*) FROM rays r WHERE r.g = n.g AND r.x = n.x AND r.y = n.y AND r.dx = n.dx AND r.dy = n.dy AND r.k < n.own AND r.disc = 'W') AS between_ FROM n WHERE own > 1) SELECT g, count(*) AS moves, CAST(max(flipped) AS BIGINT) AS most_flipped FROM (SELECT g, x, y, sum(own - 1) AS flipped FROM f WHERE between_ = own - 1 GROUP BY g, x, y) GROUP BY g",
)
def reversi_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal moves of black on each board, and the most discs that one turns."""
    moves = flips(board_discs(spark, sf_dir), "B")
    return moves.groupBy("g").agg(F.count("*").alias("moves"), F.max("flipped").alias("most_flipped"))


@query(
    "four_in_line",
    "P34+P31",
    ("counting", "spatial_relations"),
    f"WITH {_BOARD} SELECT a.g, a.disc, count(*) AS lines FROM (SELECT b.*, x + dx AS x1, y + dy AS y1, x + 2 * dx AS x2, y + 2 * dy AS y2, x + 3 * dx AS x3, y + 3 * dy AS y3 FROM b, (VALUES (1, 0), (0, 1), (1, 1), (1, -1)) d(dx, dy)) a JOIN b p ON p.g = a.g AND p.disc = a.disc AND p.x = x1 AND p.y = y1 JOIN b q ON q.g = a.g AND q.disc = a.disc AND q.x = x2 AND q.y = y2 JOIN b r ON r.g = a.g AND r.disc = a.disc AND r.x = x3 AND r.y = y3 GROUP BY ALL",
)
def four_in_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of four equal discs in a row, column or diagonal: each disc names the windows that it lies in, and full windows count."""
    ways = F.expr("array(struct(1 AS dx, 0 AS dy), struct(0 AS dx, 1 AS dy), struct(1 AS dx, 1 AS dy), struct(1 AS dx, -1 AS dy))")
    named = board_discs(spark, sf_dir).select("g", "disc", "x", "y", F.explode(ways).alias("d")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    windows = named.groupBy("g", "disc", "d", (F.col("x") - F.col("k") * F.col("d.dx")).alias("x0"), (F.col("y") - F.col("k") * F.col("d.dy")).alias("y0")).agg(F.count("*").alias("n"))
    return windows.where("n = 4").groupBy("g", "disc").agg(F.count("*").alias("lines"))


@query(
    "backgammon_destinations",
    "P37+P02",
    ("filtering", "counting"),
    "WITH p AS (SELECT l_orderkey // 32 AS g, CAST(l_partkey % 24 AS INTEGER) AS point, min(CASE WHEN l_linestatus = 'F' THEN 'B' ELSE 'W' END) AS side, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT p.g, p.point - die AS at FROM p, (VALUES (2), (5)) v(die) WHERE p.side = 'B' AND p.point - die >= 0), s AS (SELECT m.g, CASE WHEN o.side = 'W' AND o.n >= 2 THEN 'blocked' WHEN o.side = 'W' THEN 'hit' ELSE 'open' END AS state FROM m LEFT JOIN p o ON o.g = m.g AND o.point = m.at) SELECT state, count(*) AS n FROM s GROUP BY state",
)
def backgammon_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where black's checkers come to with each die, moving down: blocked by two opponents or more, a hit on exactly one, else open."""
    side = F.when(F.col("l_linestatus") == "F", "B").otherwise("W")
    p = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 32).alias("g"), F.pmod("l_partkey", F.lit(24)).cast("int").alias("point")).agg(F.min(side).alias("side"), F.count("*").alias("n"))
    moved = p.where("side = 'B'").select("g", F.explode(F.array(F.col("point") - 2, F.col("point") - 5)).alias("point")).where("point >= 0")
    state = F.when((F.col("side") == "W") & (F.col("n") >= 2), "blocked").when(F.col("side") == "W", "hit").otherwise("open")
    return moved.join(p, ["g", "point"], "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query(
    "gate_outputs",
    "P25+P04",
    ("state_update", "logical_composition"),
    "WITH RECURSIVE t AS (SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, l_partkey % 6 AS op, l_suppkey % 2 AS v FROM lineitem), r AS (SELECT g, i, v AS s FROM t WHERE i = 1 UNION ALL SELECT t.g, t.i, CASE t.op WHEN 0 THEN 1 - r.s WHEN 1 THEN r.s * t.v WHEN 2 THEN greatest(r.s, t.v) WHEN 3 THEN (r.s + t.v) % 2 WHEN 4 THEN 1 - r.s * t.v ELSE 1 - greatest(r.s, t.v) END FROM r JOIN t ON t.g = r.g AND t.i = r.i + 1) SELECT g, CAST(arg_max(s, i) AS BIGINT) AS output FROM r GROUP BY g",
)
def gate_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output of each chain of gates: NOT takes the signal alone, AND, OR, XOR, NAND and NOR take it with a second input."""
    gates = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda t: F.struct(F.pmod(t["l_partkey"], F.lit(6)).alias("op"), F.pmod(t["l_suppkey"], F.lit(2)).cast("long").alias("v")))

    def pass_gate(s: Column, t: Column) -> Column:
        both, either, op, v = s * t["v"], F.greatest(s, t["v"]), t["op"], t["v"]
        out = F.when(op == 0, 1 - s).when(op == 1, both).when(op == 2, either).when(op == 3, (s + v) % 2).when(op == 4, 1 - both).otherwise(1 - either)
        return F.when(s == -1, v).otherwise(out)

    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("g")).agg(F.aggregate(gates, F.lit(-1).cast("long"), pass_gate).alias("output"))


@query(
    "peer_candidates",
    "P39+P04",
    ("filtering", "logical_composition"),
    "WITH c AS (SELECT l_orderkey // 32 AS g, CAST(l_partkey % 9 AS INTEGER) AS r, CAST(l_suppkey % 9 AS INTEGER) AS k, CAST(min(1 + l_linenumber % 9) AS INTEGER) AS v FROM lineitem GROUP BY ALL), q AS (SELECT DISTINCT g, r FROM c WHERE k = 0) SELECT q.g, q.r, 9 - count(DISTINCT c.v) AS candidates FROM q JOIN c ON c.g = q.g AND NOT (c.r = q.r AND c.k = 0) AND (c.r = q.r OR c.k = 0 OR (c.r // 3 = q.r // 3 AND c.k // 3 = 0)) GROUP BY q.g, q.r",
)
def peer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits that the filled cells of row, column and box leave open to each marked cell (first column); cells tell their peers."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 32).alias("g"), F.pmod("l_partkey", F.lit(9)).cast("int").alias("r"), F.pmod("l_suppkey", F.lit(9)).cast("int").alias("k")).agg(F.min(1 + F.pmod("l_linenumber", F.lit(9))).cast("int").alias("v"))
    rows = F.expr("CASE WHEN k = 0 THEN filter(sequence(0, 8), p -> p <> r) WHEN k < 3 THEN filter(sequence(0, 8), p -> p = r OR p div 3 = r div 3) ELSE array(r) END")
    told = c.select("g", F.explode(rows).alias("r"), "v").groupBy("g", "r").agg(F.collect_set("v").alias("seen"))
    return c.where("k = 0").select("g", "r").join(told, ["g", "r"]).select("g", "r", (9 - F.size("seen")).cast("long").alias("candidates"))


@query(
    "turning_agent",
    "P25",
    ("state_update",),
    "WITH RECURSIVE a AS (SELECT p_partkey AS k, 0 AS i, CAST(p_partkey % 4 AS BIGINT) AS x, CAST(p_size % 4 AS BIGINT) AS y, CAST(0 AS BIGINT) AS d, list_transform(range(16), lambda c: CAST((c + p_partkey) % 3 AS BIGINT)) AS cells FROM part UNION ALL SELECT k, i + 1, (x + [0, 1, 0, -1][n + 1] + 4) % 4, (y + [-1, 0, 1, 0][n + 1] + 4) % 4, n, cells FROM (SELECT k, i, x, y, (d + [1, 3, 0][cells[4 * y + x + 1] + 1]) % 4 AS n, list_transform(range(16), lambda c: CASE WHEN c = 4 * y + x THEN (cells[c + 1] + 1) % 3 ELSE cells[c + 1] END) AS cells FROM a WHERE i < 8)) SELECT x, y, count(*) AS agents FROM a WHERE i = 8 GROUP BY x, y",
)
def turning_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents on a torus of 4 x 4 cells after eight steps: turn by the cell's state (right, left, on), raise that state modulo 3, then move."""
    state = F.struct(F.pmod("p_partkey", F.lit(4)).cast("long").alias("x"), F.pmod("p_size", F.lit(4)).cast("long").alias("y"), F.lit(0).cast("long").alias("d"), F.expr("transform(sequence(0, 15), c -> cast(pmod(c + p_partkey, 3) AS bigint))").alias("cells"))

    def step(s: Column, _: Column) -> Column:
        at = (s["y"] * 4 + s["x"]).cast("int")
        here = F.element_at(s["cells"], at + 1)
        d = (s["d"] + F.when(here == 0, 1).when(here == 1, 3).otherwise(0)) % 4
        cells = F.transform(s["cells"], lambda v, i: F.when(i == at, (v + 1) % 3).otherwise(v))
        x = F.pmod(s["x"] + F.when(d == 1, 1).when(d == 3, -1).otherwise(0), F.lit(4).cast("long"))
        y = F.pmod(s["y"] + F.when(d == 0, -1).when(d == 2, 1).otherwise(0), F.lit(4).cast("long"))
        return F.struct(x.alias("x"), y.alias("y"), d.alias("d"), cells.alias("cells"))

    end = table(spark, sf_dir, "part").select(F.aggregate(F.sequence(F.lit(1), F.lit(8)), state, step).alias("s"))
    return end.groupBy(F.col("s.x").alias("x"), F.col("s.y").alias("y")).agg(F.count("*").alias("agents"))


@query(
    "calendar_arithmetic",
    "P36+P27",
    ("formula_evaluation",),
    "SELECT CAST(date_part('isodow', o_orderdate) AS INTEGER) AS weekday, CAST((month(o_orderdate) + 4) % 12 + 1 AS INTEGER) AS month_later, count(*) AS n FROM orders GROUP BY ALL",
)
def calendar_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays (Monday is 1) and the month five months later, around the year's end."""
    day = (F.weekday("o_orderdate") + 1).cast("int")
    later = (F.pmod(F.month("o_orderdate") + 4, F.lit(12)) + 1).cast("int")
    return table(spark, sf_dir, "orders").groupBy(day.alias("weekday"), later.alias("month_later")).agg(F.count("*").alias("n"))


@query(
    "polygon_perimeter",
    "P31+P27",
    ("formula_evaluation", "spatial_relations"),
    "WITH v AS (SELECT user_id, value AS y, CAST(event_id % 100 AS DOUBLE) AS x, lead(value) OVER w AS ny, CAST(lead(event_id) OVER w % 100 AS DOUBLE) AS nx, first_value(value) OVER w AS fy, CAST(first_value(event_id) OVER w % 100 AS DOUBLE) AS fx FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, round(sum(sqrt(power(coalesce(nx, fx) - x, 2) + power(coalesce(ny, fy) - y, 2))), 3) AS perimeter FROM v GROUP BY user_id",
)
def polygon_perimeter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length around each closed polygon."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    x, y = F.pmod("event_id", F.lit(100)).cast("double"), F.col("value")
    v = table(spark, sf_dir, "events").select("user_id", "event_id", x.alias("x"), y.alias("y"))
    v = v.withColumns({"nx": F.coalesce(F.lead("x").over(w), F.first("x").over(w)), "ny": F.coalesce(F.lead("y").over(w), F.first("y").over(w))})
    return v.groupBy("user_id").agg(F.round(F.sum(F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))), 3).alias("perimeter"))


@query(
    "parent_repeated_leaf",
    "P07+P34",
    ("aggregation",),
    "SELECT l_linenumber AS leaf, count(*) AS parents, round(sum(s), 2) AS total, round(avg(s), 4) AS mean FROM (SELECT l_returnflag, l_linenumber, sum(l_quantity) AS s FROM lineitem GROUP BY ALL) GROUP BY l_linenumber HAVING count(*) >= 2",
)
def parent_repeated_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves that repeat under several parents: sum and mean of their values across the parents."""
    leaf = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_linenumber").alias("leaf")).agg(F.sum("l_quantity").alias("s"))
    return leaf.groupBy("leaf").agg(F.count("*").alias("parents"), F.round(F.sum("s"), 2).alias("total"), F.round(F.avg("s"), 4).alias("mean")).where("parents >= 2")
