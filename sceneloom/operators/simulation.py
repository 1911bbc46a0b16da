"""State-update programs: grids, tapes, boards, circuits. Scenes are small arrays, one row each, folded by higher-order functions; grids are cells joined with their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, table


def life_step(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One step of Life on the grids in `cells` (keys, row, col, alive); nothing lies beyond the grid.

    Live cells tell their eight neighbours by an explode and an aggregate: one shuffle, no self-join.
    """
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), r -> transform(sequence(-1, 1), c -> struct(r, c))))"))
    told = cells.where("alive = 1").select(*keys, "row", "col", around.alias("d")).where("d.r <> 0 OR d.c <> 0")
    told = told.select(*keys, (F.col("row") + F.col("d.r")).alias("row"), (F.col("col") + F.col("d.c")).alias("col"), F.lit(1).alias("k"), F.lit(None).cast("int").alias("alive"))
    both = told.unionByName(cells.select(*keys, "row", "col", F.lit(0).alias("k"), F.col("alive").cast("int").alias("alive")))
    n = both.groupBy(*keys, "row", "col").agg(F.sum("k").alias("n"), F.max("alive").alias("alive")).where("alive IS NOT NULL")
    return n.select(*keys, "row", "col", F.when((F.col("n") == 3) | ((F.col("n") == 2) & (F.col("alive") == 1)), 1).otherwise(0).alias("alive"))


_CELLS = "c AS (SELECT CAST(p_partkey // 400 AS BIGINT) AS g, CAST(p_partkey % 400 // 20 AS INTEGER) AS r, CAST(p_partkey % 20 AS INTEGER) AS k, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS alive FROM part)"


def part_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.floor(key / 400).alias("g"), F.floor(F.pmod(key, F.lit(400)) / 20).cast("int").alias("row"), F.pmod(key, F.lit(20)).cast("int").alias("col"), (F.col("p_size") % 3 == 0).cast("int").alias("alive"))


@query(
    "life_step_count",
    "P25+P19",
    ("state_update", "counting"),
    f"WITH {_CELLS}, s AS (SELECT a.g, a.r, a.k, any_value(a.alive) AS alive, sum(b.alive) FILTER (WHERE NOT (a.r = b.r AND a.k = b.k)) AS n FROM c a JOIN c b ON a.g = b.g AND abs(a.r - b.r) <= 1 AND abs(a.k - b.k) <= 1 GROUP BY ALL) SELECT g, count(*) FILTER (WHERE n = 3 OR (n = 2 AND alive = 1)) AS living FROM s GROUP BY g",
)
def life_step_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Living cells after one step."""
    return life_step(part_cells(spark, sf_dir), ["g"]).groupBy("g").agg(F.count_if(F.col("alive") == 1).alias("living"))


@query(
    "line_clear_count",
    "P25+P34",
    ("state_update", "counting"),
    f"WITH {_CELLS}, f AS (SELECT g, r FROM c GROUP BY g, r HAVING count(*) FILTER (WHERE alive = 1) >= 9), h AS (SELECT a.g, count(*) AS holes FROM c a WHERE alive = 0 AND EXISTS (SELECT 1 FROM c b WHERE b.g = a.g AND b.k = a.k AND b.r < a.r AND b.alive = 1) GROUP BY a.g) SELECT h.g, holes, (SELECT count(*) FROM f WHERE f.g = h.g) AS full_rows FROM h",
)
def line_clear_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows filled to a mark, and holes: empty cells with a block above in their column."""
    cells = part_cells(spark, sf_dir)
    full = cells.groupBy("g", "row").agg(F.count_if(F.col("alive") == 1).alias("n")).groupBy("g").agg(F.count_if(F.col("n") >= 9).alias("full_rows"))
    top = cells.groupBy("g", "col").agg(F.min(F.when(F.col("alive") == 1, F.col("row"))).alias("top"))
    holes = cells.join(top, ["g", "col"]).groupBy("g").agg(F.count_if((F.col("alive") == 0) & (F.col("row") > F.col("top"))).alias("holes"))
    return holes.join(full, "g").select("g", "holes", "full_rows")


def slide(line: Column) -> Column:
    """(line, score) of a move to the front: zeros go, equal neighbours merge once each, from the front."""
    tiles = F.filter(line, lambda v: v > 0)
    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(False).alias("open"), F.lit(0).cast("long").alias("score"))

    def step(s: Column, v: Column) -> Column:
        v = v.cast("long")
        last = F.try_element_at(s["out"], F.lit(-1))
        merged = F.concat(F.slice(s["out"], F.lit(1), F.size(s["out"]) - 1), F.array(v * 2))
        return F.when(s["open"] & (last == v), F.struct(merged.alias("out"), F.lit(False).alias("open"), (s["score"] + v * 2).alias("score"))).otherwise(
            F.struct(F.concat(s["out"], F.array(v)).alias("out"), F.lit(True).alias("open"), s["score"].alias("score"))
        )

    return F.aggregate(tiles, start, step, lambda s: F.struct(F.concat(s["out"], F.array_repeat(F.lit(0).cast("long"), F.size(line) - F.size(s["out"]))).alias("line"), s["score"].alias("score")))


@query("slide_merge", "P25", ("state_update",))
def slide_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of tiles moved to the front, with the score of the move."""
    tiles = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda t: F.pow(F.lit(2), 1 + F.pmod(t["l_partkey"], F.lit(2))).cast("long"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(tiles.alias("line"))
    return rows.select("l_orderkey", slide(F.col("line")).alias("m")).select("l_orderkey", F.concat_ws(",", F.col("m.line").cast("array<string>")).alias("line"), F.col("m.score").alias("score"))


def run_lengths(line: Column) -> Column:
    """Lengths of the runs of true values; [0] where there is none."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("run"))
    step = lambda s, v: F.when(v, F.struct(s["out"].alias("out"), (s["run"] + 1).alias("run"))).otherwise(F.struct(F.when(s["run"] > 0, F.concat(s["out"], F.array(s["run"]))).otherwise(s["out"]).alias("out"), F.lit(0).alias("run")))
    done = F.aggregate(line, start, step, lambda s: F.when(s["run"] > 0, F.concat(s["out"], F.array(s["run"]))).otherwise(s["out"]))
    return F.when(F.size(done) == 0, F.array(F.lit(0))).otherwise(done)


@query(
    "nonogram_clues",
    "P17+P39",
    ("topology", "counting"),
    f"WITH {_CELLS}, f AS (SELECT g, r, k, alive, k - row_number() OVER (PARTITION BY g, r, alive ORDER BY k) AS island FROM c), i AS (SELECT g, r, min(k) AS k, count(*) AS n FROM f WHERE alive = 1 GROUP BY g, r, island), q AS (SELECT DISTINCT g, r FROM c) SELECT q.g, q.r, coalesce(string_agg(n::VARCHAR, ' ' ORDER BY k), '0') AS clue FROM q LEFT JOIN i ON i.g = q.g AND i.r = q.r GROUP BY q.g, q.r",
)
def nonogram_clues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run lengths of every line of a grid."""
    lines = part_cells(spark, sf_dir).groupBy("g", F.col("row").alias("r")).agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "alive"))), lambda c: c["alive"] == 1).alias("line"))
    return lines.select("g", "r", F.concat_ws(" ", run_lengths(F.col("line")).cast("array<string>")).alias("clue"))


def turing(tape: Column, rules: Column, steps: int) -> Column:
    """(tape, head, state) after so many steps. rules: map from 'state:symbol' to (write, move, state); the head writes, then moves, and stays on the tape."""
    start = F.struct(tape.alias("tape"), F.lit(1).alias("head"), F.lit("A").alias("state"))

    def step(s: Column, _: Column) -> Column:
        rule = F.try_element_at(rules, F.concat(s["state"], F.lit(":"), F.element_at(s["tape"], s["head"]).cast("string")))
        written = F.transform(s["tape"], lambda v, i: F.when(i + 1 == s["head"], rule["write"]).otherwise(v))
        head = F.greatest(F.lit(1), F.least(F.size(s["tape"]), s["head"] + rule["move"]))
        return F.when(rule.isNull(), s).otherwise(F.struct(written.alias("tape"), head.alias("head"), rule["state"].alias("state")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


@query("turing_tape", "P25", ("state_update",))
def turing_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-state machine run for ten steps on a tape for each part."""
    rule = lambda w, m, s: F.struct(F.lit(w).alias("write"), F.lit(m).alias("move"), F.lit(s).alias("state"))
    rules = F.create_map(F.lit("A:0"), rule(1, 1, "B"), F.lit("A:1"), rule(0, -1, "B"), F.lit("B:0"), rule(1, -1, "A"), F.lit("B:1"), rule(1, 1, "A"))
    tape = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.shiftright("p_size", 0).bitwiseAND(F.pow(F.lit(2), i).cast("int")).cast("boolean").cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", turing(tape, rules, 10).alias("s"))
    return rows.select("p_partkey", F.concat_ws("", F.col("s.tape").cast("array<string>")).alias("tape"), (F.col("s.head") - 1).alias("head"), F.col("s.state").alias("state"))


@query(
    "truth_table_count",
    "P25+P04",
    ("logical_composition", "counting"),
    "SELECT count(*) FILTER (WHERE (a AND b) <> (NOT c)) AS n_true, string_agg(CASE WHEN (a AND b) <> (NOT c) THEN '1' ELSE '0' END, '' ORDER BY i) AS column_bits FROM (SELECT i, i // 4 % 2 = 1 AS a, i // 2 % 2 = 1 AS b, i % 2 = 1 AS c FROM range(8) t(i))",
)
def truth_table_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column of (A and B) xor (not C) over eight rows, A the high bit."""
    bit = lambda k: F.shiftright("id", k).bitwiseAND(F.lit(1)) == 1
    value = (bit(2) & bit(1)) != ~bit(0)
    rows = spark.range(8).select("id", value.alias("v"))
    bits = F.array_sort(F.collect_list(F.struct("id", F.col("v").cast("int").alias("b"))))
    return rows.agg(F.count_if("v").alias("n_true"), F.concat_ws("", F.transform(bits, lambda x: x["b"].cast("string"))).alias("column_bits"))


def sow(pits: Column, pit: int) -> Column:
    """Pits after the seeds of one are sown to those that follow, cyclically; the pit is emptied first."""
    n, seeds = F.size(pits), F.element_at(pits, pit + 1)
    return F.transform(pits, lambda v, i: F.when(i == pit, F.lit(0)).otherwise(v) + F.floor(seeds / n) + F.when(F.pmod(i - F.lit(pit + 1), n) < F.pmod(seeds, n), 1).otherwise(0))


@query(
    "mancala_sow",
    "P25",
    ("state_update",),
    "WITH p AS (SELECT p_partkey, p_size AS seeds FROM part) SELECT p_partkey, array_to_string(list_transform(range(6), lambda i: CASE WHEN i = 2 THEN 0 ELSE 4 END + seeds // 6 + CASE WHEN (i - 3 + 6) % 6 < seeds % 6 THEN 1 ELSE 0 END), ',') AS pits FROM p",
)
def mancala_sow(spark: SparkSession, sf_dir: str) -> DataFrame:
    pits = F.array(*[F.col("p_size") if i == 2 else F.lit(4) for i in range(6)])
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(",", F.transform(sow(pits, 2), lambda v: v.cast("string"))).alias("pits"))


def pop_run(chain: Column, place: Column, colour: Column) -> Column:
    """Marbles that go when one is put in at a place: the run of its colour through that place if it is three or more with it, else none; no cascade."""
    left = F.reverse(F.slice(chain, F.lit(1), place))
    right = F.slice(chain, place + 1, F.size(chain))
    lead = lambda side: F.coalesce(F.nullif(F.array_position(F.transform(side, lambda v: v != colour), True), F.lit(0)) - 1, F.size(side).cast("long"))
    run = lead(left) + lead(right)
    return F.when(run >= 2, run).otherwise(F.lit(0).cast("long"))


@query("marble_pop", "P25+P17", ("state_update", "topology"))
def marble_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marbles removed when a marble is shot into the middle of each order's chain of flags."""
    chain = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))), lambda r: r["l_returnflag"])
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(chain.alias("chain"))
    return rows.select("l_orderkey", pop_run(F.col("chain"), F.floor(F.size("chain") / 2).cast("int"), F.lit("R")).alias("gone"))


@query(
    "forced_cells",
    "P39+P19",
    ("logical_composition", "topology"),
    f"WITH {_CELLS}, h AS (SELECT *, (r * 7 + k * 3) % 5 = 0 AS hidden FROM c), n AS (SELECT a.g, a.r, a.k, count(*) FILTER (WHERE b.hidden) AS hid, count(*) FILTER (WHERE b.alive = 1) AS mines, count(*) FILTER (WHERE b.alive = 1 AND NOT b.hidden) AS flagged FROM h a JOIN h b ON a.g = b.g AND abs(a.r - b.r) <= 1 AND abs(a.k - b.k) <= 1 AND NOT (a.r = b.r AND a.k = b.k) WHERE NOT a.hidden GROUP BY ALL) SELECT g, count(*) FILTER (WHERE hid > 0 AND mines - flagged = hid) AS mine_clues, count(*) FILTER (WHERE hid > 0 AND mines = flagged) AS safe_clues FROM n GROUP BY g",
)
def forced_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clues whose hidden neighbours must all be mines, and those where none can be."""
    cells = part_cells(spark, sf_dir).withColumn("hidden", (F.col("row") * 7 + F.col("col") * 3) % 5 == 0)
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), r -> transform(sequence(-1, 1), c -> struct(r, c))))"))
    told = cells.select("g", "row", "col", "hidden", "alive", around.alias("d")).where("d.r <> 0 OR d.c <> 0")
    told = told.select("g", (F.col("row") + F.col("d.r")).alias("row"), (F.col("col") + F.col("d.c")).alias("col"), F.col("hidden").alias("h"), F.col("alive").alias("a"))
    sums = told.groupBy("g", "row", "col").agg(F.count_if("h").alias("hid"), F.sum("a").alias("mines"), F.count_if((F.col("a") == 1) & ~F.col("h")).alias("flagged"))
    clues = cells.where("NOT hidden").join(sums, ["g", "row", "col"])
    return clues.groupBy("g").agg(F.count_if(F.expr("hid > 0 AND mines - flagged = hid")).alias("mine_clues"), F.count_if(F.expr("hid > 0 AND mines = flagged")).alias("safe_clues"))


@query(
    "ray_attackers",
    "P37+P31",
    ("topology", "spatial_relations"),
    f"WITH {_CELLS}, t AS (SELECT DISTINCT g FROM c), s AS (SELECT c.g, sign(r - 8) AS dr, sign(k - 9) AS dk, greatest(abs(r - 8), abs(k - 9)) AS d, (r + k) % 2 AS kind FROM c WHERE alive = 1 AND (r = 8 OR k = 9 OR abs(r - 8) = abs(k - 9)) AND NOT (r = 8 AND k = 9)), f AS (SELECT g, dr, dk, arg_min(kind, d) AS kind FROM s GROUP BY ALL) SELECT g, count(*) FILTER (WHERE kind = 0) AS attackers FROM f GROUP BY g",
)
def ray_attackers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first piece along each of the eight rays to a square, if it is one that attacks: the smallest step for each ray."""
    dr, dc = F.col("row") - 8, F.col("col") - 9
    on_ray = ((dr == 0) | (dc == 0) | (F.abs(dr) == F.abs(dc))) & ~((dr == 0) & (dc == 0))
    pieces = part_cells(spark, sf_dir).where("alive = 1").where(on_ray)
    first = pieces.groupBy("g", F.signum(dr).alias("r"), F.signum(dc).alias("c")).agg(F.min_by((F.col("row") + F.col("col")) % 2, F.greatest(F.abs(dr), F.abs(dc))).alias("kind"))
    return first.groupBy("g").agg(F.count_if(F.col("kind") == 0).alias("attackers"))
