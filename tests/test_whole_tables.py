"""Query programs without an oracle read every row of their table, whatever its key; held against plain Python on a small fixture."""

import random

import pytest

from sceneloom import registry
from sceneloom.functions import kernels

QUERIES = registry.all_queries()
#: Keys on both sides of the bounds that the programs once had.
ORDERS = [*range(1, 30), *range(990, 1010), *range(1990, 2010), *range(2990, 3010), 10**6, 10**9]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, out = random.Random(7), str(tmp_path_factory.mktemp("tables"))
    lines = [(o, i, rng.randrange(1, 5000), rng.randrange(1, 90), float(rng.randrange(1, 51)), rng.choice("RAN")) for o in ORDERS for i in range(1, rng.randrange(2, 8))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(f"{out}/lineitem.parquet")
    parts = [(p, rng.randrange(1, 51)) for p in (1, 499, 500, 501, 10**6)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{out}/part.parquet")
    return out, lines, parts


def got(spark, name, out):
    return sorted(tuple(r) for r in QUERIES[name](spark, out).collect())


def per_order(lines, pick):
    return {o: [pick(r) for r in sorted(lines) if r[0] == o] for o in ORDERS}


def test_slide_merge(spark, tables):
    out, lines, _ = tables
    want = []
    for o, tiles in per_order(lines, lambda r: 2 ** (1 + r[2] % 2)).items():
        done, score, open_ = [], 0, False
        for v in tiles:
            if open_ and done[-1] == v:
                done[-1], score, open_ = 2 * v, score + 2 * v, False
            else:
                done, open_ = [*done, v], True
        want.append((o, ",".join(map(str, done + [0] * (len(tiles) - len(done)))), score))
    assert got(spark, "slide_merge", out) == sorted(want)


def test_marble_pop(spark, tables):
    out, lines, _ = tables
    want = []
    for o, chain in per_order(lines, lambda r: r[5]).items():
        a = b = len(chain) // 2
        while a and chain[a - 1] == "R":
            a -= 1
        while b < len(chain) and chain[b] == "R":
            b += 1
        want.append((o, b - a if b - a >= 2 else 0))
    assert got(spark, "marble_pop", out) == sorted(want)


def test_turing_tape(spark, tables):
    out, _, parts = tables
    rules = {("A", 0): (1, 1, "B"), ("A", 1): (0, -1, "B"), ("B", 0): (1, -1, "A"), ("B", 1): (1, 1, "A")}
    want = []
    for p, size in parts:
        tape, head, state = [size >> i & 1 for i in range(8)], 0, "A"
        for _ in range(10):
            tape[head], move, state = rules[state, tape[head]]
            head = max(0, min(7, head + move))
        want.append((p, "".join(map(str, tape)), head, state))
    assert got(spark, "turing_tape", out) == sorted(want)


def trade(lines, most):
    graphs = {}
    for o, _, part, supp, quantity, _ in lines:
        a, b = sorted((supp % 12, part % 12))
        if a != b:
            edges = graphs.setdefault(o % 40, {})
            edges[a, b] = min(edges.get((a, b), 99), int(quantity))
    graphs = {g: [(a, b, w) for (a, b), w in e.items() if w < most] for g, e in graphs.items()}
    return {g: e for g, e in graphs.items() if e}


@pytest.mark.parametrize(
    ("name", "most", "kernel"),
    [
        ("mst_weight", 20, lambda e: [kernels.spanning_forest(e)]),
        ("cut_structure_count", 9, lambda e: [kernels.cut_counts(e)]),
        ("max_flow_value", 20, lambda e: [(kernels.max_flow(e, 0, 11),)]),
        ("weighted_path_cost", 20, lambda e: kernels.cheapest_paths(e, 0)),
        ("component_count", 5, lambda e: [kernels.component_sizes(e)]),
    ],
)
def test_trade_graphs(spark, tables, name, most, kernel):
    out, lines, _ = tables
    assert got(spark, name, out) == sorted((g, *row) for g, e in trade(lines, most).items() for row in kernel(e))


def test_strong_components(spark, tables):
    out, lines, _ = tables
    graphs = {}
    for o, _, part, supp, *_ in lines:
        a, b = supp % 9, part % 9
        if a != b and a + 2 * b < 14:
            graphs.setdefault(o % 40, set()).add((a, b))
    want = [(g, kernels.strong_component_count(sorted(e)), kernels.unique_topological_order(sorted(e)) is not None) for g, e in graphs.items()]
    assert got(spark, "strong_components", out) == sorted(want)
