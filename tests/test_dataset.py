"""Dataset pipeline, sources, streams, joins, scalar functions and kernels."""

import itertools
import json
import random
from fractions import Fraction

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sceneloom.functions import kernels, scalar
from sceneloom.joins import asof_join, present_in_every, range_join
from sceneloom.operators.simulation import life_step, pop_run, run_lengths, slide
from sceneloom.plans import dataset
from sceneloom.sources.records import SceneSource, pack, pack_shards, read_jsonl, read_record_shards, with_record_refs
from sceneloom.streaming import scores


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_plan(spark):
    w = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 1.0), ("zero", 0.0)], "task_id string, weight double")
    counts = dataset.apportion(w, 10)
    assert {r["task_id"]: r["count"] for r in counts.collect()} == {"a": 4, "b": 3, "c": 3}
    plan = dataset.plan(counts, 42)
    seeds = [r["instance_seed"] for r in plan.collect()]
    assert len(set(seeds)) == 10 and all(0 <= s < (1 << 53) - 1 for s in seeds)
    assert sorted(seeds) == sorted(r["instance_seed"] for r in dataset.plan(counts.repartition(3), 42).collect())
    assert dataset.equal_split(12, 4) == 3
    with pytest.raises(ValueError):
        dataset.equal_split(10, 4)
    picks = spark.createDataFrame([(0.0,), (0.2,), (0.21,), (0.999999,)], "r double").select(dataset.weighted_choice(F.col("r"), {"x": 1, "y": 4, "n": 0}).alias("k"))
    assert [r["k"] for r in picks.collect()] == ["x", "x", "y", "y"]


def test_identity(spark):
    fields = {f: F.lit("v") for f in dataset.IDENTITY_FIELDS}
    one = value(spark, dataset.instance_id(fields))
    assert one.startswith("sha256:") and one == value(spark, dataset.instance_id(fields | {"scene_id": F.lit("other")}))
    assert one != value(spark, dataset.instance_id(fields | {"prompt": F.lit("w")}))
    assert dataset.canonical_json({"b": [1, 2.5], "a": None}) == '{"a":null,"b":[1,2.5]}'
    for bad in ({1: 2}, float("nan"), 1 << 60, object()):
        with pytest.raises(ValueError):
            dataset.canonical_json(bad)
    assert dataset.first_difference({"a": [1, {"b": 2}]}, {"a": [1, {"b": 3}]}) == "$.a[1].b" and dataset.first_difference([1], [1]) is None


def test_contracts_and_sanitising(spark):
    made = value(spark, dataset.reward_contract(F.lit("integer"), F.lit("bbox_set")))
    assert made["annotation"]["id"] == "bbox_set_soft_iou_v0" and value(spark, dataset.reward_contract(F.lit("integer"), F.lit("odd"))) is None
    assert value(spark, dataset.witness_summary(F.lit("bbox"), F.array(F.lit(1), F.lit(2)))) == 1
    text = json.dumps({"image_id": 1, "node_ids": [1], "keep": {"x_labels": 1, "y": [{"row_id": 2, "z": 3}]}, "path": 4})
    assert json.loads(value(spark, dataset.sanitize_json(F.lit(text), frozenset({"path"})))) == {"image_id": 1, "keep": {"y": [{"z": 3}]}}


def instances(spark):
    good = {"instance_id": "a", "instance_version": "v0", "task": "t1", "prompt_variants": {str(i): "p" for i in range(5)}, "answer_type": "integer", "answer_value": "1", "annotation_type": "bbox", "image_path": "images/a.png", "image_hash": "h", "record_shard": "s", "record_line": 0, "own_record_hash": "x"}
    bad = good | {"instance_id": "b", "prompt_variants": {"1": "has {slot}"}, "annotation_type": "odd", "image_path": "/tmp/x.png", "image_hash": None, "task": "t9", "record_line": 7, "instance_version": "v9", "answer_value": None}
    schema = "instance_id string, instance_version string, task string, prompt_variants map<string,string>, answer_type string, answer_value string, annotation_type string, image_path string, image_hash string, record_shard string, record_line bigint, own_record_hash string"
    return spark.createDataFrame([Row(**good), Row(**bad)], schema)


def test_validation(spark):
    records = spark.createDataFrame([("s", 0, "y")], "shard_id string, line_index bigint, record_hash string")
    tasks = spark.createDataFrame([("t1",), ("t2",)], "task string")
    requested = spark.createDataFrame([("t1", 1), ("t2", 3)], "task string, count bigint")
    found = {(r["instance_id"], r["error_code"]) for r in dataset.validate(instances(spark), records, tasks, requested).collect()}
    assert found == {
        ("a", "record_ref_hash_mismatch"),
        *(("b", c) for c in ("schema_missing_field", "schema_unsupported_type", "version_unsupported_instance_version", "prompt_variant_count_mismatch", "prompt_unresolved_placeholder", "image_path_not_relative", "image_hash_missing", "config_task_not_registered", "record_ref_not_found")),
        *((None, c) for c in ("version_mixed_instance_version", "count_per_task_shortfall", "count_unexpected_task_present")),
    }


def test_reproduction_and_export(spark, tmp_path):
    one = spark.createDataFrame([(i, f"v{i}") for i in range(9)], "index bigint, v string")
    assert dataset.reproduction_mismatch(one, one.repartition(3)).count() == 0
    other = one.withColumn("v", F.when(F.col("index").isin(4, 7), "no").otherwise(F.col("v")))
    assert dataset.reproduction_mismatch(one, other).collect() == [Row(index=4, side="differs")]
    rows = spark.createDataFrame([("a", "sc", {"answer": "p"}), ("b", None, {})], "instance_id string, scene_id string, prompt_variants map<string,string>")
    assert dataset.export_rows(rows.where("instance_id = 'a'"), "answer_only").first()["prompt"] == "p"
    with pytest.raises(Exception, match="without scene_id"):
        dataset.export_rows(rows, "answer").collect()
    many = spark.range(200).select(F.concat(F.lit("i"), "id").alias("instance_id"))
    digests = dataset.write_release(many, str(tmp_path / "one"), 4).collect()
    again = dataset.write_release(many.repartition(7), str(tmp_path / "two"), 4).collect()
    assert sorted(digests) == sorted(again) and sum(r["rows"] for r in digests) == 200


def test_record_files(spark, tmp_path):
    (tmp_path / "record_shard_0001.jsonl.zst").write_bytes(pack(['{"a":1}', "", '{"a":2}']))
    got = read_record_shards(spark, str(tmp_path)).orderBy("line_index").collect()
    assert [(r["shard_id"], r["line_index"], r["record"]) for r in got] == [("record_shard_0001", 0, '{"a":1}'), ("record_shard_0001", 1, '{"a":2}')]
    refs = with_record_refs(spark.range(50).select("id", F.concat(F.lit("r"), "id").alias("record")), ["id"], 4)
    assert refs.select("shard_id", "line_index").distinct().count() == 50
    assert pack_shards(refs).count() == refs.select("shard_id").distinct().count()
    assert read_jsonl(spark, str(tmp_path / "none"), "a bigint").count() == 0


def test_scene_source(spark):
    spark.dataSource.register(SceneSource)
    read = lambda parts: sorted(map(tuple, spark.read.format("scenes").option("instances", 20).option("seed", 3).option("partitions", parts).load().collect()))
    assert read(2) == read(7) and len({r[0] for r in read(2)}) == 20


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "log"))
    log = scores.read_log(spark, str(tmp_path / "log"))
    last = scores.run_to_memory(scores.curriculum(log), "curriculum_out", "update").groupBy("event_type").agg(F.max("tries").alias("tries"), F.max("wins").alias("wins"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, events.groupBy("event_type").agg(F.count("*"), F.count_if(F.col("value") > 20)).collect()))
    batch = {tuple(r) for r in scores.windowed(events).collect()}
    out = scores.run_to_memory(scores.windowed(scores.read_log(spark, str(tmp_path / "log"), 10)), "windows_out", "append")
    assert 0 < out.count() and {tuple(r) for r in out.select("start", "event_type", "n").collect()} <= {r[:3] for r in batch}


def test_joins(spark):
    rng = random.Random(1)
    a = [(i, *sorted((rng.uniform(-50, 50), rng.uniform(-50, 50)))) for i in range(40)]
    b = [(i, *sorted((rng.uniform(-50, 50), rng.uniform(-50, 50)))) for i in range(40)]
    left, right = spark.createDataFrame(a, "i int, a0 double, a1 double"), spark.createDataFrame(b, "j int, b0 double, b1 double")
    got = sorted((r["i"], r["j"]) for r in range_join(left, right, ("a0", "a1"), ("b0", "b1"), 7.0).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if max(x[1], y[1]) <= min(x[2], y[2]))
    t = spark.createDataFrame([("k", 1), ("k", 5), ("m", 2)], "k string, t int")
    v = spark.createDataFrame([("k", 1, "one"), ("k", 4, "four"), ("k", 9, "nine")], "k string, at int, v string")
    assert sorted((r["k"], r["t"], r["asof_v"]) for r in asof_join(t, v, ["k"], "t", "at", ["v"]).collect()) == [("k", 1, "one"), ("k", 5, "four"), ("m", 2, None)]
    pairs = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "i string, g int")
    assert [r["i"] for r in present_in_every(pairs, "i", "g").collect()] == ["x"]


def test_scalars(spark):
    lit = F.lit
    assert value(spark, scalar.gcd(lit(84), lit(-36))) == 12 and value(spark, scalar.gcd(lit(0), lit(5))) == 5
    assert [value(spark, scalar.option_letter(lit(i))) for i in (0, 25, 26)] == ["A", "Z", "Option27"]
    assert [value(spark, scalar.ordinal(lit(i))) for i in (1, 2, 3, 4, 11, 22, 113)] == ["1st", "2nd", "3rd", "4th", "11th", "22nd", "113th"]
    assert value(spark, scalar.clock_text(scalar.clock_add(lit(10), lit(-20)))) == "23:50" and value(spark, scalar.hand_angle(lit(180))) == 90.0
    white, black = scalar.lab(lit(255), lit(255), lit(255)), scalar.lab(lit(0), lit(0), lit(0))
    assert value(spark, scalar.color_distance(white, black)) == pytest.approx(100, abs=0.01)
    assert value(spark, scalar.rotate_left(F.array(lit(1), lit(2), lit(3)), 4)) == [2, 3, 1]
    assert value(spark, scalar.placeholders(lit("a {x} {y_1} {x}"))) == ["x", "y_1"]
    assert value(spark, scalar.shoelace(F.array(*map(lit, (0.0, 4.0, 4.0, 0.0))), F.array(*map(lit, (0.0, 0.0, 3.0, 3.0))))) == 12.0
    boxes = F.array(F.array(*map(lit, (1.0, 2.0, 3.0, 4.0))), F.array(*map(lit, (0.0, 3.0, 2.0, 9.0))))
    assert value(spark, scalar.bbox_union(boxes, 1.0)) == [-1.0, 1.0, 4.0, 10.0] and value(spark, scalar.bbox_union(F.slice(boxes, 1, 0))) == [0.0] * 4
    assert [value(spark, scalar.normalize_answer(lit(x))) for x in (" Red ", "7.0", "1.5", "nan")] == ["red", "7", "1.5", "nan"]


def test_boards(spark):
    longs = lambda v: F.array(*[F.lit(x).cast("long") for x in v])
    for line, want, score in (([2, 2, 2, 2], [4, 4, 0, 0], 8), ([0, 4, 0, 4], [8, 0, 0, 0], 8), ([2, 2, 4, 8], [4, 4, 8, 0], 4), ([2, 4, 2, 4], [2, 4, 2, 4], 0), ([0, 0, 0, 0], [0, 0, 0, 0], 0)):
        got = value(spark, slide(longs(line)))
        assert (got["line"], got["score"]) == (want, score)
    flags = lambda s: F.array(*[F.lit(c == "#") for c in s])
    assert [value(spark, run_lengths(flags(s))) for s in ("##.#", "....", "###")] == [[2, 1], [0], [3]]
    chain = lambda s: F.array(*map(F.lit, s))
    assert [value(spark, pop_run(chain(s), F.lit(p), F.lit("R"))) for s, p in (("RRGG", 1), ("RGRR", 2), ("GRRG", 2), ("GG", 1))] == [2, 2, 2, 0]
    cells = spark.createDataFrame([(0, r, c, int((r, c) in {(1, 0), (1, 1), (1, 2)})) for r in range(3) for c in range(3)], "g int, row int, col int, alive int")
    assert {(r["row"], r["col"]) for r in life_step(cells, ["g"]).where("alive = 1").collect()} == {(0, 1), (1, 1), (2, 1)}


def components(nodes, edges):
    forest = kernels.Forest()
    for n in nodes:
        forest.find(n)
    for a, b in edges:
        forest.join(a, b)
    return len({forest.find(n) for n in nodes})


def test_graph_kernels():
    rng = random.Random(3)
    for _ in range(40):
        nodes = range(rng.randrange(2, 8))
        edges = [(a, b, rng.randrange(1, 9)) for a, b in itertools.combinations(nodes, 2) if rng.random() < 0.5]
        if not edges:
            continue
        plain = [e[:2] for e in edges]
        used = sorted({n for e in plain for n in e})
        base = components(used, plain)
        bridges = sum(components(used, [e for e in plain if e != x]) > base for x in plain)
        joints = sum(components([n for n in used if n != v], [e for e in plain if v not in e]) > base for v in used)
        assert kernels.cut_counts(plain) == (bridges, joints)
        size = len(used) - base
        trees = [c for c in itertools.combinations(edges, size) if components(used, [e[:2] for e in c]) == base]
        assert kernels.spanning_forest(edges) == (min(sum(e[2] for e in t) for t in trees), size)
        source, sink = used[0], used[-1]
        inner = [n for n in used if n not in (source, sink)]
        cut = min(sum(w for a, b, w in edges if a in side and b not in side) for k in range(len(inner) + 1) for s in itertools.combinations(inner, k) for side in [{source, *s}])
        assert kernels.max_flow(edges, source, sink) == cut
        reach = {n: {n} for n in used}
        for _ in used:
            for a, b in plain:
                for n in used:
                    if a in reach[n]:
                        reach[n].add(b)
        assert kernels.strong_component_count(plain) == len({frozenset(m for m in used if m in reach[n] and n in reach[m]) for n in used})
    assert kernels.unique_topological_order([(1, 2), (2, 3), (1, 3)]) == [1, 2, 3]
    assert kernels.unique_topological_order([(1, 3), (2, 3)]) is None and kernels.unique_topological_order([(1, 2), (2, 1)]) is None
    assert kernels.cheapest_paths([(0, 1, 1), (1, 3, 1), (0, 2, 1), (2, 3, 1)], 0) == [(0, 0, 1), (1, 1, 1), (2, 1, 1), (3, 2, 2)]
    assert Fraction(6, 8) == Fraction(3, 4)
