"""Dataset pipeline: planning, seeding, identity, contracts, sanitising, validation, reproduction and export.

Everything is a DataFrame of instances; a rejected row is data (instance_id, error_code, detail), not an exception.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import placeholders, subseed
from ..verify.scoring import MATCHERS

SCALAR_ANNOTATIONS = ("bbox", "point", "segment")
PROMPT_VARIANTS = 5
INSTANCE_VERSIONS = ("v0",)
TASK_ID = r"^task_([a-z0-9]+(?:_[a-z0-9]+)*?)__([a-z0-9]+(?:_[a-z0-9]+)*)__([a-z0-9]+(?:_[a-z0-9]+)*)$"
#: Fields that an instance's identity is made of; paths and scene ids are not among them.
IDENTITY_FIELDS = ("instance_version", "instance_seed", "domain", "task", "query_id", "prompt", "image_hashes", "answer_type", "answer_value", "annotation_type", "annotation_value")


# Planning


def apportion(weights: DataFrame, total: int, key: str = "task_id", weight: str = "weight") -> DataFrame:
    """key, count: whole numbers that sum to total, in proportion to the positive weights; the largest remainders get one more, ties by key."""
    positive = weights.where(F.col(weight) > 0)
    share = F.col(weight) / F.sum(weight).over(Window.partitionBy()) * F.lit(total)
    floor = F.floor(F.round(share, 9))
    parts = positive.select(key, floor.alias("floor"), (share - floor).alias("part"))
    left = F.lit(total) - F.sum("floor").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc(F.round("part", 9)), key))
    return parts.select(key, (F.col("floor") + (rank <= left).cast("long")).alias("count"))


def equal_split(total: int, parts: int) -> int:
    """total / parts; the division must leave nothing."""
    if parts <= 0 or total % parts:
        raise ValueError(f"{total} can't be split into {parts} equal parts")
    return total // parts


def plan(counts: DataFrame, sampling_seed: int, key: str = "task_id") -> DataFrame:
    """A row per instance to make: task, index within it, and its seed."""
    rows = counts.where(F.col("count") > 0).select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("index"))
    return rows.withColumn("instance_seed", subseed(F.lit(sampling_seed), F.col(key), F.col("index")))


def weighted_choice(roll: Column, weights: dict[str, float]) -> Column:
    """The first key, in order, whose cumulative share reaches a roll in [0, 1); keys without weight never come, and no weight at all means equal ones."""
    positive = {k: w for k, w in sorted(weights.items()) if w > 0} or dict.fromkeys(sorted(weights), 1.0)
    total, upto, out = sum(positive.values()), 0.0, None
    for key, w in positive.items():
        upto += w / total
        out = F.when(roll <= upto, key) if out is None else out.when(roll <= upto, key)
    return out.otherwise(list(positive)[-1])


def roll(seed: Column, namespace: str) -> Column:
    """A number in [0, 1) of a seed and a namespace."""
    return subseed(seed, namespace, 0) / F.lit(float((1 << 53) - 1))


def choose(items: Column, seed: Column, namespace: str) -> Column:
    """One item of an array."""
    return F.element_at(items, (F.pmod(subseed(seed, namespace, 0), F.size(items)) + 1).cast("int"))


def shuffled(df: DataFrame, seed: int, keys: list[str]) -> DataFrame:
    """df in a seeded order that doesn't depend on partitions."""
    return df.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), *keys), 256), *keys)


# Identity


def instance_id(columns: dict[str, Column]) -> Column:
    """SHA-256 of the identity fields in canonical JSON (sorted keys)."""
    fields = F.to_json(F.struct(*[columns[f].alias(f) for f in sorted(IDENTITY_FIELDS)]), {"ignoreNullFields": "false"})
    return F.concat(F.lit("sha256:"), F.sha2(fields, 256))


def canonical_json(value: Any) -> str:
    """JSON with sorted keys and no spaces; only text keys, finite numbers and integers below 2**53."""

    def check(v: Any) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                if not isinstance(k, str):
                    raise ValueError("schema_non_string_key")
                check(x)
        elif isinstance(v, (list, tuple)):
            for x in v:
                check(x)
        elif isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))):
            raise ValueError("schema_non_finite_number")
        elif isinstance(v, int) and not isinstance(v, bool) and abs(v) >= 1 << 53:
            raise ValueError("schema_invalid_value")
        elif v is not None and not isinstance(v, (str, int, float, bool)):
            raise ValueError("schema_unsupported_type")

    check(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def first_difference(a: Any, b: Any, path: str = "$") -> str | None:
    """Path of the first place where two JSON values differ."""
    if type(a) is not type(b):
        return path
    if isinstance(a, dict):
        for k in sorted(a.keys() | b.keys()):
            if k not in a or k not in b:
                return f"{path}.{k}"
            if (found := first_difference(a[k], b[k], f"{path}.{k}")) is not None:
                return found
        return None
    if isinstance(a, list):
        for i, (x, y) in enumerate(zip(a, b, strict=False)):
            if (found := first_difference(x, y, f"{path}[{i}]")) is not None:
                return found
        return None if len(a) == len(b) else f"{path}[{min(len(a), len(b))}]"
    return None if a == b else path


# Contracts and annotations


def reward_contract(answer_type: Column, annotation_type: Column) -> Column:
    """The contract of a typed instance; null for unknown annotation types."""
    ids = F.create_map(*[F.lit(x) for kv in MATCHERS.items() for x in kv])
    matcher = F.try_element_at(ids, annotation_type)
    side = lambda i, t: F.struct(i.alias("id"), t.alias("type"))
    return F.when(matcher.isNotNull(), F.struct(F.lit("v0").alias("reward_contract_version"), side(F.lit("answer_exact_match_v0"), answer_type).alias("answer"), side(matcher, annotation_type).alias("annotation")))


def witness_summary(annotation_type: Column, items: Column) -> Column:
    """How many witnesses an annotation has; scalar types have one."""
    return F.when(annotation_type.isin(*SCALAR_ANNOTATIONS), 1).otherwise(F.size(items))


def is_source_key(key: str, denied: frozenset[str] = frozenset()) -> bool:
    """Keys that would leak how an answer came about."""
    return key in denied or (key != "image_id" and key.endswith(("_id", "_ids", "_labels", "_by_label")))


def sanitized(value: Any, denied: frozenset[str] = frozenset()) -> Any:
    if isinstance(value, dict):
        return {k: sanitized(v, denied) for k, v in value.items() if not is_source_key(k, denied)}
    return [sanitized(v, denied) for v in value] if isinstance(value, list) else value


def sanitize_json(column: Column, denied: frozenset[str] = frozenset()) -> Column:
    """JSON text without source keys at any depth; an Arrow-batched function, as the depth is open."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else json.dumps(sanitized(json.loads(t), denied), sort_keys=True))

    return run(column)


# Validation


def _errors(df: DataFrame, condition: Column, code: str, detail: Column | None = None) -> DataFrame:
    return df.where(condition).select("instance_id", F.lit(code).alias("error_code"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))


def validate(instances: DataFrame, records: DataFrame, tasks: DataFrame, requested: DataFrame) -> DataFrame:
    """instance_id, error_code, detail of all violations.

    instances: instance_id, instance_version, task, prompt_variants (map), answer_type, answer_value, annotation_type, image_path, image_hash,
    record_shard, record_line, own_record_hash. records: shard_id, line_index, record_hash. tasks: task. requested: task, count.
    """
    i = instances
    found = [_errors(i, F.col(c).isNull(), "schema_missing_field", F.lit(c)) for c in ("task", "answer_type", "answer_value", "annotation_type")]
    found.append(_errors(i, ~F.col("annotation_type").isin(*MATCHERS), "schema_unsupported_type", F.col("annotation_type")))
    found.append(_errors(i, ~F.col("instance_version").isin(*INSTANCE_VERSIONS), "version_unsupported_instance_version", F.col("instance_version")))
    versions = i.agg(F.count_distinct("instance_version").alias("versions"))
    found.append(versions.where("versions > 1").select(F.lit(None).cast("string").alias("instance_id"), F.lit("version_mixed_instance_version").alias("error_code"), F.col("versions").cast("string").alias("detail")))
    found.append(_errors(i, F.size("prompt_variants") != PROMPT_VARIANTS, "prompt_variant_count_mismatch", F.size("prompt_variants")))
    found.append(_errors(i, F.exists(F.map_values("prompt_variants"), lambda p: F.size(placeholders(p)) > 0), "prompt_unresolved_placeholder"))
    found.append(_errors(i, F.col("image_path").rlike(r"^(/|[A-Za-z]:|[a-z]+://)|(^|/)\.\.(/|$)"), "image_path_not_relative", F.col("image_path")))
    found.append(_errors(i, F.coalesce(F.col("image_hash"), F.lit("")) == "", "image_hash_missing"))
    known = tasks.select(F.col("task")).distinct()
    found.append(_errors(i.join(known, "task", "left_anti"), F.lit(True), "config_task_not_registered", F.col("task")))
    refs = i.join(records, (F.col("record_shard") == F.col("shard_id")) & (F.col("record_line") == F.col("line_index")), "left")
    found.append(_errors(refs, F.col("record_shard").isNull(), "record_ref_missing"))
    found.append(_errors(refs, F.col("record_shard").isNotNull() & F.col("shard_id").isNull(), "record_ref_not_found"))
    found.append(_errors(refs, F.col("own_record_hash") != F.col("record_hash"), "record_ref_hash_mismatch"))
    counts = i.groupBy("task").agg(F.count("*").alias("made")).join(requested, "task", "full")
    none = F.lit(None).cast("string").alias("instance_id")
    found.append(counts.where("coalesce(made, 0) < count").select(none, F.lit("count_per_task_shortfall").alias("error_code"), F.col("task").alias("detail")))
    found.append(counts.where("count IS NULL").select(none, F.lit("count_unexpected_task_present").alias("error_code"), F.col("task").alias("detail")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def reproduction_mismatch(one: DataFrame, other: DataFrame, index: str = "index") -> DataFrame:
    """The first row at which two builds differ (empty if none): index, and which side has it. Hashes of whole rows are joined, not rows."""
    names = sorted(c for c in one.columns if c != index)

    def hashed(df: DataFrame, name: str) -> DataFrame:
        return df.select(index, F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256).alias(name))

    both = hashed(one, "a").join(hashed(other, "b"), index, "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.orderBy(index).limit(1).select(index, F.when(F.col("b").isNull(), "first only").when(F.col("a").isNull(), "second only").otherwise("differs").alias("side"))


# Export


def export_rows(instances: DataFrame, prompt_variant: str) -> DataFrame:
    """Rows for training: prompt of the variant, answer, annotation, contract. A row without a scene id is an error."""
    if prompt_variant not in ("answer", "answer_only", "annotation", "answer_and_annotation"):
        raise ValueError(f"unknown prompt variant {prompt_variant}")
    scene = F.when(F.coalesce(F.col("scene_id"), F.lit("")) == "", F.raise_error(F.concat(F.lit("row without scene_id: "), F.col("instance_id")))).otherwise(F.col("scene_id"))
    variant = "answer" if prompt_variant == "answer_only" else prompt_variant
    return instances.withColumn("scene_id", scene).withColumn("prompt", F.try_element_at("prompt_variants", F.lit(variant)))


def write_release(rows: DataFrame, path: str, shards: int = 16, seed: int = 20260711, key: str = "instance_id") -> DataFrame:
    """Writes Parquet shards in a seeded order; returns shard, rows and a digest of the ids of each."""
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), key), 256)
    ordered = rows.withColumn("_order", order).repartitionByRange(shards, "_order").sortWithinPartitions("_order", key)
    ordered.withColumn("_shard", F.spark_partition_id()).write.partitionBy("_shard").mode("errorifexists").parquet(path)
    back = rows.sparkSession.read.parquet(path)
    return back.groupBy(F.col("_shard").alias("shard")).agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(key))), 256).alias("digest"))


def curriculum_index(instances: DataFrame) -> DataFrame:
    return instances.select("instance_id", "domain", "task", "scene_id", "query_id")


def empty_plan(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "task_id string, weight double")
