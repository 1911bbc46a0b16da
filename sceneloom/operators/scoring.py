"""Scoring programs over synthetic responses made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import normalize_answer
from ..registry import query, table
from ..verify.scoring import compose_column, half_life_column, iou_column, point_column, score_responses


@query(
    "score_answer_exact",
    "P28",
    ("matching",),
    "SELECT event_type, count(*) FILTER (WHERE lower(trim(' ' || CAST(json_extract(props, '$.k') AS VARCHAR) || '  ')) = CAST(event_id % 97 AS VARCHAR)) AS n_right, count(*) AS n FROM events GROUP BY event_type",
)
def score_answer_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact answers after normalisation: padded text against integers."""
    said = normalize_answer(F.concat(F.lit(" "), F.get_json_object("props", "$.k"), F.lit("  ")))
    right = said == normalize_answer(F.pmod("event_id", F.lit(97)).cast("string"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(right).alias("n_right"), F.count("*").alias("n"))


@query(
    "score_bbox_iou",
    "P31",
    ("spatial_relations", "formula_evaluation"),
    "WITH b AS (SELECT event_id, user_id * 1.0 AS a0, user_id + 40.0 AS a1, event_id % 100 * 1.0 AS b0, event_id % 100 + 30.0 AS b1 FROM events), c AS (SELECT *, greatest(0, least(a1, b1) - greatest(a0, b0)) * greatest(0, least(10.0, 15.0) - greatest(0.0, 5.0)) AS common FROM b) SELECT event_id, round(common / ((a1 - a0) * 10 + (b1 - b0) * 10 - common), 6)::DOUBLE AS iou FROM c",
)
def score_bbox_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IoU of predicted and true boxes; the predicted corners come reversed."""
    e = table(spark, sf_dir, "events")
    user, at = F.col("user_id").cast("double"), F.pmod("event_id", F.lit(100)).cast("double")
    a = F.array(user + 40, F.lit(10.0), user, F.lit(0.0))
    b = F.array(at, F.lit(5.0), at + 30, F.lit(15.0))
    return e.select("event_id", F.round(iou_column(a, b), 6).alias("iou"))


@query(
    "score_point_soft",
    "P31",
    ("spatial_relations", "formula_evaluation"),
    "WITH p AS (SELECT event_id, sqrt(power(user_id - event_id % 150, 2) + power(value - 20, 2)) AS d, greatest(20.0, least(80.0, 0.035 * sqrt(power(640 + user_id, 2) + power(480, 2)))) AS h FROM events) SELECT event_id, round(exp(-ln(2) * (d / h) * (d / h)), 6) AS similarity, round(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END * (0.5 + 0.5 * exp(-ln(2) * (d / h) * (d / h))), 6) AS reward FROM p",
)
def score_point_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft point distance with the half-life of the image, and the gated reward."""
    e = table(spark, sf_dir, "events")
    half = half_life_column(F.col("user_id") + 640.0, F.lit(480.0))
    s = point_column(F.array(F.col("user_id").cast("double"), F.col("value")), F.array(F.pmod("event_id", F.lit(150)).cast("double"), F.lit(20.0)), half)
    right = (F.col("event_id") % 3 == 0).cast("double")
    return e.select("event_id", F.round(s, 6).alias("similarity"), F.round(compose_column(right, s), 6).alias("reward"))


@query(
    "format_check",
    "P29",
    ("filtering",),
    "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_id % 4 = 0) AS formatted, count(*) FILTER (WHERE event_id % 4 <> 2) AS readable FROM events GROUP BY event_type",
)
def format_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses in four forms: proper, with text behind, without an object, with an extra key."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    kind = F.pmod("event_id", F.lit(4))
    body = F.concat(F.lit('so {"answer": '), k, F.lit("}"))
    response = F.when(kind == 0, body).when(kind == 1, F.concat(body, F.lit(" done"))).when(kind == 2, F.lit("no idea at all")).otherwise(F.concat(F.lit('{"why": 1, "answer": '), k, F.lit("}")))
    rows = e.select("event_type", response.alias("response"), F.concat(F.lit('{"type": "integer", "value": '), k, F.lit("}")).alias("answer_gt"), F.lit(None).cast("string").alias("annotation_gt"), F.lit("{}").alias("reward_contract"))
    s = score_responses(rows)
    return s.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("score.format") == 1).alias("formatted"), F.count_if(F.col("score.accuracy") == 1).alias("readable"))
