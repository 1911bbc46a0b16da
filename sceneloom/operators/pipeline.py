"""Dataset programs over the driver's tables: apportionment, seeds, counts, duplicates, task ids, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import placeholders, subseed
from ..plans.dataset import TASK_ID, apportion, plan
from ..registry import query, table


@query(
    "apportion_weighted",
    "P10+P14",
    ("ranking", "formula_evaluation"),
    "WITH w AS (SELECT source, count(*) AS weight FROM documents GROUP BY source), s AS (SELECT source, weight * 777.0::DOUBLE / sum(weight) OVER () AS share FROM w), f AS (SELECT source, floor(round(share, 9)) AS fl, round(share - floor(round(share, 9)), 9) AS part FROM s), r AS (SELECT *, row_number() OVER (ORDER BY part DESC, source) AS k, 777 - sum(fl) OVER () AS rest FROM f) SELECT source, CAST(fl + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS count FROM r",
)
def apportion_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """777 rows shared among the sources by their sizes: largest remainders, ties by name."""
    w = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("weight"))
    return apportion(w, 777, "source")


@query(
    "plan_seed_hash",
    "P27",
    ("formula_evaluation",),
    "SELECT p_type, i AS index, ('0x' || substr(sha256('42|v0|' || p_type || '|' || i), 1, 15))::BIGINT % 9007199254740991 AS instance_seed FROM (SELECT DISTINCT p_type FROM part) CROSS JOIN (SELECT unnest(range(20)) AS i)",
)
def plan_seed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of a plan of 20 instances for each type."""
    counts = table(spark, sf_dir, "part").select("p_type").distinct().withColumn("count", F.lit(20).cast("long"))
    return plan(counts, 42, "p_type")


@query(
    "validate_counts",
    "P29+P06",
    ("comparison", "counting"),
    "WITH made AS (SELECT source AS task, count(*) AS made FROM documents GROUP BY source), req AS (SELECT 'src' || i AS task, CAST(40 + i AS BIGINT) AS count FROM range(22) t(i)) SELECT coalesce(m.task, r.task) AS task, CASE WHEN r.count IS NULL THEN 'count_unexpected_task_present' ELSE 'count_per_task_shortfall' END AS error_code FROM made m FULL JOIN req r ON m.task = r.task WHERE r.count IS NULL OR coalesce(made, 0) < r.count",
)
def validate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested against made."""
    made = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("task")).agg(F.count("*").alias("made"))
    requested = spark.range(22).select(F.concat(F.lit("src"), F.col("id")).alias("task"), (F.col("id") + 40).alias("count"))
    both = made.join(requested, "task", "full").where("count IS NULL OR coalesce(made, 0) < count")
    return both.select("task", F.when(F.col("count").isNull(), "count_unexpected_task_present").otherwise("count_per_task_shortfall").alias("error_code"))


@query("dedupe_instances", "P09", ("filtering",), "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def dedupe_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances with one identity: the first stays."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("id")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1").select("doc_id", "copies")


@query(
    "identity_order_check",
    "P29+P19",
    ("comparison",),
    "WITH h AS (SELECT doc_id, sha256(concat_ws('|', lang, source, n_chars)) AS h FROM documents) SELECT count(*) AS n_inversions FROM (SELECT doc_id, lag(h) OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) > h AS inv FROM h) WHERE inv",
)
def identity_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that stand before their predecessor in the order of ids, shard by shard."""
    h = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws("|", "lang", "source", "n_chars"), 256).alias("h"))
    w = Window.partitionBy(F.floor(F.col("doc_id") / 100)).orderBy("doc_id")
    return h.select((F.lag("h").over(w) > F.col("h")).alias("inv")).where("inv").agg(F.count("*").alias("n_inversions"))


@query(
    "task_id_parse",
    "P36",
    ("direct_retrieval", "filtering"),
    "WITH t AS (SELECT DISTINCT 'task_' || lower(p_type) || '__' || lower(replace(p_brand, '#', '_')) || CASE WHEN p_size % 5 = 0 THEN '_x' ELSE '__size_' || p_size END AS id FROM part) SELECT regexp_extract(id, '^task_([a-z0-9_]+?)__([a-z0-9_]+?)__([a-z0-9_]+)$', 1) AS domain, count(*) AS n FROM t WHERE regexp_matches(id, '^task_[a-z0-9]+__[a-z0-9_]+__[a-z0-9_]+$') GROUP BY 1",
)
def task_id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of the ids that obey the grammar."""
    tail = F.when(F.col("p_size") % 5 == 0, "_x").otherwise(F.concat(F.lit("__size_"), F.col("p_size")))
    t = table(spark, sf_dir, "part").select(F.concat(F.lit("task_"), F.lower("p_type"), F.lit("__"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), tail).alias("id")).distinct()
    return t.where(F.col("id").rlike(TASK_ID)).groupBy(F.regexp_extract("id", TASK_ID, 1).alias("domain")).agg(F.count("*").alias("n"))


@query(
    "prompt_slots",
    "P29",
    ("filtering",),
    "WITH p AS (SELECT event_id, 'count {' || event_type || '} for user {user}' || CASE WHEN event_id % 3 = 0 THEN ' in {ghost}' ELSE '' END AS t FROM events) SELECT slot, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, '\\{([A-Za-z_][A-Za-z0-9_]*)\\}', 1)) AS slot FROM p) GROUP BY slot",
)
def prompt_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots that prompts name."""
    t = F.concat(F.lit("count {"), F.col("event_type"), F.lit("} for user {user}"), F.when(F.col("event_id") % 3 == 0, " in {ghost}").otherwise(""))
    return table(spark, sf_dir, "events").select(F.explode(placeholders(t)).alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))


@query(
    "label_mismatch",
    "P29",
    ("comparison", "matching"),
    "SELECT lang, count(*) FILTER (WHERE quality IS NULL) AS unlabelled, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS contradictory, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
)
def label_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances without a label, and those whose two labels contradict each other."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg(F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("contradictory"), F.count("*").alias("n"))


@query(
    "seeded_split",
    "P10",
    ("filtering",),
    "SELECT split, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id, CASE WHEN ('0x' || substr(sha256('7|v0|split|' || doc_id), 1, 15))::BIGINT % 9007199254740991 % 33 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents) GROUP BY split",
)
def seeded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split that depends on seed and id only, whatever the partitions."""
    part = F.when(subseed(F.lit(7), "split", F.col("doc_id")) % 33 == 0, "validation").otherwise("train")
    return table(spark, sf_dir, "documents").groupBy(part.alias("split")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))
