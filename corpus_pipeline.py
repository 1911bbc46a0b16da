"""From raw documents to token ids: language ID, line dedup, n-gram Jaccard join, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return
the columns of docs. The models and statistics of a stage come from its own input.
"""

from __future__ import annotations

from public_tokenizers import PATTERN
from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom.llm.byte_bpe import encode_documents
from sceneloom.llm.common import documents, staged
from sceneloom.llm.jaccard_join import similar_components
from sceneloom.llm.language_id import keep_identified, train
from sceneloom.llm.line_dedup import dedup_lines
from sceneloom.llm.mixing import plan_mix

#: The near-duplicate stage: words per shingle, and percent of the union that two documents share.
SHINGLE_WORDS = 5
SIMILARITY = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those that no learned language claims."""
    return keep_identified(docs, train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of several lines that stand in another document or earlier in the same; every document stays, with n_chars as it is now."""
    clean = dedup_lines(docs)
    new = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return clean.withColumns(new).select(docs.columns) if new else clean.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest id stays. Rows without an id stay."""
    groups = similar_components(docs, SHINGLE_WORDS, SIMILARITY)
    dropped = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. Rows that share an id are taken alike."""
    times = plan_mix(docs).groupBy("doc_id").agg(F.max("times").alias("times")).where("times > 0").select(F.col("doc_id").alias("_id"), "times")
    taken = docs.join(times, docs["doc_id"].eqNullSafe(times["_id"]))
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_time")).select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, and the digest of what they decode to."""
    return encode_documents(docs, tokenizer_path("byte_bpe_50k.tiktoken"), PATTERN)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mix_sources),
    ("byte-level BPE", byte_bpe),
]

#: The language model and the mix's dynamic program aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written and read again before the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
