"""The contract queries, opN_<name>: each applies its operator to the whole of its table and derives the columns of the contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from public_tokenizers import PATTERN
from public_tokenizers import path as tokenizer_path

from .byte_bpe import encode_digests
from .common import documents
from .exact_dedup import dedup_exact
from .fingerprints import compare_with_edits
from .jaccard_join import similar_components
from .language_id import predict_languages
from .line_dedup import dedup_lines
from .mixing import plan_mix
from .sharding import shard_by_bytes
from .substring_dedup import repeated_passages
from .token_files import read_token_files, write_token_files


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: chunks in all, chunks and lines removed, size and digest of the cleaned text."""
    clean = dedup_lines(documents(spark, sf_dir))
    return clean.select(
        "doc_id",
        F.col("_chunks").alias("n_chunks"),
        F.col("_removed").alias("removed_chunks"),
        F.col("_removed_lines").alias("removed_lines"),
        F.length("text").cast("long").alias("clean_chars"),
        F.sha2("text", 256).alias("clean_sha256"),
    )


OP1_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
hashed AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h,
         count(*) OVER (PARTITION BY doc_id) AS n FROM lines),
cuts AS (
  SELECT *, CASE WHEN i = n THEN 1
                 WHEN i >= 2 AND (((lag(h) OVER w) % 1000003) * 31 + h) % 1000003 % 2 = 0 THEN 1 ELSE 0 END AS is_end
  FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (
  SELECT *, coalesce(sum(is_end) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM cuts),
chunks AS (
  SELECT doc_id, k, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n_lines,
         count(*) FILTER (WHERE trim(line) <> '') AS solid
  FROM numbered GROUP BY doc_id, k),
judged AS (
  SELECT *, solid >= 2 AND (min(doc_id) OVER (PARTITION BY chunk) <> doc_id
                            OR row_number() OVER (PARTITION BY doc_id, chunk ORDER BY k) > 1) AS gone
  FROM chunks),
clean AS (
  SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (WHERE gone) AS removed_chunks,
         CAST(coalesce(sum(n_lines) FILTER (WHERE gone), 0) AS BIGINT) AS removed_lines,
         coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS t
  FROM judged GROUP BY doc_id)
SELECT doc_id, n_chunks, removed_chunks, removed_lines, CAST(length(t) AS BIGINT) AS clean_chars, sha256(t) AS clean_sha256 FROM clean
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document stays of those whose texts are equal without white space."""
    return dedup_exact(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM k
"""


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the documents whose sets of 4-word shingles overlap by 85 %."""
    return similar_components(documents(spark, sf_dir), k=4, percent=85)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand in two documents, exactly or nearly."""
    return repeated_passages(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the folds that aren't held out."""
    return predict_languages(documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Documents as read back from the wavelet matrix files that hold their ids."""
    files = write_token_files(documents(spark, sf_dir), vocabulary or tokenizer_path("word_bpe_49k.json"))
    return read_token_files(files)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return plan_mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Digests of the ids of every document and of what they decode to."""
    return encode_digests(documents(spark, sf_dir), vocabulary or tokenizer_path("byte_bpe_50k.tiktoken"), PATTERN)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of nearly equal bytes; equal texts never part."""
    return shard_by_bytes(documents(spark, sf_dir), shards=8)


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses."""
    return compare_with_edits(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_language_id": op5_language_id,
    "op6_token_files": op6_token_files,
    "op7_mixing": op7_mixing,
    "op8_sharding": op8_sharding,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_byte_bpe": op10_byte_bpe,
}

ORACLES: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op2_exact_dedup": OP2_SQL}
