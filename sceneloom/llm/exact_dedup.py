"""Exact dedup by composable polynomial fingerprints.

A text, without its white space, is cut into chunks of CHUNK bytes. Each chunk has a polynomial hash over two primes,
and hashes combine by length-shifted arithmetic: fp(a + b) = fp(a) * BASE**len(b) + fp(b), so the chunks of a huge
document can be hashed apart, in any grouping, and combined in order. Rows with equal fingerprints are then held
against each other chunk by chunk: the rows of a group are exploded to chunks and grouped by (group, chunk number,
chunk bytes), where partial aggregation makes one row per task of however many copies. A group that turns out to
hold different texts is split by their SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, staged, text_or_empty

CHUNK = 1 << 14
BASE = 1_000_003
PRIMES = (2_147_483_647, 2_147_483_629)
_DELETE = SPACES.encode()
_SCHEMA = "doc_id bigint, n_chars bigint, n_bytes bigint, fp1 bigint, fp2 bigint, text_sha256 string"


def _powers() -> list[np.ndarray]:
    """BASE**i modulo each prime, for i below CHUNK, highest power first."""
    tables = []
    for p in PRIMES:
        column, value = np.empty(CHUNK, np.uint64), 1
        for i in range(CHUNK):
            column[CHUNK - 1 - i] = value
            value = value * BASE % p
        tables.append(column)
    return tables


_tables: list[np.ndarray] = []


def chunk_hash(data: bytes) -> tuple[int, ...]:
    """Polynomial hash of up to CHUNK bytes; each byte counts one more than its value, so leading zeros count."""
    if not _tables:
        _tables.extend(_powers())
    values = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    # A product is below 2**40 and there are at most 2**14 of them.
    return tuple(int((values * t[CHUNK - len(values) :]).sum() % np.uint64(p)) for t, p in zip(_tables, PRIMES, strict=True))


def combine(left: tuple[tuple[int, ...], int], right: tuple[tuple[int, ...], int]) -> tuple[tuple[int, ...], int]:
    """(hash, length) of the concatenation; associative, with ((0, 0), 0) as its neutral element."""
    (a, m), (b, n) = left, right
    return tuple((x * pow(BASE, n, p) + y) % p for x, y, p in zip(a, b, PRIMES, strict=True)), m + n


def fingerprint(data: bytes) -> tuple[int, ...]:
    total: tuple[tuple[int, ...], int] = ((0, 0), 0)
    for at in range(0, len(data), CHUNK):
        piece = data[at : at + CHUNK]
        total = combine(total, (chunk_hash(piece), len(piece)))
    return total[0]


def normalized(text: str) -> bytes:
    return text.encode().translate(None, _DELETE)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bytes_, fp1, fp2, sha = [], [], [], []
        for value in batch.column("text"):
            data = value.as_buffer().to_pybytes().translate(None, _DELETE)
            a, b = fingerprint(data)
            bytes_.append(len(data))
            fp1.append(a)
            fp2.append(b)
            sha.append(hashlib.sha256(data).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_chars"), pa.array(bytes_, pa.int64()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()), pa.array(sha, pa.string())],
            names=["doc_id", "n_chars", "n_bytes", "fp1", "fp2", "text_sha256"],
        )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, chunk number, bytes) of every row, a few megabytes at a time."""
    names = ["fp1", "fp2", "n_bytes", "chunk_no", "chunk"]
    for batch in batches:
        rows: list[tuple] = []
        held = 0
        for value, *group in zip(batch.column("text"), *(batch.column(c).to_pylist() for c in names[:3]), strict=True):
            data = value.as_buffer().to_pybytes().translate(None, _DELETE)
            for no, at in enumerate(range(0, max(len(data), 1), CHUNK)):
                rows.append((*group, no, data[at : at + CHUNK]))
                held += CHUNK
                if held > 1 << 26:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
                    rows, held = [], 0
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chars for every row.

    Of rows whose texts are equal without white space, the one with the most code points stays, then the smallest
    id; null ids come last. Rows repeated under one id stay or go together. Null texts count as empty, and empty texts
    are copies of each other. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.length(text_or_empty(docs, text_col)).cast("long").alias("n_chars"), text_or_empty(docs, text_col).alias("text"))
    prints = staged(rows.mapInArrow(_fingerprints, _SCHEMA), "exact-prints")
    key = ["fp1", "fp2", "n_bytes"]
    several = prints.groupBy(key).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = prints.join(several, key, "left_semi").select("doc_id", "n_chars", *key).distinct()
    texts = docs.select(docs[id_col].cast("long").alias("_id"), F.length(text_or_empty(docs, text_col)).cast("long").alias("_n"), text_or_empty(docs, text_col).alias("text"))
    # The length keeps rows without an id from meeting each other all.
    suspects = texts.join(members, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_n") == F.col("n_chars"))).select("text", *key)
    chunks = suspects.mapInArrow(_chunks, "fp1 bigint, fp2 bigint, n_bytes bigint, chunk_no bigint, chunk binary")
    distinct = chunks.groupBy(*key, "chunk_no", "chunk").agg(F.count(F.lit(1)).alias("n"))
    unequal = distinct.groupBy(*key, "chunk_no").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select(key).distinct().withColumn("part", F.lit(True))
    # Groups whose chunks differ are told apart by SHA-256; all others keep one class for the whole fingerprint.
    classed = prints.join(unequal, key, "left").withColumn("part", F.when(F.col("part"), F.col("text_sha256")).otherwise(F.lit("")))
    key = [*key, "part"]
    # Two aggregates of longs, which need no sort: most code points, then the smallest id among these.
    best_chars = classed.groupBy(key).agg(F.max("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("group_size"))
    best_id = classed.groupBy(*key, "n_chars").agg(F.min("doc_id").alias("keep_id"))
    best = best_chars.join(best_id, [*key, "n_chars"]).withColumnRenamed("n_chars", "best_chars")
    return (
        classed.join(best, key)
        .withColumn("first", (F.col("n_chars") == F.col("best_chars")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .select("doc_id", "keep_id", "group_size", F.col("first").alias("kept"), "text_sha256", "n_chars")
    )
