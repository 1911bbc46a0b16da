"""Document fingerprints: canonical exact digests (native: DataFrame functions only).

The canonical form is the text in Unicode NFKC, lower case, with each run of white space made one space and none at
the ends. Two xxhash64 values with different prefixes give 128 bits. Rows with equal digests are held against each
other byte by byte: grouping by digest and canonical text finds digests that stand for several texts, and these
get an ordinal appended, so that fingerprints are equal exactly where canonical texts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_or_empty

NEXT_BUCKETS = 256


def canonical(text: Column) -> Column:
    """NFKC by the ICU classes that come with Spark, then lower case, then white space folded."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.trim(F.regexp_replace(F.lower(composed), r"[\s\x{85}\x{A0}\p{Z}]+", " "))


def digest(canon: Column) -> Column:
    """128 bits as 32 hex digits."""
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), canon)), 16, "0")
    return F.lower(F.concat(half(1), half(2)))


def with_fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of text_col; null counts as empty. A column named as out is replaced."""
    names = [c for c in docs.columns if c != out]
    base = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], canonical(text_or_empty(docs, text_col)).alias("_canon"))
    base = base.withColumn("_fp", digest(F.col("_canon")))
    clash = ordinals(base.select("_fp", "_canon"))
    joined = base.withColumn("_sha", F.sha2("_canon", 256)).join(clash, ["_fp", "_sha"], "left")
    return joined.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], named(F.col("_fp"), F.col("_ordinal")).alias(out))


def ordinals(digests: DataFrame) -> DataFrame:
    """_fp, _sha, _ordinal of the canonical texts (_canon) whose digest (_fp) another text has too; nearly always empty."""
    texts = digests.groupBy("_fp", "_canon").agg(F.count(F.lit(1)).alias("_n")).select("_fp", F.sha2("_canon", 256).alias("_sha"))
    several = texts.groupBy("_fp").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("_fp")
    return texts.join(several, "_fp", "left_semi").select("_fp", "_sha", (F.row_number().over(Window.partitionBy("_fp").orderBy("_sha")) - 1).alias("_ordinal"))


def named(fp: Column, ordinal: Column) -> Column:
    return F.when(F.coalesce(ordinal, F.lit(0)) == 0, fp).otherwise(F.concat(fp, F.lit("-"), ordinal.cast("string")))


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = NEXT_BUCKETS) -> DataFrame:
    """doc_id, text and next_text: the text of the next document by id, of the first after the last.

    Ids are dealt to ranges that begin at ids of the table, and the first row of a range also goes, as a sentinel, to
    the range before it; so a window inside each range sees every successor and no task sees all rows. Null ids come first.
    Rows repeated under one id follow each other, ordered by text; with a single row that row is its own next.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs, text_col).alias("text"))
    fractions = [i / buckets for i in range(1, buckets)]
    found = rows.agg(F.percentile_approx("doc_id", fractions, 100 * buckets).alias("cuts"), F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    first = None if found["nulls"] else found["first"]
    cuts = sorted({c for c in found["cuts"] or [] if found["nulls"] or c != first})
    starts = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.size(F.filter(starts, lambda c: c <= F.col("doc_id"))))
    is_start = F.col("doc_id").isin(cuts) if cuts else F.lit(False)
    is_first = F.col("doc_id").eqNullSafe(F.lit(first))
    homes = F.array_compact(F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("turn")), F.when(is_start, F.struct((F.col("_b") - 1).alias("b"), F.lit(1).alias("turn"))), F.when(is_first, F.struct(F.lit(len(cuts)).alias("b"), F.lit(2).alias("turn")))))
    dealt = rows.withColumn("_b", bucket.cast("int")).select("doc_id", "text", F.explode(homes).alias("_h")).select("doc_id", "text", F.col("_h.b").alias("_b"), F.col("_h.turn").alias("_turn"))
    order = Window.partitionBy("_b").orderBy("_turn", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("_turn = 0").select("doc_id", "text", "next_text")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has its last n // 4 code points replaced by as many first ones of the next text (or by all of it).
    The digest is exact, so a likeness is 1 where canonical bytes are equal and else 0. Nulls count as empty.
    """
    rows = with_next_text(docs, id_col, text_col)
    n, k = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = rows.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - k), F.col("next_text").substr(F.lit(1), k)))
    canon = edited.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        canonical(F.col("text")).alias("own"),
        canonical(F.col("edited")).alias("other"),
        canonical(F.col("next_text")).alias("next"),
    )
    table = staged(
        canon.select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            digest(F.col("own")).alias("_fp"),
            F.sha2("own", 256).alias("_sha"),
            digest(F.col("other")).alias("_other"),
            (F.col("own") == F.col("other")).alias("_same"),
            (F.col("own") == F.col("next")).alias("_next"),
        ),
        "fingerprints",
    )
    own = docs.select(canonical(text_or_empty(docs, text_col)).alias("_canon")).select("_canon", digest(F.col("_canon")).alias("_fp"))
    joined = table.join(ordinals(own), ["_fp", "_sha"], "left")
    fingerprint = named(F.col("_fp"), F.col("_ordinal"))
    return joined.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint.alias("fingerprint"),
        F.when(F.col("_same"), fingerprint).when(F.col("_other") == F.col("_fp"), F.concat(F.col("_other"), F.lit("-x"))).otherwise(F.col("_other")).alias("edited_fingerprint"),
        F.col("_same").cast("double").alias("near_edited"),
        F.col("_next").cast("double").alias("near_next"),
    )
