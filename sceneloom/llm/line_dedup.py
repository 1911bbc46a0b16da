"""Line dedup by content-defined chunks of lines (native: DataFrame functions only).

Every line is hashed; a rolling hash over a window of line hashes says where a chunk ends, so a cut depends on
the lines around it and on nothing before them, and the same passage is cut alike wherever it stands. Chunks of
several lines whose bytes occur in more than one document, or twice in one, stay once: in the document with the
smallest id, at their first place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_or_empty

WINDOW = 2
DIVISOR = 2
MIN_LINES = 2
_PRIME = 1_000_003
#: Columns that the operator adds; columns of docs with these names are replaced.
ADDED = ("_chunks", "_removed", "_removed_lines")


def line_hash(line: Column) -> Column:
    """32 bits of the line's MD5, as a long."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunks_of(text: Column, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """Array of the text's chunks, each the lines of a chunk joined by line feeds; joined by line feeds they are the text again."""

    def rolled(h: Column, end: Column) -> Column:
        value = F.lit(0).cast("long")
        for back in range(window - 1, -1, -1):
            value = (value * 31 + F.element_at(h, end - back)) % _PRIME
        return value

    def cut(lines: Column) -> Column:
        return let(F.transform(lines, line_hash), lambda h: ends(lines, h))

    def ends(lines: Column, h: Column) -> Column:
        n = F.size(h)
        at = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | F.when(i >= window, rolled(h, i) % divisor == 0).otherwise(F.lit(False)))
        return let(at, lambda e: F.transform(e, lambda end, k: join(lines, F.when(k == 0, F.lit(0)).otherwise(F.element_at(e, k)), end)))

    def join(lines: Column, before: Column, end: Column) -> Column:
        return F.array_join(F.slice(lines, before + 1, end - before), "\n")

    return let(F.split(text, "\n", -1), cut)


def _is_multi(chunk: Column, min_lines: int) -> Column:
    """min_lines or more lines that aren't blank."""
    return F.size(F.filter(F.split(chunk, "\n", -1), lambda x: F.trim(x) != "")) >= min_lines


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """All columns of docs with the text cleaned, and _chunks, _removed, _removed_lines.

    A null text stays null and removes nothing; an empty text stays empty. Rows repeated under one id count as one
    document: they keep the chunks that the id owns. Ids that are null own nothing that a row with an id has.
    Single lines and blank runs are never removed. Column names other than id_col and text_col may be anything.
    """
    cut = docs.select(docs[id_col].alias("_id"), F.explode(F.array_distinct(chunks_of(text_or_empty(docs, text_col), window, divisor))).alias("_c")).where(_is_multi(F.col("_c"), min_lines))
    # Grouping by the chunk itself compares bytes; partial aggregation makes one row per task of however many copies.
    owners = cut.groupBy("_c").agg(F.min("_id").alias("_owner"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.xxhash64("_c").alias("_h"), "_c", "_owner")
    slim = cut.select("_id", F.xxhash64("_c").alias("_h"))
    lost = slim.join(owners, "_h").where(~F.col("_id").eqNullSafe(F.col("_owner"))).groupBy("_id").agg(F.collect_set("_c").alias("_lost"))
    names = [c for c in docs.columns if c not in ADDED]
    whole = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], docs[id_col].alias("_key"))
    text = F.col(f"c{names.index(text_col)}")
    joined = whole.join(lost, F.col("_key").eqNullSafe(F.col("_id")), "left")
    lost_here = F.coalesce(F.col("_lost"), F.array().cast("array<string>"))

    def keep(chunks: Column) -> Column:
        """Chunks and lost chunks are sorted together, lost ones first: what has an equal before it goes, if it has several lines."""
        marked = F.concat(F.transform(lost_here, lambda c: F.struct(c.alias("c"), F.lit(-1).alias("i"))), F.transform(chunks, lambda c, i: F.struct(c.alias("c"), i.alias("i"))))

        def judged(s: Column) -> Column:
            again = F.transform(s, lambda e, k: F.struct(e["i"].alias("i"), e["c"].alias("c"), F.when(k == 0, False).otherwise(F.element_at(s, F.greatest(k, F.lit(1)))["c"] == e["c"]).alias("again")))
            stay = F.filter(again, lambda e: (e["i"] >= 0) & ~F.when(e["again"], _is_multi(e["c"], min_lines)).otherwise(F.lit(False)))
            return F.transform(F.sort_array(stay), lambda e: e["c"])

        untouched = (F.size(lost_here) == 0) & (F.size(F.array_distinct(chunks)) == F.size(chunks))
        return F.when(untouched, chunks).otherwise(let(F.sort_array(marked), judged))

    parts = let(chunks_of(F.coalesce(text, F.lit("")), window, divisor), lambda c: F.struct(F.size(c).alias("n"), keep(c).alias("kept")))
    out = joined.withColumn("_p", parts)
    clean = F.when(text.isNull(), text).otherwise(F.array_join("_p.kept", "\n"))
    lines_in = F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1))
    lines_out = F.when(F.size("_p.kept") == 0, F.lit(0)).otherwise(F.size(F.split(F.array_join("_p.kept", "\n"), "\n", -1)))
    return out.select(
        *[(clean if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)],
        F.col("_p.n").cast("long").alias("_chunks"),
        (F.col("_p.n") - F.size("_p.kept")).cast("long").alias("_removed"),
        (lines_in - lines_out).cast("long").alias("_removed_lines"),
    )
