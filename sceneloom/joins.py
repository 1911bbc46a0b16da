"""Joins that Spark has no operator for: range, as-of and division. All are equi-joins, so they shuffle by key and never compare all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, left_range: tuple[str, str], right_range: tuple[str, str], width: float, on: list[str] | None = None) -> DataFrame:
    """Inner join of rows whose closed intervals overlap (and whose `on` columns are equal), by buckets of `width`.

    Both sides are exploded to the buckets that they touch and joined by bucket. Each pair is kept in one bucket only,
    that of the later of the two starts, so no pair repeats. Rows with null ends or end before start join nothing.
    Column names of both sides must differ except for `on`.
    """
    on = on or []

    def dealt(df: DataFrame, lo: str, hi: str) -> DataFrame:
        first, last = F.floor(F.col(lo) / F.lit(width)).cast("long"), F.floor(F.col(hi) / F.lit(width)).cast("long")
        return df.where(F.col(lo) <= F.col(hi)).withColumn("_bucket", F.explode(F.sequence(first, last)))

    joined = dealt(left, *left_range).join(dealt(right, *right_range), [*on, "_bucket"])
    later = F.greatest(F.col(left_range[0]), F.col(right_range[0]))
    overlap = later <= F.least(F.col(left_range[1]), F.col(right_range[1]))
    return joined.where(overlap & (F.floor(later / F.lit(width)).cast("long") == F.col("_bucket"))).drop("_bucket")


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str], prefix: str = "asof_") -> DataFrame:
    """Each left row with the values of the last right row at or before its time: a union, one sort by key, and last non-null."""
    payload = F.struct(F.col(right_time).alias("_t"), *[F.col(v) for v in values])
    empty = F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType)
    names = [c for c in left.columns if c not in on]
    a = left.select(*on, F.col(left_time).alias("_at"), F.lit(1).alias("_side"), empty.alias("_p"), F.struct(*names).alias("_row"))
    b = right.select(*on, F.col(right_time).alias("_at"), F.lit(0).alias("_side"), payload.alias("_p"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(*on).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_p", F.last("_p", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*on, *[F.col(f"_row.{c}").alias(c) for c in names], *[F.col(f"_p.{v}").alias(prefix + v) for v in values])


def present_in_every(df: DataFrame, item: str, group: str) -> DataFrame:
    """Relational division: items that occur in every group. One aggregate of the pairs, and one row of the group count."""
    total = df.agg(F.count_distinct(group).alias("_all"))
    held = df.groupBy(item).agg(F.count_distinct(group).alias("_n"))
    return held.join(F.broadcast(total), F.col("_n") == F.col("_all")).select(item)


def overlapping_pairs(intervals: DataFrame, lo: str, hi: str, on: list[str]) -> DataFrame:
    """on, pairs: how many pairs of closed intervals overlap within each key, without forming any.

    For each interval the starts up to its end are counted by one running sum over starts and ends in order. Over all
    intervals that is every interval itself, each disjoint pair once and each overlapping pair twice.
    """
    ends = intervals.where(F.col(lo) <= F.col(hi)).select(*on, F.explode(F.array(F.struct(F.col(lo).alias("at"), F.lit(0).alias("end")), F.struct(F.col(hi).alias("at"), F.lit(1).alias("end")))).alias("e"))
    w = Window.partitionBy(*on).orderBy("e.at", "e.end").rowsBetween(Window.unboundedPreceding, 0)
    seen = ends.withColumn("starts", F.sum(F.lit(1) - F.col("e.end")).over(w)).where("e.end = 1")
    n = F.count("*")
    return seen.groupBy(*on).agg((F.sum("starts") - n - F.floor(n * (n - 1) / 2)).alias("pairs")).where("pairs > 0")


def overlap_counts(points: DataFrame, intervals: DataFrame, key: str, point_range: tuple[str, str], range_: tuple[str, str], width: float) -> DataFrame:
    """key, n: how many closed intervals overlap each row's closed interval, without forming pairs.

    n is the number of starts up to the row's end less that of ends before its start. Both come from running sums within
    buckets of `width` and one over the buckets' totals. Intervals whose end lies before their start count nowhere.
    """
    (a, b), (lo, hi) = point_range, range_
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    name = F.lit(None).cast(points.schema[key].dataType)

    def row(at: str, order: int, starts: Column, ends: Column, sign: int, owner: Column) -> Column:
        return F.struct(F.col(at).cast("double").alias("at"), F.lit(order).alias("order"), starts.alias("starts"), ends.alias("ends"), F.lit(sign).alias("sign"), owner.alias("key"))

    marks = intervals.where(F.col(lo) <= F.col(hi)).select(F.explode(F.array(row(lo, 0, one, none, 0, name), row(hi, 2, none, one, 0, name))).alias("r"))
    asked = points.where(F.col(a) <= F.col(b)).select(F.explode(F.array(row(b, 1, none, none, 1, F.col(key)), row(a, 1, none, none, -1, F.col(key)))).alias("r"))
    rows = marks.union(asked).select("r.*").withColumn("bucket", F.floor(F.col("at") / F.lit(width)))
    totals = rows.groupBy("bucket").agg(F.sum("starts").alias("s"), F.sum("ends").alias("e"))
    # One row per bucket.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("bucket", F.coalesce(F.sum("s").over(before), none).alias("s"), F.coalesce(F.sum("e").over(before), none).alias("e"))
    inside = Window.partitionBy("bucket").orderBy("at", "order").rangeBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumns({"starts": F.sum("starts").over(inside), "ends": F.sum("ends").over(inside)}).where("sign <> 0").join(base, "bucket")
    value = F.when(F.col("sign") > 0, F.col("starts") + F.col("s")).otherwise(-(F.col("ends") + F.col("e")))
    return seen.groupBy(F.col("key").alias(key)).agg(F.sum(value).alias("n"))
