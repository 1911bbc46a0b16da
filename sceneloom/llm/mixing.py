"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is met in whole passes over the source and a remaining budget. The remaining budget is filled from
the counts of documents by exact length: first the same share of every length, then one more of some lengths, and
last a bounded-knapsack dynamic program over the counts that are left, which comes as near to the budget as sums of
lengths can. Counts become documents by a seeded order within each (source, length): documents are dealt to lanes by
the seeded hash, whole lanes are taken by their counts, and only the one lane that the quota ends in is ranked, so no
group of equal length, however large, is sorted by one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, staged, text_or_empty

#: Budget, in words, that the dynamic program fits exactly; larger rests are cut down to it by taking whole documents first.
DP_BUDGET = 1 << 16
WEIGHTS = (5, 2, 1)
#: Documents per lane aimed at.
LANE_ROWS = 1 << 12


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_CLASS)).cast("long")


def water_fill(sizes: list[int], weights: list[float], total: float, limit: float = 2.0) -> list[float]:
    """Shares of total by weight, none above limit times its size; what a full one can't hold is shared again by weight among the others."""
    targets = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    rest = total
    while open_ and rest > 0:
        unit = rest / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] >= limit * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = unit * weights[i]
            break
        for i in full:
            targets[i] = limit * sizes[i]
            rest -= targets[i]
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
    return targets


def fit_counts(lengths: list[int], counts: list[int], budget: int, dp_budget: int = DP_BUDGET) -> list[int]:
    """How many documents of each length to take, at most counts, so that the sum of lengths comes as near to budget as found.

    Lengths are distinct and positive. The sum never exceeds the budget, unless the nearest sum above it is nearer.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget <= 0 or not total:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    # Keep the distribution of lengths, but leave a rest for the exact fit to work on.
    reserve = min(budget, dp_budget // 2)
    taken = [c * (budget - reserve) // total for c in counts]
    rest = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if rest <= dp_budget:
            break
        more = min(counts[i] - taken[i], max(0, (rest - reserve) // lengths[i]))
        taken[i] += more
        rest -= more * lengths[i]
    extra = knapsack(lengths, [c - t for c, t in zip(counts, taken, strict=True)], rest)
    return [t + e for t, e in zip(taken, extra, strict=True)]


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """Bounded subset sum: counts split in powers of two, reachable sums as the bits of an integer, and a walk back. The sum nearest to budget, looking up to the smallest length beyond it."""
    usable = [i for i in range(len(lengths)) if counts[i] > 0]
    if not usable or budget <= 0:
        return [0] * len(lengths)
    top = budget + min(lengths[i] for i in usable)
    mask = (1 << (top + 1)) - 1
    items, reach, steps = [], 1, []
    for i in usable:
        left, k = min(counts[i], top // lengths[i]), 1
        while left > 0:
            k_now = min(k, left)
            items.append((i, k_now))
            steps.append(reach)
            reach |= (reach << (lengths[i] * k_now)) & mask
            left -= k_now
            k *= 2
        if reach >> budget & 1:
            break
    below = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above_bits = reach >> (budget + 1)
    above = budget + (above_bits & -above_bits).bit_length() if above_bits else None
    at = above if above is not None and above - budget < budget - below else below
    chosen = [0] * len(lengths)
    for (i, k), before in zip(reversed(items), reversed(steps), strict=True):
        if before >> at & 1:
            continue
        chosen[i] += k
        at -= k * lengths[i]
    return chosen


def _targets(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row per source: targets of all of them."""
    pdf = pdf.sort_values("rank")
    weights = [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(pdf))]
    sizes = [int(s) for s in pdf["source_size"]]
    pdf["target"] = water_fill(sizes, weights, 1.5 * sum(sizes))
    return pdf[["skey", "source_size", "target"]]


def _quotas(pdf: pd.DataFrame) -> pd.DataFrame:
    """The length counts of one source (a row per length): passes and quota of each length."""
    pdf = pdf.sort_values("size")
    lengths, counts = [int(x) for x in pdf["size"]], [int(x) for x in pdf["n"]]
    size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    passes = min(2, int(target // size)) if size else 0
    positive = [i for i, n in enumerate(lengths) if n > 0]
    quota = [0] * len(lengths)
    if size and passes < 2:
        for i, q in zip(positive, fit_counts([lengths[i] for i in positive], [counts[i] for i in positive], round(target - passes * size)), strict=True):
            quota[i] = q
    return pd.DataFrame({"skey": pdf["skey"].iloc[0], "size": lengths, "passes": passes, "quota": quota, "n": counts, "source_size": size, "target": target})


def plan_mix(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row; taken is 0, 1 or 2 times size.

    Size is the number of words (null text: 0). Documents without words are taken with no words. Null is a source of
    its own, after all others. Sources without words have target 0. Rows repeated under one id are dealt with one by
    one. An empty table gives an empty result. The driver never sees sources or documents: targets are found in one
    task over a row per source, quotas in one task per source over a row per length.
    """
    skey = F.when(docs[source_col].isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), docs[source_col].cast("string")))
    base = staged(
        docs.select(docs[id_col].alias("doc_id"), word_count(text_or_empty(docs, text_col)).alias("size"), skey.alias("skey"), F.xxhash64(F.lit(seed), docs[id_col]).alias("h")),
        "mix-base",
    )
    by_length = base.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n"))
    sources = by_length.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    # Binary order of UTF-8 is the order of code points.
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy("skey")))
    targets = ranked.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_targets, "skey string, source_size long, target double")
    quotas = by_length.join(targets, "skey").groupBy("skey").applyInPandas(_quotas, "skey string, size long, passes int, quota long, n long, source_size long, target double")
    quotas = staged(quotas, "mix-quotas")
    # Lanes by the seeded hash: as many as a length's documents need.
    wanted = quotas.select("skey", "size", F.greatest(F.lit(1), F.ceil(F.col("n") / LANE_ROWS)).cast("long").alias("lanes"), "passes", "quota", "n", "source_size", "target")
    rows = base.join(wanted, ["skey", "size"]).withColumn("lane", F.pmod("h", F.col("lanes")))
    lane_key = ["skey", "size", "lane"]
    sums = rows.groupBy(*lane_key, "quota").agg(F.count(F.lit(1)).alias("m"))
    ahead = Window.partitionBy("skey", "size").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*lane_key, F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("first"), "m", "quota")
    split = starts.where("first < quota AND quota < first + m").select(*lane_key, (F.col("quota") - F.col("first")).alias("need"))
    full = starts.select(*lane_key, (F.col("first") + F.col("m") <= F.col("quota")).cast("int").alias("whole"))
    marked = rows.join(full, lane_key).join(split, lane_key, "left")
    # Only lanes that a quota ends in are ranked; the others form no group.
    order = Window.partitionBy(*lane_key, F.when(F.col("need").isNull(), F.col("doc_id"))).orderBy("h", "doc_id")
    place = F.row_number().over(order)
    chosen = F.when(F.col("need").isNull(), F.col("whole")).otherwise((place <= F.col("need")).cast("int"))
    return marked.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("passes") + chosen)).cast("long").alias("taken"), (F.col("passes") + chosen).cast("int").alias("times"))

