"""Distinct counts and overlaps by theta sketches, with exact forms and the error beside them.

A sketch is a column of a few dozen kilobytes that stands for a set. Sketches of parts (a day, a batch, a seed) are written once and
merged for any coarser key without a look at the rows, and two of them give the size of what their sets share.
Sets of up to 2^lg values are held whole, so their counts are exact; beyond, a sketch is a sample at a known rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base 2 logarithm of the number of values that a sketch holds: 4,096, some 60 kB.
LG = 12
#: Standard deviations in the stated bound of an error.
SIGMAS = 4.0


def sketches(df: DataFrame, keys: list[str], item: str, lg: int = LG) -> DataFrame:
    """(keys, sketch) of each key's distinct items; nulls are no items, and a key that has none has an empty sketch. Tasks sketch before they shuffle."""
    return df.groupBy(*keys).agg(F.theta_sketch_agg(item, lg).alias("sketch"))


def merged(parts: DataFrame, keys: list[str], lg: int = LG) -> DataFrame:
    """(keys, sketch): the union of the sketches of each key."""
    return parts.groupBy(*keys).agg(F.theta_union_agg("sketch", lg).alias("sketch"))


def _over(size: Column, lg: int) -> Column:
    """How much larger than its sketch a set is, less one; 0 where the sketch holds it whole."""
    return F.greatest(size / float(1 << lg) - 1, F.lit(0.0))


def counted(parts: DataFrame, lg: int = LG) -> DataFrame:
    """parts with `estimate`, the number of distinct items, and `bound`, which the error exceeds hardly ever (SIGMAS standard deviations); 0 where the count is exact."""
    estimate = F.theta_sketch_estimate("sketch")
    return parts.withColumn("estimate", estimate).withColumn("bound", SIGMAS * F.sqrt(F.col("estimate") * _over(F.col("estimate"), lg)))


def overlaps(parts: DataFrame, pairs: DataFrame, key: str, lg: int = LG) -> DataFrame:
    """pairs (left_<key>, right_<key>, ...) with estimate, the number of items that both keys have, and bound.

    The pairs are the caller's; sketches come to them by key. What both have is sampled at the rate of the larger set's sketch. A key without a sketch
    drops its pairs.
    """
    left = parts.select(F.col(key).alias(f"left_{key}"), F.col("sketch").alias("_l"))
    right = parts.select(F.col(key).alias(f"right_{key}"), F.col("sketch").alias("_r"))
    both = pairs.join(left, f"left_{key}").join(right, f"right_{key}")
    size = F.greatest(F.theta_sketch_estimate("_l"), F.theta_sketch_estimate("_r"))
    out = both.withColumns({"estimate": F.theta_sketch_estimate(F.theta_intersection("_l", "_r")), "_over": _over(size, lg)})
    # a count of few is no proof that there are none, so the bound doesn't shrink to nothing with it
    few = F.when(F.col("_over") > 0, SIGMAS * SIGMAS * (F.col("_over") + 1)).otherwise(0.0)
    return out.withColumn("bound", SIGMAS * F.sqrt(F.col("estimate") * F.col("_over")) + few).drop("_l", "_r", "_over")


def exact_counts(df: DataFrame, keys: list[str], item: str, out: str = "exact") -> DataFrame:
    """(keys, out): the distinct items of each key, counted; nulls are no items."""
    return df.where(F.col(item).isNotNull()).select(*keys, item).distinct().groupBy(*keys).agg(F.count("*").alias(out))


def settled_counts(parts: DataFrame, df: DataFrame, keys: list[str], item: str, lg: int = LG) -> DataFrame:
    """(keys, estimate) without an error: from the sketches of parts where they hold their set whole, counted from df's rows for the other keys. Keys mustn't be null."""
    known = counted(parts, lg).select(*keys, "estimate", "bound")
    rows = df.join(known.where("bound > 0").select(*keys), keys, "left_semi")
    both = known.join(exact_counts(rows, keys, item), keys, "left")
    return both.select(*keys, F.when(F.col("bound") > 0, F.col("exact")).otherwise(F.col("estimate")).alias("estimate"))


def settled_overlaps(parts: DataFrame, df: DataFrame, pairs: DataFrame, key: str, item: str, lg: int = LG) -> DataFrame:
    """pairs with `estimate` without an error: from sketches where both hold their sets whole, counted from df's rows for the other pairs. The table of pairs should have each pair once."""
    names = [f"left_{key}", f"right_{key}"]
    known = overlaps(parts, pairs, key, lg)
    found = exact_overlaps(df, known.where("bound > 0").select(*names), key, item)
    return known.join(found, names, "left").withColumn("estimate", F.when(F.col("bound") > 0, F.col("shared")).otherwise(F.col("estimate"))).drop("bound", "shared")


def exact_overlaps(df: DataFrame, pairs: DataFrame, key: str, item: str) -> DataFrame:
    """pairs with `shared`, counted: the left key's items meet the right key's by (right key, item), so an item that many keys have is spread over them."""
    items = df.where(F.col(item).isNotNull()).select(key, item).distinct()
    asked = pairs.select(f"left_{key}", f"right_{key}").distinct()
    left = asked.join(items.withColumnRenamed(key, f"left_{key}"), f"left_{key}")
    found = left.join(items.withColumnRenamed(key, f"right_{key}"), [f"right_{key}", item]).groupBy(f"left_{key}", f"right_{key}").agg(F.count("*").alias("shared"))
    return pairs.join(found, [f"left_{key}", f"right_{key}"], "left").na.fill(0, ["shared"])
