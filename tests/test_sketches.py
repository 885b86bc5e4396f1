"""Sketched counts and overlaps against exact ones."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import sketches


def sets(spark, size, step):
    """Six keys of `size` items each; neighbours share all but `step` of them. Items repeat, and some are null."""
    one = spark.range(6 * size * 2).select((F.col("id") % 6).cast("int").alias("k"), F.floor(F.col("id") / 6).alias("x"))
    return one.select("k", ((F.col("x") % size) + F.col("k") * step).alias("item")).unionByName(spark.createDataFrame([(0, None), (9, None)], "k int, item long"))


PAIRS = [(a, b) for a in range(6) for b in range(a + 1, 6)] + [(0, 9), (0, 77)]


@pytest.mark.parametrize("size,step,lg", [(500, 100, 12), (3000, 700, 10), (20000, 3000, 12), (20000, 19990, 11)])
def test_overlaps_lie_within_their_bounds(spark, size, step, lg):
    df, pairs = sets(spark, size, step), spark.createDataFrame(PAIRS, "left_k int, right_k int")
    exact = {(r["left_k"], r["right_k"]): r["shared"] for r in sketches.exact_overlaps(df, pairs, "k", "item").collect()}
    assert exact == {(a, b): 0 if b > 6 else max(0, size - (b - a) * step) for a, b in PAIRS}
    guessed = {(r["left_k"], r["right_k"]): (r["estimate"], r["bound"]) for r in sketches.overlaps(sketches.sketches(df, ["k"], "item", lg), pairs, "k", lg).collect()}
    assert set(guessed) == set(PAIRS) - {(0, 77)}  # no sketch of 77
    for pair, (estimate, bound) in guessed.items():
        assert abs(estimate - exact[pair]) <= bound
        assert (bound == 0) == (size <= 1 << lg)
        assert bound < size


@pytest.mark.parametrize("lg", [8, 12])
def test_parts_merge_to_the_whole(spark, lg):
    df = sets(spark, 5000, 900)
    parts = sketches.sketches(df.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(7))), ["k", "part"], "item", lg)
    for keys, truth in ((["k"], 5000), ([], 5000 + 5 * 900)):
        for r in sketches.counted(sketches.merged(parts, keys, lg), lg).collect():
            want = 0 if keys and r["k"] == 9 else truth
            assert abs(r["estimate"] - want) <= r["bound"]


def test_empty(spark):
    none = sets(spark, 3, 1).limit(0)
    pairs = spark.createDataFrame([(1, 2)], "left_k int, right_k int")
    made = sketches.sketches(none, ["k"], "item")
    assert made.isEmpty() and sketches.merged(made, ["k"]).isEmpty() and sketches.overlaps(made, pairs, "k").isEmpty()
    assert [tuple(r) for r in sketches.exact_overlaps(none, pairs, "k", "item").collect()] == [(1, 2, 0)]


def test_sets_that_a_sketch_does_not_hold_are_counted(spark):
    """Counts and overlaps have no error, whether or not a sketch holds its set."""
    df = spark.range(9000).selectExpr("CASE WHEN id < 8000 THEN 1 ELSE 2 END AS k", "id AS x").unionByName(spark.range(7000, 7600).selectExpr("2 AS k", "id AS x")).unionByName(spark.range(9000, 9010).selectExpr("3 AS k", "id AS x"))
    parts = sketches.sketches(df, ["k"], "x")
    assert {(r["k"], r["estimate"]) for r in sketches.settled_counts(parts, df, ["k"], "x").collect()} == {(1, 8000), (2, 1600), (3, 10)}
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "left_k int, right_k int")
    assert {tuple(r) for r in sketches.settled_overlaps(parts, df, pairs, "k", "x").select("left_k", "right_k", "estimate").collect()} == {(1, 2, 600), (1, 3, 0), (2, 3, 0)}
