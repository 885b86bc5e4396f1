"""Mixing sources to target weights by capped water-filling.

Targets: each source gets its weight's share of the budget; a source above
`max_epochs` times its size is clamped there and the excess goes to the others
by weight, until none is above. Sampling: a target is whole epochs and a
fraction. Every document is taken for each whole epoch, and the fraction takes
documents in the order of a seeded hash. Large documents (over 1/64 of their
source, at most 63 of them) are taken in that order while they stay within the
fraction of all large ones, and one more if the source then comes nearer to its
target than all the others could bring it; the others fill what is then missing,
up to the hash at which their words come nearest to it. That hash is found by two
histograms of 1,024 bins a source, so no task ever holds a source's documents.

Defined results: null text has size 0; a null source is a source of its own and
comes last; a source without words has target 0; documents of equal hash (rows
repeated as a whole) are taken alike. Empty input gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, free_name, materialize, table, text_or_empty

SEED = 20240601
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MAX_EPOCHS = 2.0
#: The driver works out one target a source, so it holds a row for each; more sources than this are refused.
MAX_SOURCES = 1_000_000
#: Up to so many sources their cuts are broadcast (under 1 MB); beyond, they are joined by shuffle.
BROADCAST_SOURCES = 10_000

#: A document is large if it has over 1/LARGE of its source's words.
LARGE = 64

_BITS = 10
_HASH_BITS = 62


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def water_fill(sizes: dict, weights: dict, budget: float, max_epochs: float) -> dict:
    """Targets by source: shares of budget by weight, none above max_epochs times its size."""
    target = dict.fromkeys(sizes, 0.0)
    # in the order in which a rising level of words per weight clamps them; those after the first one below its clamp stay below
    active = sorted((s for s in sizes if sizes[s] > 0 and weights[s] > 0), key=lambda s: max_epochs * sizes[s] / weights[s])
    left, total = float(budget), math.fsum(weights[s] for s in active)
    for k, s in enumerate(active):
        if left * weights[s] <= max_epochs * sizes[s] * total:
            target.update({x: left * weights[x] / total for x in active[k:]})
            break
        target[s] = float(max_epochs * sizes[s])
        left -= target[s]
        total -= weights[s]
    return target


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_or_empty(text_col)).alias("size"), _draw(id_col, text_col, seed).alias("draw"))


def _draw(id_col: str, text_col: str, seed: int) -> Column:
    """A document's place in the order of its source: 62 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 64 - _HASH_BITS)


def _bin(level: int) -> Column:
    return F.shiftright("draw", _HASH_BITS - _BITS * (level + 1))


def plan_mix(slim: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row a source (source, source_size, target, whole, cut_large, cut): repeat `whole` times, once more where draw < cut."""
    spark = slim.sparkSession
    per = slim.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    order = sorted((r["source"] for r in per), key=lambda s: (s is None, s or ""))
    sizes = {r["source"]: int(r["n"]) for r in per}
    given = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    target = water_fill(sizes, given, budget * sum(sizes.values()), max_epochs)
    rows = []
    for s in order:
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        rows.append((s, sizes[s], float(target[s]), whole, float(target[s] - whole * sizes[s])))
    plan = spark.createDataFrame(rows, T.StructType([
        T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()),
        T.StructField("whole", T.LongType()), T.StructField("missing", T.DoubleType())]))
    plan = F.broadcast(plan) if len(rows) <= BROADCAST_SOURCES else plan

    def same(a: str, b: str) -> Column:
        return F.col(a).eqNullSafe(F.col(b))

    sized = slim.join(plan.select(F.col("source").alias("s0"), "source_size", "missing"), same("source", "s0")).drop("s0")
    large = sized.where(_is_large()).select("source", "size", "draw", "missing", "source_size")
    order = W.partitionBy("source").orderBy("draw", "size")
    large = large.withColumn("run", F.sum("size").over(order)).withColumn("all", F.sum("size").over(W.partitionBy("source")))
    within = F.col("run") * F.col("source_size") <= F.col("missing") * F.col("all")
    large = large.groupBy("source").agg(
        F.coalesce(F.max(F.when(within, F.col("draw"))) + 1, F.lit(0)).alias("cut0"), F.coalesce(F.max(F.when(within, F.col("run"))), F.lit(0)).alias("large0"),
        (F.min(F.when(~within, F.col("draw"))) + 1).alias("cut1"), F.min(F.when(~within, F.col("run"))).alias("large1"),
        F.first("missing").alias("want"), (F.first("source_size") - F.first("all")).alias("rest"),
    )
    # short: by how much all others leave the target unmet; over: by how much the document that crosses the fraction passes it
    short, over = F.greatest(F.col("want") - F.col("large0") - F.col("rest"), F.lit(0.0)), F.greatest(F.col("large1") - F.col("want"), F.lit(0.0))
    more = F.coalesce(over < short, F.lit(False))
    large = large.select(F.col("source").alias("s3"), F.when(more, F.col("cut1")).otherwise(F.col("cut0")).alias("cut_large"), F.when(more, F.col("large1")).otherwise(F.col("large0")).alias("large"))
    plan = plan.join(large, same("source", "s3"), "left").drop("s3")
    plan = materialize(plan.select("source", "source_size", "target", "whole", F.coalesce("cut_large", F.lit(0)).alias("cut_large"), (F.col("missing") - F.coalesce("large", F.lit(0))).alias("missing")), "plan")
    plan = F.broadcast(plan) if len(rows) <= BROADCAST_SOURCES else plan
    slim = sized.where(~_is_large()).select("source", "size", "draw")

    # the bin in which the running sum passes what is missing, then the same among that bin's 1,024 parts
    one = _histogram(slim.withColumn("bin", _bin(0)))
    one = one.withColumnRenamed("source", "s1").join(plan, same("s1", "source")).where((F.col("before") <= F.col("missing")) & (F.col("before") + F.col("n") > F.col("missing")))
    one = one.select("s1", F.col("bin").alias("bin1"), (F.col("missing") - F.col("before")).alias("rest"))
    one = F.broadcast(one) if len(rows) <= BROADCAST_SOURCES else one
    inside = slim.join(one, same("source", "s1") & (_bin(0) == F.col("bin1"))).select("source", "size", _bin(1).alias("bin"))
    two = _histogram(inside).withColumnRenamed("source", "s2").join(one, same("s2", "s1"))
    # take the part in which the sum passes only if that comes nearer
    ends = two.select("s2", "bin", F.when(F.col("rest") - F.col("before") > F.col("before") + F.col("n") - F.col("rest"), F.col("bin") + 1).otherwise(F.col("bin")).alias("end"),
                      ((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest"))).alias("here"))
    cut = ends.where("here").groupBy("s2").agg(F.shiftleft(F.min("end"), _HASH_BITS - 2 * _BITS).alias("cut"))
    total = slim.groupBy(F.col("source").alias("s4")).agg(F.sum("size").alias("small"))
    plan = plan.join(cut, same("source", "s2"), "left").join(total, same("source", "s4"), "left")
    everything = F.when(F.col("missing") >= F.col("small"), F.lit(1 << _HASH_BITS)).otherwise(0)
    return plan.select("source", "source_size", "target", "whole", "cut_large", F.coalesce("cut", everything, F.lit(0)).alias("cut"))


def _is_large() -> Column:
    return F.col("size") * LARGE > F.col("source_size")


def _times(size: Column, draw: Column, plan) -> Column:
    """How often a document is taken; plan(name) is a column of its source's plan."""
    cut = F.when(size * LARGE > plan("source_size"), plan("cut_large")).otherwise(plan("cut"))
    return plan("whole") + (draw < cut).cast("long")


def _histogram(rows: DataFrame) -> DataFrame:
    """(source, bin, n, before): words of each bin and of those before it; at most 1,024 rows a source at level one."""
    n = rows.groupBy("source", "bin").agg(F.sum("size").alias("n"))
    run = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    return n.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Rows (id, size, source_size, target, taken, times), one for each row of docs."""
    slim = materialize(_slim(docs, id_col, text_col, source_col, seed), "sizes")
    plan = _small(plan_mix(slim, weights, budget, max_epochs))
    both = slim.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    times = _times(F.col("size"), F.col("draw"), F.col)
    return both.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"))


def _small(plan: DataFrame) -> DataFrame:
    plan = materialize(plan, "plan")
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def repeat_to_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """docs with every row as often as the mix takes it; the texts are not shuffled."""
    slim = materialize(_slim(docs, id_col, text_col, source_col, seed), "sizes")
    plan = _small(plan_mix(slim, weights, budget, max_epochs))
    names = docs.columns
    own = {c: free_name(names, f"mix_{c}") for c in plan.columns}
    again = free_name([*names, *own.values()], "again")
    both = docs.join(plan.select(*(F.col(c).alias(n) for c, n in own.items())), F.col(source_col).eqNullSafe(F.col(own["source"])))
    times = _times(word_count(text_or_empty(text_col)), _draw(id_col, text_col, seed), lambda c: F.col(own[c]))
    return both.withColumn(again, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*names)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
