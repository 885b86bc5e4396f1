"""Operators along time: as-of joins for any number of dates, sweeps over validity intervals, digests of ordered sets.

Rows meet by key and time in windows and running sums, never as pairs. What a key
has in one place is bounded: a sweep first sums changes by day, so a key has at most as
many rows as the calendar has days, and an as-of join cuts keys into ranges of time
where they may have very many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .temporal import ranked


def asof_join(facts: DataFrame, probes: DataFrame, keys: list[str], fact_at: str, probe_at: str, payload: list[str], order: list[str] | None = None, until: str | None = None, range_days: int | None = None) -> DataFrame:
    """probes, each with the payload columns of the last fact of its key that has started at probe_at; null where there is none.

    Facts and probes go through one shuffle by key and one window, whatever the number of dates. order
    breaks ties of facts that start together, the largest last. With `until`, a fact that ended before probe_at
    gives nulls (and hides those before it). With range_days a key is cut into ranges of so many days, which go to
    tasks of their own; the last fact of each range is carried on to the later ones. A probe with a null key
    or date meets nothing. Payload names must not be columns of probes.
    """
    more = [until] if until and until not in payload else []
    body = F.struct(*payload, *more)
    ties = F.struct(*(order or [F.lit(0).alias("none")]))
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    left = facts.where(complete & F.col(fact_at).isNotNull()).select(*keys, F.col(fact_at).cast("date").alias("_at"), F.lit(0).alias("_kind"), ties.alias("_order"), body.alias("_fact"))
    asked = F.struct(*probes.columns)
    whole = complete & F.col(probe_at).isNotNull()
    right = probes.where(whole).select(*keys, F.col(probe_at).cast("date").alias("_at"), F.lit(1).alias("_kind"), asked.alias("_probe"))
    both = left.unionByName(right, allowMissingColumns=True)
    within = list(keys)
    if range_days:
        both = both.withColumn("_range", F.floor(F.unix_date("_at") / range_days))
        within.append("_range")
    upto = W.partitionBy(*within).orderBy("_at", "_kind", "_order").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_fact", ignorenulls=True).over(upto)).where("_kind = 1")
    if range_days:
        last = both.groupBy(*within).agg(F.max_by("_fact", F.when(F.col("_kind") == 0, F.struct("_at", "_order"))).alias("_last"))
        before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
        carried = last.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).drop("_last")
        found = found.join(carried, within).withColumn("_found", F.coalesce("_found", "_carried"))
    out = found.select("_probe", *(F.col(f"_found.{c}").alias(c) for c in [*payload, *more])).select("_probe.*", *payload, *more)
    lost = probes.where(~F.coalesce(whole, F.lit(False)))
    for c in payload:
        if until:
            out = out.withColumn(c, F.when(F.col(until).isNull() | (F.col(until) >= F.col(probe_at)), F.col(c)))
        lost = lost.withColumn(c, F.lit(None).cast(facts.schema[c].dataType))
    return out.select(*probes.columns, *payload).unionByName(lost)


def periods(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, start, end, n): the periods of each key in which n intervals hold, from its first start on, gaps (n = 0) included.

    Intervals are days, closed at both ends; a null end is open, and so is the end of a period that goes on. Those
    that end before they start, or have no start, count as none. A sweep: +1 where an interval starts, -1 on the day after its end, summed by day and run up.
    """
    sound = intervals.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col(start))))
    steps = F.array(F.struct(F.col(start).cast("date").alias("day"), F.lit(1).alias("by")), F.struct(F.date_add(F.col(end).cast("date"), 1).alias("day"), F.lit(-1).alias("by")))
    changes = sound.select(*keys, F.inline(steps)).where("day IS NOT NULL").groupBy(*keys, "day").agg(F.sum("by").alias("by")).where("by <> 0")
    order = W.partitionBy(*keys).orderBy("day")
    run = changes.withColumns({"n": F.sum("by").over(order), "_next": F.lead("day").over(order)})
    return run.where("_next IS NOT NULL OR n > 0").select(*keys, F.col("day").alias("start"), F.date_sub("_next", 1).alias("end"), "n")


def overlaps(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The periods in which more than one interval of a key holds."""
    return periods(intervals, keys, start, end).where("n > 1")


def gaps(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The periods between a key's first start and last end in which none holds."""
    return periods(intervals, keys, start, end).where("n = 0").drop("n")


def coalesced(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, start, end, most): unions of intervals that overlap or touch, and how many of them hold at once at most."""
    each = periods(intervals, keys, start, end)
    island = each.withColumn("_island", F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).over(W.partitionBy(*keys).orderBy("start"))).where("n > 0")
    open_ = F.bool_or(F.col("end").isNull())
    return island.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.when(~open_, F.max("end")).alias("end"), F.max("n").alias("most")).drop("_island")


#: Lines, or digests of a level below, in a node of a digest tree.
LEAF = 1024


def digest_nodes(df: DataFrame, line: Column, order: list[str], levels: int, leaf: int = LEAF) -> DataFrame:
    """(node, digest) of the nodes that stand `levels` levels above the lines, numbered from 0 in order; each stands for leaf ** levels lines, the last for the rest."""
    level = _lines(df, line, order)
    for _ in range(levels):
        level = _above(level, leaf)
    return level.select(F.col("at").alias("node"), F.col("text").alias("digest"))


def _lines(df: DataFrame, line: Column, order: list[str]) -> DataFrame:
    taken = {f"_k{k}": F.col(c) for k, c in enumerate(order)}
    lines = df.select(F.lit(0).alias("seed"), line.alias("text"), *(c.alias(name) for name, c in taken.items()))
    return ranked(lines, "at", *taken).select((F.col("at") - 1).alias("at"), "text")


def _above(level: DataFrame, leaf: int) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    return level.groupBy(F.floor(F.col("at") / leaf).alias("node")).agg(F.sha2(text, 256).alias("text")).withColumnRenamed("node", "at")


def digest_tree(df: DataFrame, line: Column, order: list[str], leaf: int = LEAF) -> DataFrame:
    """(rows, levels, digest) of the lines in order: a tree of SHA-256 digests over nodes of `leaf` lines.

    Nodes hold fixed numbers of lines, so the digest doesn't depend on how rows are spread. A node's text is its
    lines, or its children's digests in hexadecimal, joined by line feeds. No task holds more than a node's lines at once, and none
    come to the driver. Rows that tie in the order must have equal lines. An empty set has the digest of an empty text.
    """
    level = _lines(df, line, order)
    rows = df.count()
    left, levels = rows, 0
    while left > 1 or not levels:
        level = _above(level, leaf)
        left, levels = -(-left // leaf), levels + 1
    digest = F.coalesce(F.max("text"), F.sha2(F.lit(""), 256))
    return level.agg(F.lit(rows).cast("long").alias("rows"), F.lit(levels).alias("levels"), digest.alias("digest"))
