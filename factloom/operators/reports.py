"""Completion counts: small aggregates over records, zero-filled by their dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import values


def zero_filled(df: DataFrame, column: str, every: list[str]) -> DataFrame:
    """(seed, column, n): counts by seed, 0 for values of the dimension that a seed lacks."""
    counts = df.groupBy("seed", column).agg(F.count("*").alias("n"))
    grid = df.select("seed").distinct().select("seed", F.explode(F.array(*map(F.lit, every))).alias(column))
    return grid.join(counts, ["seed", column], "left").na.fill(0, ["n"])


def counts_by(df: DataFrame, *sets: tuple[str, ...]) -> DataFrame:
    """(columns..., n): counts by several sets of columns in one pass; a column that a row's set lacks is null, and `lacks` has its bit."""
    columns = list(dict.fromkeys(c for one in sets for c in one))
    return df.groupingSets([[F.col(c) for c in one] for one in sets], *columns).agg(F.count("*").alias("n"), F.grouping_id(*columns).alias("lacks"))


def question_counts(questions: DataFrame) -> DataFrame:
    """(seed, by, name, n): questions by type, query kind and horizon."""
    columns = ("type", "query_kind", "as_of_horizon")
    g = counts_by(questions, *(("seed", c) for c in columns))
    # bits of (seed, type, query_kind, as_of_horizon): of the last three, the one that isn't set
    by = F.coalesce(*(F.when(F.col("lacks").bitwiseAND(F.lit(1 << (2 - k))) == 0, F.lit(c)) for k, c in enumerate(columns)))
    return g.select("seed", by.alias("by"), F.coalesce(*columns).alias("name"), "n")


def completion(facts: DataFrame, events: DataFrame, questions: DataFrame) -> DataFrame:
    """One row a seed: facts, events, entities, span in days, questions."""
    f = facts.groupBy("seed").agg(F.count("*").alias("facts"))
    e = events.groupBy("seed").agg(
        F.count("*").alias("events"), F.countDistinct("advertiser_id").alias("advertisers"), F.countDistinct("deal_id").alias("deals"),
        F.countDistinct("io_id").alias("lines"), F.datediff(F.max("timestamp"), F.min("timestamp")).alias("span_days"))
    q = questions.groupBy("seed").agg(F.count("*").alias("questions"))
    return f.join(e, "seed").join(q, "seed", "left").na.fill(0, ["questions"])


def shared_names(df: DataFrame, name: str = "advertiser_name") -> DataFrame:
    """(left_seed, right_seed, shared): names that two seeds have in common; a name's seeds pair up within its own row."""
    seeds = df.groupBy(name).agg(F.array_sort(F.collect_set("seed")).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("left_seed"), b.alias("right_seed")))))
    return seeds.select(F.explode(pairs).alias("p")).groupBy("p.left_seed", "p.right_seed").agg(F.count("*").alias("shared"))


def first_seen(df: DataFrame, keys: list[str], item: str, order: str, out: str = "seen") -> DataFrame:
    """(keys, out): the distinct items of each key, in the order in which they first occur; a key has few items."""
    first = df.groupBy(*keys, item).agg(F.min(order).alias("_at"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", item))), lambda s: s[item]).alias(out))


def unused_trust_pairs(facts: DataFrame) -> DataFrame:
    """(channel, author, trust_class) of the table that no fact has."""
    table = values.trust_table(facts.sparkSession)
    return table.join(facts.select("channel", "author").distinct(), ["channel", "author"], "left_anti")
