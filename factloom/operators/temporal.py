"""The time-valid fact store: supersession, as-of status, current values, horizons.

A fact is known from validity_interval.start on, closed at both ends, by days.
`supersedes` names the one earlier fact that it replaces. Every function takes
and gives DataFrames, keeps all rows that it doesn't filter by definition, and
keys on seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import values
from factloom.sources import scratch

KEY = ["seed", "entity_id", "attribute"]


def start_day() -> Column:
    return F.col("validity_interval.start")


def end_day() -> Column:
    return F.col("validity_interval.end")


def memorable() -> Column:
    return ~F.col("injection") & ~F.col("never_memorize")


def with_trust(df: DataFrame) -> DataFrame:
    """Adds derived_trust by (channel, author); an unknown pair stays null and is a violation. The table has 9 rows."""
    return df.join(F.broadcast(values.trust_table(df.sparkSession)), ["channel", "author"], "left")


def with_successor(facts: DataFrame) -> DataFrame:
    """Adds succ_id and succ_start of the fact that supersedes each one.

    Of several (a violation of its own) the earliest counts. The right side is
    reduced to one row a superseded fact before the join. Facts that carry both columns
    already, as a store of facts may, are taken as they are.
    """
    if {"succ_id", "succ_start"} <= set(facts.columns):
        return facts
    first = F.min(F.struct(start_day().alias("start"), F.col("fact_id").alias("id")))
    succ = facts.where("supersedes IS NOT NULL").groupBy("seed", F.col("supersedes").alias("fact_id")).agg(first.alias("s"))
    return facts.join(by_shuffle(succ), ["seed", "fact_id"], "left").withColumns({"succ_id": F.col("s.id"), "succ_start": F.col("s.start")}).drop("s")


def status(as_of: Column, start: Column | None = None, end: Column | None = None, succ_start: Column | None = None) -> Column:
    """superseded, expired or active; null where the fact isn't known yet. end = as_of is still active."""
    start = start_day() if start is None else start
    end = end_day() if end is None else end
    succ = F.col("succ_start") if succ_start is None else succ_start
    return F.when(start > as_of, None).when(succ <= as_of, "superseded").when(end < as_of, "expired").otherwise("active")


def status_at(facts: DataFrame, as_of: Column) -> DataFrame:
    """Facts known at as_of, with their status."""
    return with_successor(facts).withColumn("status", status(as_of)).where("status IS NOT NULL")


#: Rows with one or a few a seed are written and broadcast up to so many; beyond, they are joined by shuffle.
BROADCAST_SEEDS = 100_000


def by_seed(df: DataFrame) -> DataFrame:
    """A table of a few rows a seed, worked out once, with a broadcast hint if it is small."""
    df = scratch.written(df, "by_seed")
    return F.broadcast(df) if df.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS else df


def by_shuffle(df: DataFrame) -> DataFrame:
    """df, to be joined by shuffle and sort, for a table that grows with the facts.

    Spark takes the size of a written table's files for that of its rows. Ids and constants shrink to a few bytes a row
    there, so that it would broadcast millions of rows through the driver.
    """
    return df.hint("merge")


def with_status(facts: DataFrame, dates: DataFrame) -> DataFrame:
    """One row for each fact and date (seed, horizon, as_of) at which it is known; dates are a table of horizons()."""
    return with_successor(facts).join(dates, "seed").withColumn("status", status(F.col("as_of"))).where("status IS NOT NULL")


def active_at(facts: DataFrame, dates: DataFrame) -> DataFrame:
    """The value in force of each key at each date, of memorable facts."""
    return with_status(facts.where(memorable()), dates).where("status = 'active'")


def current_as_of(facts: DataFrame, offset_days: int = values.DEFAULTS["current_offset_days"]) -> DataFrame:
    """(seed, as_of): the latest start and offset_days on."""
    return facts.groupBy("seed").agg(F.date_add(F.max(start_day()), offset_days).alias("as_of"))


def current_values(facts: DataFrame, offset_days: int = values.DEFAULTS["current_offset_days"]) -> DataFrame:
    return active_at(facts, by_seed(current_as_of(facts, offset_days).withColumn("horizon", F.lit("current"))))


def horizons(facts: DataFrame, events: DataFrame, offset_days: int = values.DEFAULTS["current_offset_days"]) -> DataFrame:
    """(seed, horizon, as_of): early and mid at 25% and 55% of the events' span, late at its end, current behind all facts."""
    span = events.groupBy("seed").agg(F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"))
    both = span.join(current_as_of(facts, offset_days), "seed")

    def part(share: float) -> Column:
        return F.date_add("t0", F.floor(F.datediff("t1", "t0") * share).cast("int"))

    rows = [F.struct(F.lit(h).alias("horizon"), d.alias("as_of")) for h, d in (("early", part(0.25)), ("mid", part(0.55)), ("late", F.col("t1")), ("current", F.col("as_of")))]
    return by_seed(both.select("seed", F.inline(F.array(*rows))))


def nearest_horizon(as_of: Column, dates: dict[str, Column]) -> Column:
    """current from the current date on; else the horizon of the least distance, the earlier of equal ones."""
    gaps = F.array(*(F.struct(F.abs(F.datediff(dates[h], as_of)).alias("gap"), F.lit(k).alias("k"), F.lit(h).alias("h")) for k, h in enumerate(("early", "mid", "late"))))
    return F.when(as_of >= dates["current"], "current").otherwise(F.array_min(gaps)["h"])


#: A fact's place in the history of its key: what history() adds, but for the last two, which only facts that carry all of it have.
HISTORY = ["pos", "length", "first_value", "last_value", "next_id", "next_start", "first_start", "chain_ids"]


def history(facts: DataFrame) -> DataFrame:
    """Memorable facts with their place in the history of their key by start: pos, length, first and last values, neighbours.

    Facts that carry the columns of HISTORY already, as a source may that has the revisions of a key in one row, are taken as they are.
    """
    if carries_history(facts):
        return facts.where(memorable())
    order = W.partitionBy(*KEY).orderBy(start_day(), "fact_id")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return facts.where(memorable()).withColumns({
        "pos": F.row_number().over(order) - 1, "length": F.count("*").over(whole),
        "first_value": F.first("value").over(whole), "last_value": F.last("value").over(whole),
        "next_id": F.lead("fact_id").over(order), "next_start": F.lead(start_day()).over(order),
    })


def carries_history(facts: DataFrame) -> bool:
    return set(HISTORY) <= set(facts.columns)


#: Words of 64 bits in a row of among()'s table, and the most words: 64 MB.
WORDS, MOST_WORDS = 512, 1 << 23


def among(df: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """Rows of df whose keys may be among wanted's, for an exact join that must follow: nearly all others are left out before they are shuffled.

    The keys of wanted set bits by their hash, sixteen bits for each key, in a table that is broadcast. It has at most 64 MB; if
    that is less than two bits for each key, df is given back whole.
    """
    spark = df.sparkSession
    hashes = scratch.written(wanted.select(F.xxhash64(*keys).alias("h")), "asked")
    n = hashes.count()
    words = min(MOST_WORDS, max(WORDS, 1 << (n // 4).bit_length()))
    if n > words * 32:
        return df
    word = F.shiftrightunsigned(F.col("h"), 6) % words
    bits = hashes.select(word.alias("w"), F.expr("shiftleft(1L, CAST(h & 63 AS INT))").alias("bits")).unionByName(spark.range(words).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("bits")))
    bits = bits.groupBy("w").agg(F.bit_or("bits").alias("bits"))
    rows = bits.groupBy(F.floor(F.col("w") / WORDS).cast("long").alias("_row")).agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("_words"))
    hashed = df.withColumn("h", F.xxhash64(*keys)).withColumn("_w", word)
    met = hashed.join(F.broadcast(rows), F.floor(F.col("_w") / WORDS).cast("long") == F.col("_row"))
    return met.where(F.expr(f"(shiftrightunsigned(get(_words, CAST(_w % {WORDS} AS INT)), CAST(h & 63 AS INT)) & 1) = 1")).select(*df.columns)


def active_by_window(facts: DataFrame, as_of: Column) -> DataFrame:
    """Facts in force at a day, without a join: the last one of each key that has started. Right only where every fact revises the one before it."""
    following = F.lead(start_day()).over(W.partitionBy(*KEY).orderBy(start_day(), "fact_id"))
    known = facts.withColumn("next_start", following).where(start_day() <= as_of)
    return known.where(F.col("next_start").isNull() | (F.col("next_start") > as_of))


def latest(df: DataFrame, keys: list[str], value: str, order: list[str], out: str, changes: str) -> DataFrame:
    """(keys, out, changes): the value of the last row of each key by order, and how many rows it has."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(out), F.count("*").alias(changes))


def close_intervals(facts: DataFrame) -> DataFrame:
    """Ends each superseded fact no later than the day before its successor starts."""
    end = F.least(end_day(), F.date_sub("succ_start", 1))
    return with_successor(facts).withColumn("validity_interval", F.struct(start_day().alias("start"), end.alias("end"))).drop("succ_id", "succ_start")


def pointer_chains(facts: DataFrame) -> DataFrame:
    """(seed, root, fact_id, depth): each chain of `supersedes` from its first fact on.

    Pointer doubling: after k rounds every fact points 2^k back, so the longest
    chain needs log2 of its depth joins. Facts on a cycle, or behind one, reach no root and are
    left out; cycles() lists them.
    """
    return _walk(facts).where("up IS NULL").select("seed", F.col("at").alias("root"), "fact_id", "depth")


def cycles(facts: DataFrame) -> DataFrame:
    """(seed, fact_id) of facts whose pointers reach no first fact."""
    return _walk(facts).where("up IS NOT NULL").select("seed", "fact_id")


def _walk(facts: DataFrame) -> DataFrame:
    known = facts.select("seed", F.col("fact_id").alias("supersedes"), F.col("fact_id").alias("up"))
    link = facts.select("seed", "fact_id", "supersedes").join(by_shuffle(known), ["seed", "supersedes"], "left").select("seed", "fact_id", "up")
    now = link.select("seed", "fact_id", F.coalesce("up", "fact_id").alias("at"), "up", F.when(F.col("up").isNotNull(), 1).otherwise(0).alias("depth"))
    # each round is written, so that the next reads it twice instead of planning it twice
    now = scratch.written(now, "walk")
    left, before = _rootless(now), None
    # a chain that goes on has facts that reach its root in the next round, so a round that roots no fact leaves only cycles
    while left and left != before:
        far = now.select(F.col("seed").alias("s2"), F.col("fact_id").alias("f2"), F.col("at").alias("at2"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        now = now.join(by_shuffle(far), (F.col("seed") == F.col("s2")) & (F.col("up") == F.col("f2")), "left").select(
            "seed", "fact_id", F.coalesce("at2", "at").alias("at"), F.when(F.col("f2").isNotNull(), F.col("up2")).alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"))
        now = scratch.written(now, "walk")
        before, left = left, _rootless(now)
    return now


def _rootless(walk: DataFrame) -> int:
    return walk.where("up IS NOT NULL").select("seed", "fact_id").distinct().count()


def event_facts(events: DataFrame, facts: DataFrame) -> DataFrame:
    """(seed, event_id, fact_pos, fact...): each event's facts in its order."""
    each = events.select("seed", "event_id", F.posexplode("fact_ids").alias("fact_pos", "fact_id"))
    return each.join(facts.drop("event_id"), ["seed", "fact_id"])


def last_of(events: DataFrame, key: str, *wanted: str) -> DataFrame:
    """The latest event's columns for each key: (timestamp, event_id) decides."""
    best = F.max_by(F.struct(*wanted), F.struct("timestamp", "event_id"))
    return events.where(F.col(key).isNotNull()).groupBy("seed", key).agg(best.alias("b")).select("seed", key, "b.*")


#: Ranges of rows that are numbered apart, a number for each of the session's shuffle partitions.
RANGES = 4


def ranked(df: DataFrame, out: str, *order: str | Column) -> DataFrame:
    """df with out: 1, 2, ... in the given order within each seed, for any number of rows a seed.

    Rows are sorted into ranges over all tasks, numbered within their range, and
    moved on by the rows of their seed in the ranges before. A window by seed
    alone would hold a seed in one task. The order must have no ties.
    """
    spark = df.sparkSession
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_o{k}" for k in range(len(order))]
    keyed = df.withColumns({c: F.col(o) if isinstance(o, str) else o for c, o in zip(names, order, strict=True)})
    ranges = scratch.written(keyed.repartitionByRange(n, "seed", *names).withColumn("_range", F.spark_partition_id()), "ranges")
    size = ranges.groupBy("seed", "_range").agg(F.count("*").alias("_n"))
    before = size.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("seed").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = ranges.withColumn(out, F.row_number().over(W.partitionBy("seed", "_range").orderBy(*names)))
    return inside.join(by_seed(before), ["seed", "_range"]).withColumn(out, F.col(out) + F.col("_before")).drop("_range", "_before", *names)


def numbered(df: DataFrame, prefix: str, out: str, *order: str | Column) -> DataFrame:
    """Ids prefix-seed-0001 in the given order within each seed."""
    return ranked(df, out, *order).withColumn(out, F.format_string(f"{prefix}-%d-%04d", "seed", out))


#: Rule, the least and the most that it allows (None: no bound).
QUOTAS = [
    ("advertisers", 10, 12),
    ("deals_per_advertiser", 3, None),
    ("scenarios", 100, None),
    ("timeline_span_days", 365, None),
    ("deals_with_correction_chains_pct", 40, None),
    ("multi_step_chains", 5, None),
    ("injections", 8, None),
    ("injection_plausibility", 3, 3),
    ("injections_targeting_corrected_fact", 2, None),
    ("never_memorize_probes", 5, None),
    ("transient_facts_with_end_dates", 10, None),
    ("events_with_permanent_and_volatile_facts", 3, None),
    ("duplicate_active_facts", None, 0),
]


def percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole with one decimal, half up; 0 of none."""
    return F.round((part * F.lit(100).cast("decimal(5,1)") / F.greatest(whole, F.lit(1))).cast("decimal(18,6)"), 1).cast("decimal(9,1)")


def co_occurrence(df: DataFrame, keys: list[str], left: Column, right: Column, out: str = "both") -> DataFrame:
    """(keys, out): whether rows of both kinds stand together under a key."""
    return df.groupBy(*keys).agg((F.bool_or(left) & F.bool_or(right)).alias(out))


def with_sibling(facts: DataFrame, keys: list[str], of: Column) -> DataFrame:
    """The facts that share their keys with one of `of`."""
    return facts.join(facts.where(of).select(*keys).distinct(), keys, "left_semi")


def quota_report(facts: DataFrame, events: DataFrame) -> DataFrame:
    """(seed, rule, observed, passed): the thirteen rules on the shape of a universe."""
    if "succ_id" in facts.columns:  # facts that carry their successor tell by themselves which are corrected, and which stand in a chain at all
        corrected = facts.where("succ_id IS NOT NULL")
        linked = facts.where("succ_id IS NOT NULL OR supersedes IS NOT NULL")
    else:
        superseded = facts.where("supersedes IS NOT NULL").select("seed", F.col("supersedes").alias("fact_id")).distinct()
        corrected, linked = facts.join(superseded, ["seed", "fact_id"], "left_semi"), facts
    lines = last_of(events, "io_id", "deal_id").select("seed", F.col("io_id").alias("entity_id"), "deal_id")
    of_line = corrected.where("entity = 'order-line'").join(lines, ["seed", "entity_id"]).select("seed", "deal_id")
    chained = corrected.where("entity = 'deal'").select("seed", F.col("entity_id").alias("deal_id")).unionByName(of_line).groupBy("seed").agg(F.countDistinct("deal_id").alias("chained"))
    # the last fact of a chain of three or more is two or more steps from its first
    chains = pointer_chains(linked).groupBy("seed", "root").agg(F.max("depth").alias("depth")).groupBy("seed").agg(F.count_if(F.col("depth") >= 2).alias("multi_step_chains"))
    lies = facts.where("injection")
    aimed = lies.join(among(corrected.where("NOT injection"), KEY, lies).select(*KEY).distinct(), KEY, "left_semi").groupBy("seed").agg(F.count("*").alias("injections_targeting_corrected_fact"))
    passing = F.col("volatility_class").isin("transient", "ephemeral")
    # rows of neither kind make no event mixed
    mixed = co_occurrence(facts.where((F.col("volatility_class") == "permanent") | passing), ["seed", "event_id"], F.col("volatility_class") == "permanent", passing).groupBy("seed").agg(F.count_if("both").alias("events_with_permanent_and_volatile_facts"))
    now = current_values(facts)
    if carries_history(facts):  # a key of one fact has no second one
        now = now.where("length >= 2")
    twice = now.groupBy(*KEY).count().where("count > 1").groupBy("seed").agg(F.count("*").alias("duplicate_active_facts"))
    sums = facts.groupBy("seed").agg(
        F.count_if("injection").alias("injections"), F.countDistinct(F.when(F.col("injection"), F.col("plausibility"))).alias("injection_plausibility"), F.count_if("never_memorize").alias("never_memorize_probes"),
        F.count_if((F.col("volatility_class") == "transient") & end_day().isNotNull()).alias("transient_facts_with_end_dates"))
    ev = events.groupBy("seed").agg(
        F.count("*").alias("scenarios"), F.countDistinct("advertiser_id").alias("advertisers"), F.countDistinct("deal_id").alias("deals"),
        F.datediff(F.max("timestamp"), F.min("timestamp")).alias("timeline_span_days"))
    one = sums.join(ev, "seed")
    for more in (chained, chains, aimed, mixed, twice):
        one = one.join(more, "seed", "left")
    one = one.na.fill(0).withColumns({
        "deals_per_advertiser": F.col("deals") / F.greatest("advertisers", F.lit(1)),
        "deals_with_correction_chains_pct": percentage(F.col("chained"), F.col("deals")),
    })
    rows = []
    for rule, least, most in QUOTAS:
        value = F.col(rule).cast("decimal(18,4)")
        ok = (F.lit(True) if least is None else value >= least) & (F.lit(True) if most is None else value <= most)
        rows.append(F.struct(F.lit(rule).alias("rule"), F.round(value, 1).cast("decimal(18,1)").alias("observed"), ok.alias("passed")))
    return one.select("seed", F.inline(F.array(*rows)))


def strict_quotas(facts: DataFrame, events: DataFrame) -> None:
    """Raises with the rules that fail: at most thirteen a seed."""
    failed = quota_report(facts, events).where("NOT passed").orderBy("seed", "rule").limit(50).collect()
    if failed:
        raise ValueError("; ".join(f"{r['rule']} of seed {r['seed']} is {r['observed']}" for r in failed))


def empty_facts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], values.FACT_DDL)
