"""Fidelity of rendered texts in both directions: nothing planted is missing, nothing unsupported is there.

A manifest meets its text by (seed, event_id), so no text meets values of other
events. All else is worked out in that row: the text is indexed once, and what may
stand in it once, as one text of all values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import canon, extract

#: Manifest columns whose text may appear beside the facts.
HEADER = ["subject", "author", "advertiser_name", "agency_name", "contact_name", "deal_name", "io_id"]


#: Texts that one task indexes.
TEXTS = 4000


def _with_text(manifests: DataFrame, texts: DataFrame) -> DataFrame:
    """Manifests with their text (null: none), over as many tasks as texts need: what is shuffled is small, and Spark would give very many to a task."""
    m = manifests.select("seed", "event_id", "facts", *HEADER, F.col("timestamp").cast("string").alias("timestamp"))
    n = -(-m.count() // TEXTS) or 1
    return m.repartition(n, "seed", "event_id").join(texts.select("seed", "event_id", "text").repartition(n, "seed", "event_id").hint("merge"), ["seed", "event_id"], "left")


def _with_support(both: DataFrame, safe) -> DataFrame:
    """both with what its text may contain, from fact values, header columns and dates: nums, days, phrases (normalised), and _canon, the values with their canonical forms."""
    own = F.flatten(F.transform("facts", lambda f: F.array(f["value"], f["validity_interval"]["start"].cast("string"), f["validity_interval"]["end"].cast("string"))))
    every = F.array_distinct(F.filter(F.concat(own, F.array(*HEADER, "timestamp")), lambda v: v.isNotNull()))
    df = both.withColumn("_values", every).withColumn("_canon", F.transform("_values", lambda v: F.struct(v.alias("text"), extract.value(v).alias("v"))))
    # no pattern reaches across a line's end, so the values' own index is that of their lines
    df = extract.text_index(df.withColumn("_said", F.array_join("_values", "\n")), "_said", safe, extract.VALUES)

    def shown(c: str) -> Column:
        return F.filter(F.transform("_canon", lambda x: x["v"][c]), lambda x: x.isNotNull())

    nums, days = F.transform("idx.numbers", lambda n: n["value"]), F.transform("idx.dates", lambda d: d["day"])
    return df.withColumns({"nums": F.array_distinct(F.concat(nums, shown("num"))), "days": F.array_distinct(F.concat(days, shown("day"))), "phrases": F.array_distinct(shown("norm"))})


def verify(manifests: DataFrame, texts: DataFrame, safe=extract.SAFE_WORDS) -> DataFrame:
    """(seed, event_id, status, missing, numbers, dates, names), one row a manifest: pass if nothing is missing or unsupported.

    missing: planted values that the text doesn't hold, all where there is no text; the rest are surfaces without support, sorted and distinct.
    """
    df = extract.text_index(_with_text(manifests, texts), "text", safe).withColumnRenamed("idx", "_own")
    df = _with_support(df, safe)
    held = lambda f: F.coalesce(F.exists("_canon", lambda c: (c["text"] == f["value"]) & extract.contains(F.col("_own"), c["v"])), F.lit(False))
    missing = F.transform(F.filter("facts", lambda f: ~held(f)), lambda f: F.struct(f["fact_id"].alias("fact_id"), f["attribute"].alias("attribute"), f["value"].alias("value")))
    numbers = F.transform(F.filter("_own.numbers", lambda n: ~F.array_contains("nums", n["value"])), lambda n: n["surface"])
    dates = F.transform(F.filter("_own.dates", lambda d: ~F.array_contains("days", d["day"])), lambda d: d["surface"])
    months = F.transform(F.filter("_own.months", lambda m: ~F.exists("days", lambda d: F.year(d) * 100 + F.month(d) == m["month"])), lambda m: m["surface"])
    norm = F.transform("_own.names", lambda n: F.struct(n.alias("surface"), canon.words(F.lower(n)).alias("norm")))
    names = F.transform(F.filter(norm, lambda n: ~extract.supports_name(F.split(n["norm"], " "), F.col("phrases"), safe)), lambda n: n["surface"])

    def tidy(a):
        return F.array_sort(F.array_distinct(a))

    out = df.select("seed", "event_id", F.coalesce(F.sort_array(missing), F.array().cast("array<struct<fact_id:string,attribute:string,value:string>>")).alias("missing"), tidy(numbers).alias("numbers"), tidy(F.concat(dates, months)).alias("dates"), tidy(names).alias("names"))
    clean = (F.size("missing") == 0) & (F.size("numbers") == 0) & (F.size("dates") == 0) & (F.size("names") == 0)
    return out.select("seed", "event_id", F.when(clean, "pass").otherwise("fail").alias("status"), "missing", "numbers", "dates", "names")


def summary(report: DataFrame) -> DataFrame:
    return report.groupBy("seed").agg(
        F.count("*").alias("scenarios"), F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "fail").alias("failed"),
        F.sum(F.size("missing")).alias("missing"), F.sum(F.size("numbers") + F.size("dates") + F.size("names")).alias("unsupported"),
    )


def failure_texts(report: DataFrame) -> DataFrame:
    """(seed, event_id, text): what to mend, one line a finding."""
    lines = F.concat(F.transform("missing", lambda m: F.concat(F.lit("missing "), m["attribute"], F.lit(": "), m["value"])), *(F.transform(c, lambda x: F.concat(F.lit("unsupported: "), x)) for c in ("numbers", "dates", "names")))
    return report.where("status = 'fail'").select("seed", "event_id", F.array_join(lines, "\n").alias("text"))
