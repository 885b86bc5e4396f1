"""Containment joins: which texts hold which values or passages.

Dates and numbers meet texts by equality of canonical keys. Passages meet them on
the hash of their first `gram` words, or of their first word where they are
shorter, names on their rarest word or word pair; both are tested as a whole only
there. What meets are keys and ids; a text is read again only where a key met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import canon, extract
from factloom.sources import scratch

GRAM = 5
#: Passages are broadcast up to so many rows and characters; beyond, keys are shuffled.
BROADCAST_ROWS = 100_000
BROADCAST_CHARS = 8_000_000


def small(df: DataFrame, *texts: str) -> DataFrame:
    """df with a broadcast hint if it is small by count and by the characters of its text columns. It should be a written table."""
    rows, chars = df.agg(F.count("*"), F.coalesce(F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in texts), F.lit(0))), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and chars <= BROADCAST_CHARS else df


def _grams(words: Column, n: int, longest: bool, shortest: bool) -> Column:
    """Distinct hashes of the runs of n words, and of the single words; the size is hashed as well."""
    none = F.array().cast("array<bigint>")
    runs = F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.lit(n), F.slice(words, i, n)))).otherwise(none)
    ones = F.transform(words, lambda w: F.xxhash64(F.lit(1), F.array(w)))
    return F.array_distinct(F.concat(runs, ones) if longest and shortest else runs if longest else ones if shortest else none)


def contains_join(texts: DataFrame, passages: DataFrame, text_id: str, passage_id: str, text_col: str = "text", passage_col: str = "text", gram: int = GRAM) -> DataFrame:
    """Pairs (text_id, passage_id), once each. Empty passages are in no text."""
    p = passages.select(F.col(passage_id).alias("_pid"), canon.normal_name(F.coalesce(F.col(passage_col), F.lit(""))).alias("_p")).where("_p <> ''")
    w = F.split("_p", " ")
    n = F.when(F.size(w) >= gram, gram).otherwise(1)
    p = scratch.written(p.select("_pid", "_p", n.alias("_n"), F.xxhash64(n, F.slice(w, 1, n)).alias("_g")), "passages")
    longest, shortest = p.agg(F.coalesce(F.bool_or(F.col("_n") > 1), F.lit(False)), F.coalesce(F.bool_or(F.col("_n") == 1), F.lit(False))).first()
    raw = texts.select(F.col(text_id).alias("_tid"), F.coalesce(F.col(text_col), F.lit("")).alias("_raw"))
    words = raw.select("_tid", F.split(canon.normal_name(F.col("_raw")), " ").alias("_w"))
    keys = words.select("_tid", F.explode(_grams(F.col("_w"), gram, longest, shortest)).alias("_k"))
    met = keys.join(small(p.select("_pid", "_g")), F.col("_k") == F.col("_g")).select(F.col("_tid").alias("_hit"), "_pid").distinct()
    met = scratch.written(met, "met")
    # only texts in which a key met are normalised again
    both = raw.join(small(met), F.col("_tid") == F.col("_hit")).withColumn("_t", canon.normal_name(F.col("_raw")))
    both = both.join(small(p.select(F.col("_pid").alias("_own"), "_p"), "_p"), F.col("_pid") == F.col("_own"))
    held = both.where(F.contains(extract.padded(F.col("_t")), extract.padded(F.col("_p"))))
    return held.select(F.col("_tid").alias(text_id), F.col("_pid").alias(passage_id)).distinct()


#: A key that more segments hold is heavy: names on it meet on two words instead where they have two.
HEAVY = 64


def _word_keys(words: Column, pairs: bool) -> Column:
    """The distinct words of an array, or its pairs of adjacent words."""
    runs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.array_distinct(F.coalesce(runs, F.array().cast("array<string>")) if pairs else words)


def _rarest(names: DataFrame, segs: DataFrame, scope: list[str], pairs: bool) -> DataFrame:
    """names (scope, _n, _p) with _k, the key of theirs that the fewest segments hold, and _df, how many; names with a key that no segment holds are left out."""
    keys = names.select(*scope, "_n", F.explode(_word_keys(F.split("_p", " "), pairs)).alias("_k"))
    asked = scratch.written(keys.select(*scope, "_k").distinct(), "asked")
    # words are counted before they are shuffled
    held = segs.select(*scope, F.explode(_word_keys(F.split("_seg", " "), pairs)).alias("_k")).join(small(asked, "_k"), [*scope, "_k"], "left_semi")
    counts = held.groupBy(*scope, "_k").agg(F.count("*").alias("_df"))
    found = keys.join(counts, [*scope, "_k"], "left").groupBy(*scope, "_n").agg(F.min(F.struct("_df", "_k")).alias("_best"), F.count_if(F.col("_df").isNull()).alias("_absent"))
    best = found.where("_absent = 0").select(*scope, "_n", F.col("_best._k").alias("_k"), F.col("_best._df").alias("_df"))
    return scratch.written(names.join(best, [*scope, "_n"]).select(*scope, "_n", "_p", "_k", "_df"), "rarest")


def names_join(segs: DataFrame, names: DataFrame, scope: list[str]) -> DataFrame:
    """Pairs (_s, _n) of segments (scope, _s, _seg) and names (scope, _n, _p) that stand in them as runs of words, once each.

    An index by document frequency: a name meets segments on the rarest of its words, or on the
    rarest of its word pairs where all its words are frequent, so names with words in common
    meet only the segments that hold what is their own. Keys carry no text; a segment's text is read
    again where a key met. Both should be written tables.
    """
    single = _rarest(names, segs, scope, False)
    heavy = (F.col("_df") > HEAVY) & F.contains(F.col("_p"), F.lit(" "))
    twos = _rarest(single.where(heavy).select(*scope, "_n", "_p"), segs, scope, True)

    def met(chosen: DataFrame, pairs: bool) -> DataFrame:
        keys = segs.select(*scope, "_s", F.explode(_word_keys(F.split("_seg", " "), pairs)).alias("_k"))
        return keys.join(small(chosen.select(*scope, "_n", "_p", "_k"), "_p"), [*scope, "_k"]).select("_s", "_n", "_p")

    both = met(single.where(~heavy), False).unionByName(met(twos, True)).withColumnRenamed("_s", "_met")
    return segs.join(both, F.col("_s") == F.col("_met")).where(F.contains(extract.padded(F.col("_seg")), extract.padded(F.col("_p")))).select("_s", "_n").distinct()


def values_join(indexed: DataFrame, values: DataFrame, value_col: str, scope: list[str], own: list[str]) -> DataFrame:
    """Pairs (scope, own, value_col) of texts (scope, own, idx) and values (scope, value_col) that they hold, once each.

    indexed should be a written table, since keys and segments are read from it apart.
    """
    asked = extract.with_value(values.select(*scope, value_col).distinct(), value_col).withColumn("_n", F.monotonically_increasing_id())
    wanted = scratch.written(asked.select(*scope, value_col, "_n", "v_kind", "v_key", "v_norm"), "wanted")
    keys = F.concat(F.transform("idx.dates", lambda d: F.concat(F.lit("d:"), d["day"].cast("string"))), F.transform("idx.numbers", lambda n: F.concat(F.lit("n:"), n["value"])))
    typed = indexed.select(*scope, *own, F.explode(F.array_distinct(keys)).alias("v_key")).distinct()
    by_key = wanted.where("v_kind <> 'name'").join(typed, [*scope, "v_key"]).select(*scope, *own, value_col)
    segs = indexed.select(*scope, *own, F.explode(F.array_distinct("idx.seg_norm")).alias("_seg")).where("_seg <> ''")
    segs = scratch.written(segs.withColumn("_s", F.monotonically_increasing_id()), "segments")
    names = wanted.where("v_kind = 'name' AND v_norm <> ''")
    pairs = names_join(segs, names.select(*scope, "_n", F.col("v_norm").alias("_p")), scope)
    of_text = pairs.join(segs.select("_s", *own), "_s") if own else pairs
    by_name = of_text.select("_n", *own).distinct().join(names.select(*scope, value_col, "_n"), "_n").select(*scope, *own, value_col)
    return by_key.unionByName(by_name).distinct()
