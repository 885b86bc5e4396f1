"""Quality rules: learned decision lists as ordered Spark conditional expressions.

Statistics of whole texts come from SQL functions. A decision list is learned
from the labelled rows by sequential covering: a rule grows one threshold
condition at a time, the one of the best gain for low quality among the rows
not yet covered; it is pruned back on rows kept apart; rules are added while
they hold up there. Growing a condition needs one aggregate over all labelled
rows: counts by statistic, bin and label, at most len(STATS) * BINS rows, from
which every threshold in both directions is read off. Nothing else comes to the
driver. The list becomes one CASE expression.

Defined results: null text has no words; lines are split at \\n and count if they
have a word; words in repeated windows count once each, the first occurrence
included; without labels (or with one class) no rule is learned and the base
rules decide alone; null labels are not used. Repeated rows are judged alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, materialize, table, text_or_empty

SYMBOLS = "#*$%&|<>"
REPEAT_WORDS = 5
MIN_WORDS = 10
MAX_REPEATED = 20  # percent of words

BINS = 64
MAX_RULES = 8
MAX_CONDITIONS = 3
#: A rule must cover so many low-quality rows, and so purely, when it grows and when it is pruned.
LEAST_COVER = 5
LEAST_PURITY = 0.9

#: Statistics that rules may use, by name: expressions over the columns of statistics().
STATS = {
    "n_words": "n_words",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "duplicate_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_chars, 1)",
    "exclamations_per_word": "n_exclaim / greatest(n_words, 1)",
    "distinct_word_share": "n_distinct_words / greatest(n_words, 1)",
}


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns n_words .. n_distinct_words; the text column is read once."""
    text, words = "_own_text", "_own_words"
    w, h = F.col(words), F.col("_own_hashed")
    n = F.size(w)
    span = REPEAT_WORDS
    # each word is hashed once, and a window hashes the hashes of its words
    windows = F.transform(F.slice(h, 1, F.greatest(n - span + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, span))))
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(WORD))
    out = docs.withColumn(text, text_or_empty(text_col))
    out = out.withColumns({words: F.regexp_extract_all(F.col(text), F.lit(WORD), 0), "_own_lines": lines})
    out = out.withColumn("_own_hashed", F.transform(w, lambda x: F.xxhash64(x)))
    out = out.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(F.col(text), f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_lines": F.size("_own_lines").cast("long"),
        "n_dup_lines": (F.size("_own_lines") - F.size(F.array_distinct("_own_lines"))).cast("long"),
        "n_upper": F.length(F.regexp_replace(F.col(text), r"[^\p{Lu}]+", "")).cast("long"),
        "n_exclaim": F.length(F.regexp_replace(F.col(text), "[^!]+", "")).cast("long"),
        "n_chars": F.length(text).cast("long"),
        "n_distinct_words": F.size(F.array_distinct(h)).cast("long"),
        "_own_windows": windows,
    })
    return _with_repeats(out, "_own_windows", span).drop(text, words, "_own_lines", "_own_hashed", "_own_windows")


def _with_repeats(df: DataFrame, windows: str, span: int) -> DataFrame:
    """Adds n_repeat_words: the words in windows that occur twice or more.

    Texts with such windows have them sorted with their places; the places of
    equal neighbours, in order, cover span words each or up to the next place.
    Every step is a column of its own, so that none is computed twice.
    """
    w = F.col(windows)
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("_own_placed", F.when(F.size(F.array_distinct(w)) < F.size(w), F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))
    placed = F.col("_own_placed")
    df = df.withColumns({"_own_after": F.slice(placed, 2, F.greatest(F.size(placed), F.lit(1)))})
    # s repeats with its follower: both places count
    both = F.filter(F.zip_with(placed, F.col("_own_after"), lambda s, t: F.struct(s["i"].alias("a"), t["i"].alias("b"), (s["h"] == t["h"]).alias("same"))), lambda x: x["same"])
    df = df.withColumn("_own_twice", F.when(F.size(placed) > 0, both))
    at = F.sort_array(F.array_union(F.col("_own_twice")["a"], F.col("_own_twice")["b"]))
    df = df.withColumn("_own_at", at)
    nxt = F.concat(F.slice("_own_at", 2, F.greatest(F.size("_own_at"), F.lit(1))), F.array(F.lit(1 << 30)))
    total = F.aggregate(F.zip_with("_own_at", nxt, lambda a, b: F.least(b - a, F.lit(span))), F.lit(0), lambda x, y: x + y)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("_own_placed", "_own_after", "_own_twice", "_own_at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    stat: str
    above: bool
    bound: float

    def column(self) -> Column:
        value = F.expr(STATS[self.stat])
        return value > self.bound if self.above else value <= self.bound


def all_of(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def as_expression(rules: list[list[Condition]]) -> Column:
    """Number of the first rule that fits, 0 if none: an ordered CASE."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(all_of(rule), k) if out is None else out.when(all_of(rule), k)
    return F.lit(0) if out is None else out.otherwise(0)


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> list[list[Condition]]:
    """A decision list for label 0, from all labelled rows of stats that pass the base rules."""
    label = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).alias("label")).where("label IS NOT NULL").groupBy("label_id").agg(F.min("label").alias("label"))
    names = list(STATS)
    used = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper", "n_exclaim", "n_chars", "n_distinct_words", "n_repeat_words"]
    rows = stats.where(~base_failed()).join(label, F.col(id_col) == F.col("label_id")).select(*used, (F.col("label") == 0).cast("int").alias("low"), (F.pmod(F.xxhash64("label_id", F.lit(11)), F.lit(3)) == 0).alias("apart"))
    rows = materialize(rows, "labelled")
    edges = rows.agg(*(F.expr(f"approx_percentile({STATS[s]}, array({', '.join(str(k / BINS) for k in range(1, BINS))}), 2000)").alias(s) for s in names)).first()
    bounds = {s: sorted({float(v) for v in edges[s]} | {0.0}) if edges[s] else [] for s in names}
    rules: list[list[Condition]] = []
    left = F.lit(True)
    while len(rules) < MAX_RULES:
        rule = _grow(rows.where(left & ~F.col("apart")), names, bounds)
        rule = _prune(rows.where(left & F.col("apart")), rule)
        if not rule:
            break
        rules.append(rule)
        left = left & ~all_of(rule)
    return rules


def _counts(rows: DataFrame, names: list[str], bounds: dict) -> dict[str, list[list[int]]]:
    """By statistic: [rows of high, of low quality] for each bin between its bounds."""
    stacked = rows.select("low", F.explode(F.array(*(F.struct(F.lit(k).alias("s"), _bin(F.expr(STATS[s]), bounds[s]).alias("b")) for k, s in enumerate(names)))).alias("x"))
    out = {s: [[0, 0] for _ in range(len(bounds[s]) + 1)] for s in names}
    for r in stacked.groupBy("x.s", "x.b", "low").count().collect():
        out[names[r["s"]]][r["b"]][r["low"]] += r["count"]
    return out


def _bin(value: Column, bounds: list[float]) -> Column:
    """How many bounds value is above."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b < value))


def _grow(rows: DataFrame, names: list[str], bounds: dict) -> list[Condition]:
    rule: list[Condition] = []
    for _ in range(MAX_CONDITIONS):
        counts = _counts(rows.where(all_of(rule)), names, bounds)
        high, low = (sum(b[k] for b in counts[names[0]]) for k in (0, 1))
        if not low or not high:
            break
        best = None
        for s in names:
            below = [0, 0]
            for k, bound in enumerate(bounds[s]):
                below = [below[0] + counts[s][k][0], below[1] + counts[s][k][1]]
                for above, (h, w) in ((False, below), (True, (high - below[0], low - below[1]))):
                    # the gain of covering w low rows, as in first-order rule learning
                    if w >= LEAST_COVER and h + w < high + low:
                        gain = w * (math.log2(w / (h + w)) - math.log2(low / (high + low)))
                        if best is None or gain > best[0] + 1e-9:
                            best = gain, Condition(s, above, bound)
        if best is None or best[0] <= 0:
            break
        rule.append(_widest(rows.where(all_of(rule)), best[1]))
    return rule


def _widest(rows: DataFrame, found: Condition) -> Condition:
    """The same split with its bound half-way between the values on its two sides."""
    value = F.expr(STATS[found.stat])
    ends = rows.agg(F.max(F.when(value <= found.bound, value)).alias("low"), F.min(F.when(value > found.bound, value)).alias("high")).first()
    if ends["low"] is None or ends["high"] is None:
        return found
    return Condition(found.stat, found.above, (float(ends["low"]) + float(ends["high"])) / 2)


def _prune(rows: DataFrame, rule: list[Condition]) -> list[Condition]:
    """The shortest of the best beginnings of rule on rows kept apart; none if even that isn't pure enough."""
    if not rule:
        return []
    cuts = range(1, len(rule) + 1)
    sums = rows.agg(*(F.count_if(all_of(rule[:k]) & (F.col("low") == v)).alias(f"c{k}_{v}") for k in cuts for v in (0, 1))).first()
    best, value = [], 0.0
    for k in cuts:
        high, low = sums[f"c{k}_0"], sums[f"c{k}_1"]
        if low and low / (low + high) >= LEAST_PURITY and (low - high) / (low + high) * math.log2(1 + low) > value + 1e-9:
            best, value = rule[:k], (low - high) / (low + high) * math.log2(1 + low)
    return best


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Rows (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule), one for each row of docs."""
    slim = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    stats = materialize(statistics(slim).drop("text"), "stats")
    rules = learn(stats, labels, id_col, label_col)
    return stats.withColumns({"base_failed": base_failed(), "rule": as_expression(rules)}).select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule",
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
