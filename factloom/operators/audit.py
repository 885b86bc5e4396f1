"""The judge, and the audit of questions and answers.

A corpus is indexed once, and the values asked for meet it on canonical keys and
their rarest words (containment.values_join). An answer is judged in its own row, and the
question's verdict is a CASE over aggregates.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import canon, extract, notes, values
from factloom.functions.canon import let
from factloom.sources import scratch

from . import containment
from . import temporal as t
from .validate import flagged_questions, violation_rows


def corpus_holds(tokens: DataFrame, corpus: DataFrame, token_col: str = "token") -> DataFrame:
    """tokens (seed, token) with `present`: whether any text of the seed's corpus holds the value."""
    idx = scratch.written(extract.text_index(corpus.select("seed", "text"), "text", parts=extract.VALUES).select("seed", "idx"), "corpus")
    found = containment.values_join(idx, tokens, token_col, ["seed"], []).withColumn("present", F.lit(True))
    return tokens.join(found, ["seed", token_col], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def required_tokens(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """(seed, question_id, token): gold tokens of plain value questions, else the evidence values."""
    plain = (F.col("gold_kind") == "value") & ~notes.has(questions, "derivation")
    gold = questions.where(plain).select("seed", "question_id", F.explode("gold_tokens").alias("token"))
    ids = questions.where(~plain).select("seed", "question_id", F.explode("evidence_fact_ids").alias("fact_id"))
    return gold.unionByName(ids.join(facts.select("seed", "fact_id", F.col("value").alias("token")), ["seed", "fact_id"]).select("seed", "question_id", "token"))


def forbidden_tokens(questions: DataFrame) -> DataFrame:
    return questions.select("seed", "question_id", notes.text(questions, "fabricated_io_id").alias("token")).where("token IS NOT NULL")


def corpus_support(questions: DataFrame, facts: DataFrame, corpus: DataFrame) -> DataFrame:
    """(seed, question_id, supported, absent, wrongly_present), one row a question."""
    need = required_tokens(questions, facts).withColumn("must", F.lit(True)).unionByName(forbidden_tokens(questions).withColumn("must", F.lit(False)))
    held = corpus_holds(scratch.written(need, "need"), corpus)
    bad = held.groupBy("seed", "question_id").agg(F.sort_array(F.collect_set(F.when(F.col("must") & ~F.col("present"), F.col("token")))).alias("absent"), F.sort_array(F.collect_set(F.when(~F.col("must") & F.col("present"), F.col("token")))).alias("wrongly_present"))
    none = F.array().cast("array<string>")
    out = questions.select("seed", "question_id").join(bad, ["seed", "question_id"], "left").withColumns({c: F.coalesce(c, none) for c in ("absent", "wrongly_present")})
    return out.withColumn("supported", (F.size("absent") == 0) & (F.size("wrongly_present") == 0))


def dry_run(questions: DataFrame, facts: DataFrame, corpus: DataFrame) -> DataFrame:
    """(seed, question_id, check, detail): all findings that need no answers."""
    flagged = flagged_questions(questions)
    schema = violation_rows(flagged, "question_id").select("seed", F.col("key").alias("question_id"), F.lit("schema").alias("check"), F.concat_ws(": ", "check", "detail").alias("detail"))
    ok = flagged.where("size(violations) = 0").select(*questions.columns)  # each row by its own rules, whatever its id

    def finding(df: DataFrame, check: str, detail: Column) -> DataFrame:
        return df.select("seed", "question_id", F.lit(check).alias("check"), detail.cast("string").alias("detail"))

    known = t.with_successor(facts).select("seed", "fact_id", "value", "injection", "never_memorize", "validity_interval", "succ_start", F.lit(True).alias("known"))
    evidence = ok.select("seed", "question_id", F.explode("evidence_fact_ids").alias("fact_id"))
    gold = ok.where((F.col("gold_kind") == "value") & ~notes.has(ok, "derivation")).select("seed", "question_id", F.explode("gold_tokens").alias("token"))
    gold = gold.withColumn("v_key", canon.key_of("token"))
    shown = evidence.join(known.select("seed", "fact_id", canon.key_of("value").alias("v_key")), ["seed", "fact_id"]).select("seed", "question_id", "v_key")
    trace = finding(gold.join(shown, ["seed", "question_id", "v_key"], "left_anti"), "gold_traceability", F.col("token"))

    points = ok.select("seed", "question_id", "as_of", F.inline("expected_memory_points")).withColumnRenamed("status", "listed").join(known, ["seed", "fact_id"], "left")
    again = t.status(F.col("as_of"))
    wrong = F.when(F.col("known").isNull(), F.concat(F.lit("unknown fact "), "fact_id")).when(~t.memorable(), F.concat("fact_id", F.lit(" must not be a memory point"))).when(~F.col("listed").eqNullSafe(again), F.concat("fact_id", F.lit(" is listed "), "listed", F.lit(" but recomputes to "), F.coalesce(again, F.lit("not known yet"))))
    memory = finding(points.withColumn("wrong", wrong).where("wrong IS NOT NULL"), "memory_point", F.col("wrong"))

    seen = evidence.join(known, ["seed", "fact_id"], "left")
    unknown = finding(seen.where("known IS NULL"), "evidence", F.col("fact_id"))
    listed = ok.select("seed", "question_id", F.inline("expected_memory_points")).select("seed", "question_id", "fact_id")
    unlisted = finding(seen.where(F.col("known").isNotNull() & t.memorable()).join(listed, ["seed", "question_id", "fact_id"], "left_anti"), "memory_point_missing", F.col("fact_id"))

    support = scratch.written(corpus_support(ok, facts, corpus), "support")
    absent = finding(support.where("size(absent) > 0"), "corpus_presence", F.to_json("absent"))
    present = finding(support.where("size(wrongly_present) > 0"), "corpus_absence", F.to_json("wrongly_present"))
    naming = finding(ok.where("io_id IS NOT NULL AND instr(text, io_id) = 0"), "io_naming", F.col("io_id"))
    out = schema
    for more in (trace, memory, unknown, unlisted, absent, present, naming):
        out = out.unionByName(more)
    return out


def _cue_column(idx: Column, cues: list[str]) -> Column:
    """The first cue that an indexed text holds; cues are names, never dates or numbers."""
    plain = F.split(F.lit("\n".join(f" {re.sub('[^0-9a-z]+', ' ', c.casefold()).strip()} " for c in cues)), "\n")
    held = let(F.transform(idx["seg_norm"], extract.padded), lambda segs: F.transform(plain, lambda c: F.exists(segs, lambda s: F.contains(s, c))))
    return let(F.array_position(held, True), lambda k: F.when(k > 0, F.get(F.split(F.lit("\n".join(cues)), "\n"), (k - 1).cast("int"))))


@canon.once
def _judgement() -> tuple[dict[str, Column], dict[str, Column]]:
    """What judge() adds to indexed answers: columns that it needs on the way, and its own."""
    blank = F.coalesce(F.col("answer").rlike(r"^\s*$"), F.lit(True))
    cue = F.lit(None).cast("string")
    for sentinel, cues in values.SENTINEL_CUES.items():
        cue = F.when(F.col("gold_answer") == sentinel, _cue_column(F.col("idx"), cues)).otherwise(cue)
    is_sentinel = F.col("gold_kind") == "sentinel"
    first = {
        "_cue": F.when(is_sentinel, cue),
        "_hits": F.when(~is_sentinel & ~blank, F.transform("gold_tokens", lambda t: F.struct(t.alias("token"), extract.value_in_text(t, F.col("idx")).alias("hit")))),
    }
    none = F.array().cast("array<string>")

    def picked(hit: Column) -> Column:
        return F.coalesce(F.transform(hit, lambda x: x["token"]), none)

    found, lost = picked(F.filter("_hits", lambda x: x["hit"])), picked(F.filter("_hits", lambda x: ~x["hit"]))
    matched = F.when(blank, False).when(is_sentinel, F.col("_cue").isNotNull()).otherwise(F.size(lost) == 0)
    told = {k: values.filled(v) for k, v in values.REASONS.items()}
    reason = F.when(F.col("answer").isNull(), told["none"]).when(blank, told["empty"]).when(is_sentinel & matched, told["expressed"])
    reason = reason.when(is_sentinel, told["not_expressed"]).when(matched, told["all"]).otherwise(told["missing"])
    return first, {
        "matched": matched, "judge_reason": reason,
        "matched_tokens": F.when(blank, none).when(is_sentinel, F.when(matched, F.array("_cue")).otherwise(none)).otherwise(found),
        "missing_tokens": F.when(blank, none).when(is_sentinel, F.when(matched, none).otherwise(F.array("gold_answer"))).otherwise(lost),
        "refusal": _cue_column(F.col("idx"), values.refusal_cues()).isNotNull(),
    }


def judge(answers: DataFrame) -> DataFrame:
    """answers (gold_kind, gold_answer, gold_tokens, answer, ...) with matched, judge_reason, matched_tokens, missing_tokens, refusal and idx.

    A sentinel matches if any of its cues stands in the answer (the first is
    reported); a value if all gold tokens do. Null and blank answers don't match.
    A projection: each answer is judged in the row that it is in.
    """
    first, own = _judgement()
    return extract.text_index(answers, "answer", parts=extract.VALUES).withColumns(first).withColumns(own).drop("_cue", "_hits")


def injected_values(facts: DataFrame) -> DataFrame:
    """(seed, lie): every planted false value once."""
    return facts.where("injection").select("seed", F.col("value").alias("lie")).distinct()


def swallowed(judged: DataFrame, facts: DataFrame) -> DataFrame:
    """(seed, question_id, swallowed): the planted lies that each answer holds, the question's own first, then the others by value."""
    own = judged.select("seed", "question_id", notes.text(judged, "injected_value").alias("lie"), F.lit(0).alias("rank")).where("lie IS NOT NULL")
    every = injected_values(facts)
    held = scratch.written(containment.values_join(judged.select("seed", "question_id", "idx"), every.unionByName(own.select("seed", "lie")), "lie", ["seed"], ["question_id"]), "held")
    # another question's own lie counts only where it is a planted value
    planted = held.join(every, ["seed", "lie"], "left_semi").withColumn("rank", F.lit(1))
    both = held.join(own, ["seed", "question_id", "lie"]).unionByName(planted, allowMissingColumns=True)
    return both.groupBy("seed", "question_id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("rank", "lie"))), lambda s: s["lie"])).alias("swallowed"))


def classify(questions: DataFrame, answers: DataFrame, facts: DataFrame, corpus: DataFrame) -> DataFrame:
    """A verdict for each question: answered, deceived, oracle_failed or unanswerable, in this order."""
    judged = scratch.written(judge(questions.join(answers.select("question_id", "answer"), "question_id", "left")), "judged")
    lies = scratch.written(swallowed(judged, facts), "lies")
    df = judged.join(lies, ["seed", "question_id"], "left").join(corpus_support(questions, facts, corpus), ["seed", "question_id"])
    deceived = F.size(F.coalesce("swallowed", F.array().cast("array<string>"))) > 0
    verdict = F.when(F.col("matched"), "answered").when(deceived, "deceived").when(F.col("supported"), "oracle_failed").otherwise("unanswerable")
    reason = F.when(verdict == "answered", F.col("judge_reason")).when(verdict == "deceived", F.concat(F.lit("answer contains injected values "), F.to_json("swallowed")))
    reason = reason.when(verdict == "oracle_failed", "evidence is in the corpus and the answer misses it").otherwise(F.concat(F.lit("evidence is not in the corpus: absent "), F.to_json("absent"), F.lit(", wrongly present "), F.to_json("wrongly_present")))
    return df.select(
        "seed", "question_id", "type", "query_kind", "gold_kind", "gold_answer", "answer", verdict.alias("verdict"), reason.alias("reason"),
        F.col("matched_tokens").alias("judge_matched_tokens"), F.col("missing_tokens").alias("judge_missing_tokens"),
        F.when((verdict == "deceived") & F.col("refusal"), "mention_in_refusal").alias("match_dispute"))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """(seed, verdict, n), zero where a seed has none."""
    every = verdicts.select("seed").distinct().select("seed", F.explode(F.array(*map(F.lit, values.VERDICTS))).alias("verdict"))
    return every.join(verdicts.groupBy("seed", "verdict").agg(F.count("*").alias("n")), ["seed", "verdict"], "left").na.fill(0, ["n"])
