"""Record rules as violation tables (seed, check, key, detail); strict() raises instead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import values

from .temporal import KEY, by_seed, by_shuffle, cycles, end_day, memorable, start_day, status, with_successor, with_trust

ID = r"^[A-Za-z0-9][A-Za-z0-9_.:-]*$"


class EngineError(ValueError):
    """Raised by strict()."""


def _bad(check: str, when: Column, detail: Column | str) -> tuple[str, Column]:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return check, F.when(F.coalesce(when, F.lit(True)), F.struct(F.lit(check).alias("check"), detail.cast("string").alias("detail")))


def _flagged(df: DataFrame, rules: list[tuple[str, Column]], only: list[str] | None) -> DataFrame:
    """df with the column violations: the rules that each row breaks, as structs (check, detail)."""
    rules = [r for name, r in rules if only is None or name in only]
    return df.withColumn("violations", F.filter(F.array(*rules), lambda r: r.isNotNull()))


def violation_rows(flagged: DataFrame, key: str) -> DataFrame:
    """The violations of flagged rows, a row each."""
    return flagged.select("seed", F.col(key).alias("key"), F.inline("violations")).select("seed", "check", "key", "detail")


def _one_of(name: str, allowed: list[str]) -> tuple[str, Column]:
    return _bad(f"{name}_choice", ~F.col(name).isin(allowed), F.col(name))


def _identifier(name: str) -> tuple[str, Column]:
    return _bad(f"{name}_id", ~F.col(name).rlike(ID), F.col(name))


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name).rlike(r"^\s*$"), F.lit(True))


def fields(df: DataFrame, ddl: str) -> list[str]:
    """Missing and extra columns of a record table, as texts."""
    from pyspark.sql.types import StructType

    want, have = {f.name for f in StructType.fromDDL(ddl)}, set(df.columns)
    return [f"missing {c}" for c in sorted(want - have)] + [f"extra {c}" for c in sorted(have - want)]


def flagged_facts(facts: DataFrame, only: list[str] | None = None) -> DataFrame:
    """facts with the rules of single facts that each row breaks; only: the names of those to test."""
    f = with_trust(facts)
    snapshot = F.coalesce(F.col("never_memorize"), F.lit(False))
    injected = F.coalesce(F.col("injection"), F.lit(False))
    rules = [
        _identifier("fact_id"), _identifier("entity_id"), _identifier("event_id"),
        _one_of("entity", values.ENTITY_TYPES), _one_of("volatility_class", values.VOLATILITY_CLASSES), _one_of("channel", values.CHANNELS), _one_of("author", values.AUTHORS),
        _bad("attribute_blank", F.coalesce(F.col("attribute") == "", F.lit(True)), ""), _bad("value_blank", _blank("value"), ""),
        _bad("interval", start_day().isNull() | F.coalesce(end_day() < start_day(), F.lit(False)), F.to_json("validity_interval")),
        _bad("trust_unknown", F.col("derived_trust").isNull(), F.concat_ws("/", "channel", "author")),
        _bad("trust", F.col("derived_trust").isNotNull() & ~F.col("trust_class").eqNullSafe(F.col("derived_trust")), F.col("trust_class")),
        _bad("supersedes_id", F.coalesce(~F.col("supersedes").rlike(ID), F.lit(False)), F.col("supersedes")),
        _bad("injection_null", F.col("injection").isNull(), ""), _bad("never_memorize_null", F.col("never_memorize").isNull(), ""),
        _bad("plausibility", F.when(injected, ~F.coalesce(F.col("plausibility").isin(values.PLAUSIBILITY), F.lit(False))).otherwise(F.col("plausibility").isNotNull()), F.col("plausibility")),
        _bad("snapshot_volatility", snapshot & ~F.col("volatility_class").eqNullSafe(F.lit("ephemeral")), F.col("volatility_class")),
        _bad("snapshot_interval", snapshot & ~start_day().eqNullSafe(end_day()), F.to_json("validity_interval")),
    ]
    return _flagged(f, rules, only).select(*facts.columns, "violations")


def fact_violations(facts: DataFrame, only: list[str] | None = None) -> DataFrame:
    return violation_rows(flagged_facts(facts, only), "fact_id")


def event_violations(events: DataFrame, only: list[str] | None = None) -> DataFrame:
    ids = F.col("fact_ids")
    rules = [
        _identifier("event_id"), _identifier("advertiser_id"), _one_of("channel", values.CHANNELS), _one_of("author", values.AUTHORS),
        _bad("seed_null", F.col("seed").isNull(), ""), _bad("subject_blank", _blank("subject"), ""), _bad("timestamp", F.col("timestamp").isNull(), ""),
        _bad("scenario_kind", F.coalesce(F.col("scenario_kind") == "", F.lit(True)), ""),
        _bad("fact_ids", ids.isNull() | (F.size(ids) == 0) | F.exists(ids, lambda i: F.coalesce(~i.rlike(ID), F.lit(True))), F.to_json("fact_ids")),
        *(_bad(f"{c}_blank", F.col(c).isNotNull() & _blank(c), "") for c in ("agency_name", "contact_name", "deal_id", "io_id")),
    ]
    return violation_rows(_flagged(events, rules, only), "event_id")


def flagged_questions(questions: DataFrame, only: list[str] | None = None) -> DataFrame:
    """questions with the rules that each row breaks."""
    q = questions.join(F.broadcast(values.query_kinds(questions.sparkSession)), "type", "left")
    sentinel = F.col("gold_kind") == "sentinel"
    tokens, points = F.col("gold_tokens"), F.col("expected_memory_points")
    ids = F.concat(F.coalesce("evidence_event_ids", F.array()), F.coalesce("evidence_fact_ids", F.array()))
    rules = [
        _identifier("question_id"), _bad("seed_null", F.col("seed").isNull(), ""), _one_of("type", [t for t, _ in values.QUERY_KINDS]),
        _bad("query_kind", ~F.col("query_kind").eqNullSafe(F.col("assigned_kind")), F.col("query_kind")),
        _bad("text", F.length(F.trim("text")) < 12, F.col("text")), _bad("as_of", F.col("as_of").isNull(), ""),
        _one_of("as_of_horizon", values.HORIZONS), _one_of("gold_kind", values.GOLD_KINDS), _one_of("entity", values.ENTITY_TYPES),
        _bad("sentinel", sentinel & ~(F.col("gold_answer").isin(values.SENTINELS) & (tokens == F.array("gold_answer"))), F.col("gold_answer")),
        _bad("gold", ~sentinel & (_blank("gold_answer") | F.col("gold_answer").isin(values.SENTINELS) | (F.size(tokens) < 1) | F.exists(tokens, lambda t: F.coalesce(t.rlike(r"^\s*$"), F.lit(True)))), F.col("gold_answer")),
        _bad("points", points.isNull() | F.exists(points, lambda p: F.coalesce(~p["fact_id"].rlike(ID) | ~p["status"].isin(values.STATUSES), F.lit(True))), F.to_json("expected_memory_points")),
        _bad("evidence_ids", F.col("evidence_event_ids").isNull() | F.col("evidence_fact_ids").isNull() | F.exists(ids, lambda i: F.coalesce(~i.rlike(ID), F.lit(True))), F.to_json(F.struct(ids.alias("ids")))),
        _bad("io_id_id", F.col("io_id").isNotNull() & ~F.col("io_id").rlike(ID), F.col("io_id")),
        _bad("flags", F.col("touches_injection").isNull() | F.col("touches_never_memorize").isNull(), ""), _bad("notes", F.col("notes").isNull(), ""),
    ]
    return _flagged(q, rules, only).select(*questions.columns, "violations")


def question_violations(questions: DataFrame, only: list[str] | None = None) -> DataFrame:
    return violation_rows(flagged_questions(questions, only), "question_id")


def chain_violations(facts: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Rules across facts: pointers, revisited values, inverted intervals, transient ones superseded, two active values of a key."""
    def rows(df: DataFrame, check: str, key: str, detail: Column) -> DataFrame:
        return df.select("seed", F.lit(check).alias("check"), F.col(key).alias("key"), detail.cast("string").alias("detail"))

    twice = rows(facts.where("supersedes IS NOT NULL").groupBy("seed", "supersedes").agg(F.count("*").alias("n")).where("n > 1"), "superseded_twice", "supersedes", F.col("n"))
    prior = facts.select(F.col("seed").alias("p_seed"), F.col("fact_id").alias("p_id"), F.col("value").alias("p_value"), F.col("volatility_class").alias("p_vol"), F.col("validity_interval.start").alias("p_start"), F.col("entity_id").alias("p_entity"), F.col("attribute").alias("p_attribute"))
    pairs = facts.where("supersedes IS NOT NULL").join(by_shuffle(prior), (F.col("seed") == F.col("p_seed")) & (F.col("supersedes") == F.col("p_id")), "left")
    # one join serves all rules on a fact and the one before it, whose columns are null where there is none
    tests = [
        ("supersedes_unknown", F.col("p_id").isNull(), F.col("supersedes")), ("interval_inverted", start_day() <= F.col("p_start"), start_day()),
        ("transient_superseded", F.col("p_vol") == "transient", F.col("supersedes")), ("crosses_keys", (F.col("p_entity") != F.col("entity_id")) | (F.col("p_attribute") != F.col("attribute")), F.col("supersedes")),
    ]
    broken = F.filter(F.array(*(F.when(when, F.struct(F.lit(check).alias("check"), F.col("fact_id").alias("key"), detail.cast("string").alias("detail"))) for check, when, detail in tests)), lambda r: r.isNotNull())
    paired = pairs.select("seed", F.inline(broken))
    values_seen = facts.where(memorable()).groupBy(*KEY, "value").agg(F.count("*").alias("n"), F.min("fact_id").alias("fact_id")).where("n > 1")
    revisited = rows(values_seen, "value_revisited", "fact_id", F.col("value"))
    loop = rows(cycles(facts), "cycle", "fact_id", F.lit(""))
    at = F.col("as_of") if as_of is None else as_of
    late = facts.groupBy("seed").agg(F.date_add(F.max(start_day()), values.DEFAULTS["current_offset_days"]).alias("as_of"))
    active = with_successor(facts.where(memorable())).join(by_seed(late), "seed").where(status(at) == "active")
    double = rows(active.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("fact_id").alias("fact_id")).where("n > 1"), "duplicate_active", "fact_id", F.col("n"))
    out = twice
    for more in (paired, revisited, loop, double):
        out = out.unionByName(more)
    return out


def strict(df: DataFrame, violations: DataFrame) -> DataFrame:
    """df, or an EngineError that names the first violations and says how many there are."""
    found = violations.orderBy("seed", "check", "key").limit(5).collect()
    if found:
        raise EngineError(f"{violations.count()} violations: " + "; ".join(f"{r['check']} at {r['key']}: {r['detail']}" for r in found))
    return df
