"""Queries over notes with free keys, as VARIANT: of events, and of the audit's questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import notes
from factloom.operators import audit
from factloom.plans import texts
from factloom.plans.registry import SQL, query
from factloom.sources import scratch

#: What is put into an event's properties, by event_id modulo 7; the last is no JSON.
_MORE = [', "derivation": null', ', "derivation": "sum", "k2": 1.50', ', "tags": ["a"]', ', "k": "x"', "", ', "ok": true', ', "broken']
_EVENTS = f"""e AS (SELECT event_id, event_type, CASE event_id % 7 {' '.join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(_MORE) if k != 3)} ELSE '' END AS more, props FROM events),
j AS (SELECT event_id, event_type, CASE event_id % 7 WHEN 3 THEN '{{"k": "x"}}' ELSE substr(props, 1, length(props) - 1) || more || '}}' END AS doc FROM e),
v AS (SELECT event_id, event_type, CASE WHEN json_valid(doc) THEN CAST(doc AS JSON) END AS notes FROM j)"""


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, event_type, notes): the events' properties with more keys, written as VARIANT."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "props")
    more: Column = F.element_at(F.array(*map(F.lit, _MORE)), (F.col("event_id") % 7).cast("int") + 1)
    doc = F.when(F.col("event_id") % 7 == 3, '{"k": "x"}').otherwise(F.concat(F.expr("substr(props, 1, length(props) - 1)"), more, F.lit("}")))
    return scratch.written(e.select("event_id", "event_type", notes.parsed(doc).alias("notes")), "notes")


@query(f"""WITH {_EVENTS}, k AS (SELECT event_type, notes, unnest(json_keys(notes)) AS key FROM v),
t AS (SELECT event_type, key, json_type(notes, '$.' || key) AS type FROM k)
SELECT event_type, key, CASE WHEN type IN ('UBIGINT', 'BIGINT') THEN 'BIGINT' WHEN type = 'DOUBLE' THEN 'DECIMAL(2,1)' WHEN type = 'VARCHAR' THEN 'STRING' WHEN type = 'NULL' THEN 'VOID' WHEN type = 'ARRAY' THEN 'ARRAY<STRING>' ELSE type END AS type, count(*) AS n FROM t GROUP BY ALL""")
def note_keys(spark, sf_dir):
    """Which keys the notes of each kind of event have, and of what types."""
    return notes.profile(_notes(spark, sf_dir), ["event_type"]).select("event_type", "key", "type", "n")


@query(f"""WITH {_EVENTS} SELECT event_id, coalesce(json_exists(notes, '$.derivation'), false) AS derived, json_extract_string(notes, '$.derivation') AS derivation,
 CAST(TRY_CAST(json_extract_string(notes, '$.k') AS BIGINT) AS VARCHAR) AS k, notes IS NULL AS broken FROM v""")
def note_values(spark, sf_dir):
    """Presence of a key whatever its value, the value, and a column of a fixed type; notes that are no JSON are null."""
    n = _notes(spark, sf_dir)
    return notes.columns(n, {"k": "bigint"}).select("event_id", notes.has(n, "derivation").alias("derived"), notes.text(n, "derivation").alias("derivation"), F.col("k").cast("string").alias("k"), F.col("notes").isNull().alias("broken"))


@query(f"""{SQL['audit_findings'].replace("ELSE name END AS token", "WHEN m IN (9, 10) THEN 'Sum ' || k ELSE name END AS token").replace("m <> 1 AND token", "m NOT IN (1, 9) AND token")}""")
def audit_findings_variant(spark, sf_dir):
    """The audit over questions whose notes are VARIANT. A derived answer (the key is there, with JSON's null) needn't stand in the facts; notes that name the key as a value aren't derived."""
    questions, facts, corpus = texts._audited(spark, sf_dir)
    k = F.substring("question_id", 2, 20)
    m = k.cast("long") % 50
    token = F.when(m.isin(9, 10), F.concat(F.lit("Sum "), k)).otherwise(F.col("gold_answer"))
    own = notes.as_variant(questions).withColumn("notes", F.when(m == 9, notes.parsed(F.lit('{"derivation": null}'))).when(m == 10, notes.parsed(F.lit('{"rule": "derivation"}'))).otherwise(F.col("notes")))
    own = scratch.written(own.withColumns({"gold_answer": token, "gold_tokens": F.array(token)}), "variant")
    return audit.dry_run(own, facts, corpus).select("question_id", "check", "detail")
