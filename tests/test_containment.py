"""Containment by rarest word, and records judged by their own rows."""

import json
import random
import time

from pyspark.sql import functions as F

from factloom.functions import extract, values
from factloom.operators import audit, containment
from factloom.sources import scratch
from factloom.streaming import ingest


def joined(spark, texts, names):
    idx = extract.text_index(spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "seed int, k int, text string"), parts=extract.VALUES).select("seed", "k", "idx")
    wanted = spark.createDataFrame([(1, n) for n in names] + [(2, n) for n in names[:3]], "seed int, v string")
    return containment.values_join(scratch.written(idx, "idx"), wanted, "v", ["seed"], ["k"])


def test_names_like_all_pairs(spark):
    r = random.Random(1)
    words = ["deal", "the", "line", *(f"w{k}" for k in range(12))]
    texts = [" ".join(r.choices(words, k=r.randrange(1, 14))) + r.choice([".", "\nDeal line", ""]) for _ in range(150)]
    names = list({" ".join(r.choices(words, k=r.choice((1, 2, 2, 3, 4)))) for _ in range(120)}) + ["nowhere", "deal nowhere", "Deal  LINE"]
    got = {(x["k"], x["v"]) for x in joined(spark, texts, names).collect()}
    segs = [[f" {s.strip().lower()} " for line in t.split("\n") for s in line.replace(".", " ").split("\n")] for t in texts]
    assert got == {(k, n) for k, ss in enumerate(segs) for n in names if any(f" {' '.join(n.lower().split())} " in s for s in ss)} and len(got) > 500


def test_names_with_a_common_first_word_meet_few_texts(spark):
    """All names begin with one word that every text holds: times grow in proportion, not with the square."""
    took = []
    for n in (500, 5_000, 20_000):
        r = random.Random(n)
        texts = [f"The account is Customer {r.randrange(2 * n):09d}x Group now" for _ in range(n)]
        names = [f"customer {k:09d}x group" for k in range(n)]
        start = time.perf_counter()
        found = joined(spark, texts, names).count()
        took.append(time.perf_counter() - start)
        assert found == sum(t.lower().split(" is ")[1].rsplit(" ", 1)[0] in set(names) for t in texts)
    assert took[2] < 8 * took[1]


def test_heavy_words_meet_by_pairs(spark):
    segs = scratch.written(spark.createDataFrame([(1, k, f"alpha {'beta' if k % 2 else 'gamma'} delta {k % 90}") for k in range(400)], "seed int, _s long, _seg string"), "segs")
    names = scratch.written(spark.createDataFrame([(1, 1, "alpha beta"), (1, 2, "beta delta"), (1, 3, "alpha"), (1, 4, "gamma beta"), (1, 5, "delta 7")], "seed int, _n long, _p string"), "names")
    got = {r["_n"]: r["count"] for r in containment.names_join(segs, names, ["seed"]).groupBy("_n").count().collect()}
    assert got == {1: 200, 2: 200, 3: 400, 5: 5} and containment.HEAVY < 200


# --- records by their own rules


def record(**changes):
    fact = {
        "seed": 1, "fact_id": "F1", "entity": "deal", "entity_id": "D1", "event_id": "V1", "attribute": "budget_usd", "value": "5", "validity_interval": {"start": "2024-01-01", "end": None}, "volatility_class": "durable",
        "channel": "call_note", "author": "user", "trust_class": "first_party_note", "supersedes": None, "plausibility": None, "injection": False, "never_memorize": False,
    }
    return json.dumps(fact | changes)


def test_a_stream_is_split_by_row(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [record(), "no json at all", record(fact_id=None), record(fact_id="F2"), record(fact_id="F2", value=" "), record(fact_id=None, entity="planet"), "{}", record(fact_id="F3", seed=None), '{"fact_id": ']
    (tmp_path / "in" / "a.json").write_text("\n".join(lines) + "\n")
    run = lambda: ingest.ingest(ingest.fact_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/facts", f"{tmp_path}/bad", f"{tmp_path}/check").awaitTermination()
    run()
    facts = spark.read.parquet(f"{tmp_path}/facts")
    assert [c for c in facts.columns if c != "batch"] == spark.createDataFrame([], values.FACT_DDL).columns
    assert sorted(r["fact_id"] for r in facts.collect()) == ["F1", "F2", "F3"]
    bad = sorted(map(repr, ((r["check"], r["key"], r["detail"]) for r in spark.read.parquet(f"{tmp_path}/bad").where("check IN ('json', 'fact_id_id', 'value_blank', 'entity_choice') AND NOT (check = 'fact_id_id' AND key IS NOT NULL)").collect())))
    assert ("json", None, "no json at all") in map(eval, bad) and ("json", None, '{"fact_id": ') in map(eval, bad) and ("value_blank", "F2", "") in map(eval, bad)
    assert sum(eval(b)[0] == "fact_id_id" for b in bad) == 3 and sum(eval(b)[0] == "entity_choice" for b in bad) == 2  # a planet, and none
    (tmp_path / "in" / "b.json").write_text(record(fact_id="F4") + "\n")
    run()  # goes on from its checkpoint
    assert sorted(r["fact_id"] for r in spark.read.parquet(f"{tmp_path}/facts").collect()) == ["F1", "F2", "F3", "F4"]


def test_a_question_without_an_id_stops_at_its_schema(spark):
    q = dict(
        question_id=None, seed=1, type="single_fact", query_kind="exact", text="Which name does A1 go by now?", as_of="2025-01-01", as_of_horizon="current", gold_kind="value", gold_answer="x", gold_tokens=["x"],
        expected_memory_points=[], evidence_event_ids=["V1"], evidence_fact_ids=["Z9"], entity="advertiser", entity_id="A1", io_id=None, touches_injection=False, touches_never_memorize=False, notes={})
    rows = [q, q | {"question_id": "Q1"}]
    ddl = values.QUESTION_DDL
    df = spark.read.schema(ddl).json(spark.sparkContext.parallelize([json.dumps(x) for x in rows]))
    found = audit.dry_run(df, spark.createDataFrame([], values.FACT_DDL), spark.createDataFrame([], "seed int, event_id string, text string")).where(F.col("check").isin("schema", "evidence")).collect()
    assert sorted((r["question_id"] or "", r["check"]) for r in found) == [("", "schema"), ("Q1", "evidence")]
