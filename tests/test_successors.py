"""The successor map over a stream of facts in any order, with a restart."""

import json
import random
import time

from factloom.functions import values
from factloom.operators import temporal
from factloom.streaming import ingest, successors


def record(k, before, start="2024-01-01", **changes):
    fact = {
        "seed": 1, "fact_id": k, "entity": "deal", "entity_id": "D1", "event_id": "V1", "attribute": "budget_usd", "value": "5", "validity_interval": {"start": start, "end": None}, "volatility_class": "durable",
        "channel": "call_note", "author": "user", "trust_class": "first_party_note", "supersedes": before, "plausibility": None, "injection": False, "never_memorize": False,
    }
    return json.dumps(fact | changes)


def made():
    """Chains of 1 to 9 facts, forks, successors of facts that never come, and broken records."""
    r, lines = random.Random(8), []
    for chain in range(25):
        ids = [f"F{chain}-{k}" for k in range(r.randrange(1, 10))]
        lines += [record(i, b, f"2024-{1 + k:02d}-{1 + chain:02d}") for k, (i, b) in enumerate(zip(ids, [None, *ids], strict=False))]
    lines += [record("X1", "F0-0", "2023-05-05"), record("X2", "F0-0", "2023-05-05"), record("Y", "never"), record("Z", "F1-0", seed=2), record("B", "F2-0", value=" "), "no json"]
    r.shuffle(lines)
    return lines


def test_any_order_and_a_restart(spark, tmp_path):
    source, lines = tmp_path / "in", made()
    source.mkdir()

    def drop(k, part):
        (source / f"{k}.tmp").write_text("\n".join(part) + "\n")
        (source / f"{k}.tmp").rename(source / f"{k}.json")

    def run():
        stream = ingest.fact_stream(spark, str(source), files_per_batch=1)
        successors.follow(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()

    parts = [lines[k::5] for k in range(5)]
    for k in (0, 1):
        drop(k, parts[k])
    run()
    for k in (2, 3, 4):
        drop(k, parts[k])
    run()  # a query of its own, from the checkpoint
    bad = ("B",)
    facts = spark.read.schema(values.FACT_DDL).json(spark.sparkContext.parallelize([x for x in lines if x != "no json" and json.loads(x)["fact_id"] not in bad]))
    want = temporal.with_successor(facts).select("seed", "fact_id", "succ_id", "succ_start").collect()
    got = successors.successors(spark, f"{tmp_path}/out").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want))) and len(got) > 100
    assert {r["succ_id"] for r in got if r["fact_id"] == "F0-0"} == {"X1"}
    assert successors.dangling(spark, f"{tmp_path}/out").isEmpty()  # nothing is given up without a waiting time
    successors.compact(spark, f"{tmp_path}/out", f"{tmp_path}/table")
    assert spark.read.parquet(f"{tmp_path}/table").count() == len(got)


def test_waiting_for_predecessors(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text(record("F2", "F1") + "\n" + record("G2", "G1") + "\n")
    stream = ingest.fact_stream(spark, str(source), files_per_batch=1)
    q = successors.follow(stream, f"{tmp_path}/out", f"{tmp_path}/check", wait_ms=500, available_now=False)

    def until(done):
        end = time.time() + 60
        while time.time() < end and not done():
            time.sleep(0.5)
        assert done()

    def given():
        try:
            return {r["fact_id"] for r in successors.dangling(spark, f"{tmp_path}/out").collect()}
        except Exception:  # no batch is written yet, or one is being written
            return set()

    try:
        until(lambda: given() == {"F1", "G1"})
        (source / "b.json").write_text(record("F1", None) + "\n")
        until(lambda: given() == {"G1"})
        assert {(r["fact_id"], r["succ_id"]) for r in successors.successors(spark, f"{tmp_path}/out").collect()} == {("F2", None), ("G2", None), ("F1", "F2")}
    finally:
        q.stop()
