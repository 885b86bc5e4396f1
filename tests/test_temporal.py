import datetime as d

import pytest
from pyspark.sql import functions as F

from factloom.functions import values
from factloom.operators import temporal as t
from factloom.operators import validate
from factloom.sources import scratch


def fact(i, entity_id, attribute, value, start, end=None, supersedes=None, **more):
    day = d.date.fromisoformat
    row = {"seed": 1, "fact_id": i, "entity": "order-line", "entity_id": entity_id, "event_id": "V1", "attribute": attribute, "value": value, "validity_interval": (day(start), day(end) if end else None),
           "volatility_class": "slow_changing", "channel": "order_system", "author": "system", "trust_class": "system_of_record", "supersedes": supersedes, "plausibility": None, "injection": False, "never_memorize": False}
    row.update(more)
    return tuple(row.values())


FACTS = [
    fact("F1", "L1", "cpm_rate", "20.00", "2025-01-10", "2025-02-28"),
    fact("F2", "L1", "cpm_rate", "24.00", "2025-03-01", supersedes="F1"),
    fact("F3", "L1", "pacing_status", "steady", "2025-02-01", "2025-02-15", volatility_class="transient"),
    fact("F4", "L1", "line_status", "booked", "2025-01-10", "2025-04-09"),
    fact("F5", "L1", "line_status", "cancelled", "2025-04-10", supersedes="F4"),
    fact("F6", "L1", "cpm_rate", "31.00", "2025-03-20", injection=True, plausibility="high", channel="email_received", author="user", trust_class="third_party_unverified"),
    fact("F7", "L1", "rate_card_cpm", "28.50", "2025-02-05", "2025-02-05", never_memorize=True, volatility_class="ephemeral"),
    fact("F8", "A1", "agency_of_record", "Zed Desk", "2025-01-05"),
    fact("F9", "L1", "cpm_rate_claimed", "26.00", "2025-03-05"),
]
WANT = {
    "2025-01-09": ("F8", "", ""), "2025-02-15": ("F1 F3 F4 F8", "", ""), "2025-02-16": ("F1 F4 F8", "", "F3"), "2025-02-28": ("F1 F4 F8", "", "F3"),
    "2025-03-01": ("F2 F4 F8", "F1", "F3"), "2025-04-09": ("F2 F4 F8 F9", "F1", "F3"), "2025-04-10": ("F2 F5 F8 F9", "F1 F4", "F3"), "2026-04-10": ("F2 F5 F8 F9", "F1 F4", "F3"),
}


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(FACTS, values.FACT_DDL)


def test_status_at_each_day(spark, facts):
    dates = spark.createDataFrame([(1, k, d.date.fromisoformat(k)) for k in WANT], "seed int, horizon string, as_of date")
    got = {k: {"active": [], "superseded": [], "expired": []} for k in WANT}
    for r in t.with_status(facts.where(t.memorable()), dates).collect():
        got[r["horizon"]][r["status"]].append(r["fact_id"])
    assert {k: tuple(" ".join(sorted(v)) for v in s.values()) for k, s in got.items()} == WANT


def test_current_values_and_chains(facts):
    now = {(r["entity_id"], r["attribute"]): r["value"] for r in t.current_values(facts).collect()}
    assert now[("L1", "cpm_rate")] == "24.00" and now[("L1", "line_status")] == "cancelled" and ("L1", "pacing_status") not in now
    assert {(r["root"], r["fact_id"], r["depth"]) for r in t.pointer_chains(facts).where("depth > 0").collect()} == {("F1", "F2", 1), ("F4", "F5", 1)}
    assert t.cycles(facts).isEmpty() and validate.chain_violations(facts).isEmpty() and validate.fact_violations(facts).isEmpty()


def test_long_chains_and_cycles(spark):
    day = d.date(2020, 1, 1)
    n = 300
    chain = [fact(f"F{k}", "L1", "cpm_rate", str(k), str(day + d.timedelta(k)), supersedes=f"F{k - 1}" if k else None) for k in range(n)]
    loop = [fact(f"C{k}", "L2", "cpm_rate", str(k), "2025-01-10", supersedes=f"C{(k + 1) % 5}") for k in range(5)]
    behind = [fact(f"B{k}", "L3", "cpm_rate", str(k), "2025-01-10", supersedes=f"B{k - 1}" if k else "C0") for k in range(90)]
    both = spark.createDataFrame([*chain, *loop, *behind], values.FACT_DDL)
    assert sorted((r["depth"], r["root"], r["fact_id"]) for r in t.pointer_chains(both).collect()) == [(k, "F0", f"F{k}") for k in range(n)]
    assert {r["fact_id"] for r in t.cycles(both).collect()} == {f[1] for f in (*loop, *behind)}
    assert "cycle" not in {r["check"] for r in validate.chain_violations(spark.createDataFrame(chain, values.FACT_DDL)).collect()}


def test_closing(spark, facts):
    loose = facts.withColumn("validity_interval", F.struct(t.start_day().alias("start"), F.lit(None).cast("date").alias("end")))
    ends = {r["fact_id"]: r["e"] for r in t.close_intervals(loose).select("fact_id", t.end_day().alias("e")).collect()}
    assert ends["F1"] == d.date(2025, 2, 28) and ends["F4"] == d.date(2025, 4, 9) and ends["F2"] is None


def changed(spark, i, **more):
    names = [f.name for f in spark.createDataFrame([], values.FACT_DDL).schema]
    return spark.createDataFrame([tuple({**dict(zip(names, r, strict=True)), **more}.values()) if r[1] == i else r for r in FACTS], values.FACT_DDL)


@pytest.mark.parametrize("i,change,check", [
    ("F5", {"supersedes": "F1"}, "superseded_twice"), ("F2", {"value": "20.00"}, "value_revisited"), ("F2", {"supersedes": None, "validity_interval": (d.date(2025, 1, 11), None)}, None),
    ("F9", {"attribute": "cpm_rate"}, "duplicate_active"), ("F5", {"supersedes": "F3"}, "transient_superseded"), ("F2", {"validity_interval": (d.date(2025, 1, 10), None)}, "interval_inverted"),
    ("F2", {"supersedes": "F99"}, "supersedes_unknown"), ("F1", {"supersedes": "F2"}, "cycle"),
])
def test_chain_mutants(spark, i, change, check):
    found = {r["check"] for r in validate.chain_violations(changed(spark, i, **change)).collect()}
    assert check in found if check else "interval_inverted" not in found


@pytest.mark.parametrize("i,change,check", [
    ("F7", {"validity_interval": (d.date(2025, 2, 5), d.date(2025, 2, 6))}, "snapshot_interval"), ("F1", {"plausibility": "low"}, "plausibility"), ("F6", {"plausibility": None}, "plausibility"), ("F1", {"trust_class": "first_party_note"}, "trust"),
    ("F1", {"author": "counterparty"}, "trust_unknown"), ("F1", {"value": "  "}, "value_blank"), ("F1", {"entity": "planet"}, "entity_choice"), ("F1", {"fact_id": "-x"}, "fact_id_id"), ("F1", {"validity_interval": (d.date(2025, 2, 5), d.date(2025, 2, 4))}, "interval"),
    ("F7", {"volatility_class": "durable"}, "snapshot_volatility"), ("F1", {"injection": None}, "injection_null"),
])
def test_fact_mutants(spark, i, change, check):
    bad = validate.fact_violations(changed(spark, i, **change))
    assert check in {r["check"] for r in bad.collect()}
    with pytest.raises(validate.EngineError, match=check if check != "trust" else "trust"):
        validate.strict(bad, bad)


def test_empty(spark):
    none = t.empty_facts(spark)
    assert t.current_values(none).isEmpty() and t.pointer_chains(none).isEmpty() and validate.chain_violations(none).isEmpty()


def test_facts_are_joined_by_shuffle(spark, monkeypatch):
    """A written table of facts is a small file of many rows: Spark, left alone, broadcasts all of them through the driver."""
    from factloom.plans import texts

    plans, write = [], scratch.written
    monkeypatch.setattr(scratch, "written", lambda df, label: plans.append(df) or write(df, label))
    plans.append(texts.chain_rules(spark, "/root/testdata/sf0.001"))
    shown = [df._jdf.queryExecution().executedPlan().toString() for df in plans]
    joins = [line for plan in shown for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert len(joins) == 1 and "as_of" in joins[0] and sum(plan.count("SortMergeJoin") for plan in shown) >= 4


def test_quota_report_walks_linked_facts_only(spark, monkeypatch):
    """Of facts that carry their successor, those outside all chains aren't written for the walk along pointers."""
    from factloom.plans import commerce

    sizes, write = {}, scratch.written
    def seen(df, label):
        out = write(df, label)
        sizes.setdefault(label, out.count())
        return out
    monkeypatch.setattr(scratch, "written", seen)
    u = commerce.universe(spark, "/root/testdata/sf0.001")
    report = {tuple(r) for r in t.quota_report(u.facts, u.events).collect()}
    linked = u.facts.where("succ_id IS NOT NULL OR supersedes IS NOT NULL").count()
    assert sizes["walk"] == linked < u.facts.count() / 2
    plain = u.facts.drop("succ_id", "succ_start", *t.HISTORY)
    assert report == {tuple(r) for r in t.quota_report(plain, u.events).collect()}
