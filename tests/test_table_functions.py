"""Table functions against the forms over DataFrames and plain loops."""

import random
from datetime import date, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from factloom.functions import values
from factloom.operators import table_functions, temporal, timeline

DAY0 = date(2024, 1, 1)


def day(n):
    return None if n is None else DAY0 + timedelta(n)


@pytest.fixture(scope="module")
def sql(spark):
    table_functions.register(spark)
    return spark.sql


def made_facts(spark):
    """Chains, two facts of a day that supersede each other in turn, loose facts, expired ones, repeated rows and facts without a start."""
    r = random.Random(5)
    out = []
    for n in range(40):
        start, before = 0, None
        for k in range(r.randrange(1, 6)):
            start += r.choice([0, 3, 9])
            end = None if r.random() < 0.7 else day(start + r.randrange(8))
            out.append((f"F{n}-{k}", f"A{n % 20}", "rate", day(start), end, before))
            before = f"F{n}-{k}" if r.random() < 0.8 else None
    out += [("X", "A1", "rate", None, None, "F1-0"), ("Y", None, "rate", day(1), None, None), out[3], out[3]]
    rows = [(1, i, "deal", e, "V", a, "x", (s, t), "durable", "call_note", "user", "first_party_note", b, None, False, False, "extra") for i, e, a, s, t, b in out]
    return spark.createDataFrame(rows, values.FACT_DDL + ", more string")


@pytest.mark.parametrize("n", [-1, 0, 3, 7, 12, 500])
def test_asof_has_the_status_of_the_store(spark, sql, n):
    facts = made_facts(spark)
    got = sql(f"SELECT * FROM asof(TABLE(SELECT * FROM {{f}}), DATE'{day(n)}')", f=facts)
    assert got.schema.fieldNames() == facts.schema.fieldNames()
    # a fact without a start supersedes nothing by a day, and no fact of the made ones is named from another key
    want = temporal.status_at(facts.where("validity_interval.start IS NOT NULL"), F.lit(day(n))).where("status = 'active'").select(facts.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_asof_of_no_rows_and_no_day(spark, sql):
    facts = made_facts(spark)
    assert sql("SELECT * FROM asof(TABLE(SELECT * FROM {f} LIMIT 0), DATE'2024-01-01')", f=facts).collect() == []
    assert sql("SELECT * FROM asof(TABLE(SELECT * FROM {f}), CAST(NULL AS DATE))", f=facts).collect() == []


def test_periods_are_those_of_the_sweep(spark, sql):
    r = random.Random(8)
    rows = [(r.choice(["hot", "hot", "a", "b", None]), r.randrange(3), day(r.choice([None, *range(40)])), day(r.choice([None, *range(60)]))) for _ in range(400)]
    rows += [("touch", 0, day(1), day(5)), ("touch", 0, day(6), day(9)), ("never", 0, day(5), day(4))]
    df = spark.createDataFrame(rows, "k string, j int, s date, e date")
    got = sql("SELECT * FROM periods(TABLE(SELECT * FROM {d}), 'k, j', 's', 'e')", d=df)
    want = timeline.periods(df, ["k", "j"], "s", "e")
    assert got.columns == ["k", "j", "start", "end", "n"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert [tuple(x) for x in got.where("k = 'touch'").collect()] == [("touch", 0, day(1), day(9), 1)]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_periods_of_packed_rows(spark, sql, size):
    """Many starts on one day, so that rows begin and end on it, and keys without a sound interval."""
    r = random.Random(9)
    rows = [(r.choice(["hot", "hot", "a", None]), day(r.choice([None, 4, 4, 4, *range(12)])), day(r.choice([None, *range(30)]))) for _ in range(400)] + [("never", day(5), day(4)), ("none", None, None)]
    df = spark.createDataFrame(rows, "k string, s date, e date")
    pack = table_functions.packed(df, ["k"], "s", "e", size)
    assert pack.where(f"size(s) > {size} OR size(s) <> size(e)").count() == 0 and pack.count() >= len(rows) / size
    got = sql("SELECT * FROM periods(TABLE(SELECT * FROM {d}), 'k', 's', 'e')", d=pack)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, timeline.periods(df, ["k"], "s", "e").collect())))


@pytest.mark.parametrize(
    "call",
    ["asof(TABLE(SELECT 1 AS a), DATE'2024-01-01')", "asof(1, DATE'2024-01-01')", "periods(TABLE(SELECT 1 AS k, 2 AS s, 3 AS e), 'k', 's', 'e')", "periods(TABLE(SELECT 1 AS k), 'k', 's', 'e')"],
)
def test_wrong_calls_are_told(sql, call):
    with pytest.raises(PySparkException, match="asof|periods"):
        sql(f"SELECT * FROM {call}").collect()


def test_one_shuffle_by_key(spark, sql, tmp_path):
    made_facts(spark).write.parquet(f"{tmp_path}/f")
    plan = sql("SELECT fact_id FROM asof(TABLE(SELECT * FROM {f}), DATE'2024-01-09')", f=spark.read.parquet(f"{tmp_path}/f"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
