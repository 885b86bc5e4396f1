"""As-of joins, sweeps and digest trees against plain loops."""

import hashlib
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from factloom.operators import timeline

DAY0 = date(2024, 1, 1)


def day(n):
    return None if n is None else DAY0 + timedelta(n)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    key = lambda: r.choice(["hot"] * 6 + ["a", "b", "c", None])
    facts = [(key(), day(r.choice([None, *range(0, 200)])), day(r.choice([None, None, 60, 150])), r.randrange(5), f"v{k}") for k in range(300)]
    probes = [(k, key(), day(r.choice([None, *range(-20, 260)]))) for k in range(250)] + [(999, "nobody", day(5)), (0, "a", day(70))]
    return facts, probes


@pytest.mark.parametrize("range_days", [None, 1, 17, 10_000])
def test_asof_join(spark, rows, range_days):
    facts, probes = rows
    f, p = spark.createDataFrame(facts, "k string, s date, e date, o int, v string"), spark.createDataFrame(probes, "id int, k string, day date")
    for until in (None, "e"):
        got = timeline.asof_join(f, p, ["k"], "s", "day", ["v"], ["o", "v"], until=until, range_days=range_days)
        assert got.columns == ["id", "k", "day", "v"]
        want = []
        for i, k, d in probes:
            known = sorted(((s, o, v, e) for fk, s, e, o, v in facts if fk == k and k is not None and s and d and s <= d), key=lambda x: x[:3])
            last = known[-1] if known else None
            want.append((i, k, d, last[2] if last and not (until and last[3] and last[3] < d) else None))
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_asof_join_without_rows(spark):
    f, p = spark.createDataFrame([], "k int, s date, v string"), spark.createDataFrame([(1, DAY0)], "k int, day date")
    assert [tuple(r) for r in timeline.asof_join(f, p, ["k"], "s", "day", ["v"]).collect()] == [(1, DAY0, None)]
    assert timeline.asof_join(f, p.limit(0), ["k"], "s", "day", ["v"], range_days=5).collect() == []


def test_asof_join_is_one_shuffle(spark, rows, tmp_path):
    facts, probes = rows
    spark.createDataFrame(facts, "k string, s date, e date, o int, v string").write.parquet(f"{tmp_path}/f")
    spark.createDataFrame(probes, "id int, k string, day date").write.parquet(f"{tmp_path}/p")
    plan = timeline.asof_join(spark.read.parquet(f"{tmp_path}/f"), spark.read.parquet(f"{tmp_path}/p"), ["k"], "s", "day", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def swept(intervals):
    """{key: n for each day}, up to a day behind all, by counting."""
    far = max([d for _, s, e in intervals for d in (s, e) if d], default=DAY0) + timedelta(2)
    out = {}
    for k in {k for k, *_ in intervals}:
        own = [(s, e or far) for kk, s, e in intervals if kk == k and s and (e is None or e >= s)]
        if own:
            first = min(s for s, _ in own)
            out[k] = [(d, sum(s <= d <= e for s, e in own)) for d in (first + timedelta(j) for j in range((far - first).days + 1))]
    return out, far


def test_sweep(spark):
    r = random.Random(3)
    intervals = []
    for k in range(25):
        for _ in range(r.randrange(1, 9)):
            s = r.randrange(60)
            intervals.append((k, day(s), day(r.choice([None] if r.random() < 0.1 else [s, s + 3, s + r.randrange(-2, 25)]))))
    intervals += [(50, None, DAY0), (50, None, None), (51, day(5), day(2)), (52, day(1), day(5)), (52, day(6), day(9)), (None, day(1), day(2)), intervals[0]]
    df = spark.createDataFrame(intervals, "k int, s date, e date")
    want, far = swept(intervals)
    got = {}
    for x in timeline.periods(df, ["k"], "s", "e").collect():
        got.setdefault(x["k"], []).append((x["start"], x["end"], x["n"]))
    assert set(got) == set(want)
    for k, found in got.items():
        found.sort()
        assert all(a[1] is not None and a[1] + timedelta(1) == b[0] and a[2] != b[2] for a, b in zip(found, found[1:]))
        by_day = {d: n for a, b, n in found for d in (a + timedelta(j) for j in range(((b or far) - a).days + 1))}
        assert all(by_day.get(d, 0) == n for d, n in want[k])
    assert sorted((x["start"], x["end"], x["n"]) for x in timeline.periods(df.where("k = 52"), ["k"], "s", "e").collect()) == [(day(1), day(9), 1)]
    unions = {}
    for x in timeline.coalesced(df, ["k"], "s", "e").collect():
        unions.setdefault(x["k"], []).append((x["start"], x["end"] or far, x["most"]))
    for k, days in want.items():
        inside = [(d, n) for d, n in days if n]
        assert sorted(d for a, b, _ in unions[k] for d in (a + timedelta(j) for j in range((b - a).days + 1))) == [d for d, _ in inside]
        assert all(most == max(n for d, n in inside if a <= d <= b) for a, b, most in unions[k])
    assert timeline.overlaps(df, ["k"], "s", "e").where("n < 2").isEmpty() and timeline.gaps(df, ["k"], "s", "e").where("end IS NULL").isEmpty()
    assert timeline.periods(df.limit(0), ["k"], "s", "e").isEmpty()


@pytest.mark.parametrize("n", [0, 1, 4, 5, 64, 65, 300])
def test_digest_tree(spark, n):
    level = [f"line {k:04d}" for k in range(n)]
    levels = 0
    while len(level) > 1 or not levels:
        level = [hashlib.sha256("\n".join(level[i : i + 4]).encode()).hexdigest() for i in range(0, max(len(level), 1), 4)]
        levels += 1
    df = spark.createDataFrame([(k,) for k in range(n)], "k int").orderBy(F.rand(5))
    for parts in (1, 7):
        got = timeline.digest_tree(df.repartition(parts), F.format_string("line %04d", "k"), ["k"], leaf=4).first()
        assert (got["rows"], got["levels"], got["digest"]) == (n, levels, level[0])


def test_digest_nodes_give_a_row_a_node(spark):
    """More lines than one node of the second level holds: a digest for each, as the SQL of ordered_digest gives them."""
    df = spark.range(30).select(F.format_string("%03d", "id").alias("line"))
    got = [r["digest"] for r in timeline.digest_nodes(df, F.col("line"), ["line"], 2, leaf=3).orderBy("node").collect()]
    sha = lambda parts: hashlib.sha256("\n".join(parts).encode()).hexdigest()
    leaves = [sha([f"{k:03d}" for k in range(at, at + 3)]) for at in range(0, 30, 3)]
    assert got == [sha(leaves[at:at + 3]) for at in range(0, 10, 3)]
