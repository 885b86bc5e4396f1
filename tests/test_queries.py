"""Every query with SQL against DuckDB on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple("" if v is None or v != v else str(v) for v in r) for r in df.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(entry.engine.SQL))
def test_query(spark, duck, name):
    ours = entry.queries()[name](spark, DIR).toPandas()
    assert plain(ours) == plain(duck.execute(entry.oracle_sql()[name]).df())


def test_every_key_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_allocation_is_whole_and_repeatable(spark):
    q = entry.queries()["allocation_quota"]
    a, b = (sorted(map(tuple, q(spark, DIR).collect())) for _ in range(2))
    assert a == b and len({r[0] for r in a}) == len(a)
    by_seed = Counter(r[0].split("-")[1] for r in a)
    assert by_seed == {str(k): 120 for k in range(5)} and {r[1] for r in a} == {"mapping_lookup", "conflict_resolution", "injection_probe", "temporal", "inference_only"}


def test_plans_read_tables_once_and_join_by_key(spark):
    """As-of queries scan the written facts alone; nothing is crossed; only windows over few rows a seed lack a finer key."""
    for name, scans in (("asof_current_value", 3), ("asof_horizons", 3), ("contains_benchmark", 3), ("judge_tokens", 2), ("numbered_ids", 2), ("verdicts", 12)):
        plan = entry.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "SinglePartition" not in plan and "Python" not in plan, name
        assert plan.count("FileScan parquet") <= scans, name


def test_planted_amounts_are_not_said_by_chance(spark, tmp_path):
    """Orders whose number or budget is an amount that the fidelity queries plant or look for."""
    rows = [(77123, 500.0), (11, 77123.5), (9001, 9001.25), (9002, 9002.0), (16, 16.0), (7, 77123.0)]
    con = duckdb.connect()
    con.execute(f"COPY (SELECT k AS o_orderkey, p AS o_totalprice, TIMESTAMP '1996-05-04' AS o_orderdate FROM (VALUES {', '.join(map(str, rows))}) v(k, p)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    for name in ("fidelity_report", "fidelity_summary"):
        assert plain(entry.queries()[name](spark, str(tmp_path)).toPandas()) == plain(con.execute(entry.oracle_sql()[name]).df())
