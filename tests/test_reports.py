from factloom.functions import values
from factloom.operators import reports

from .test_temporal import FACTS


def test_counts(spark):
    q = spark.createDataFrame([(1, "temporal", "temporal_range", "early"), (1, "temporal", "temporal_range", "mid"), (2, "episodic", "similarity", "current")], "seed int, type string, query_kind string, as_of_horizon string")
    got = {(r["seed"], r["by"], r["name"]): r["n"] for r in reports.question_counts(q).collect()}
    assert got[1, "type", "temporal"] == 2 and got[2, "query_kind", "similarity"] == 1 and got[1, "as_of_horizon", "mid"] == 1
    filled = {(r["seed"], r["as_of_horizon"]): r["n"] for r in reports.zero_filled(q, "as_of_horizon", values.HORIZONS).collect()}
    assert filled == {(1, "early"): 1, (1, "mid"): 1, (1, "late"): 0, (1, "current"): 0, (2, "early"): 0, (2, "mid"): 0, (2, "late"): 0, (2, "current"): 1}


def test_overlap_and_trust(spark):
    e = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "b")], "seed int, advertiser_name string")
    assert sorted(map(tuple, reports.shared_names(e).collect())) == [(1, 2, 1), (1, 3, 2), (2, 3, 1)]
    assert reports.unused_trust_pairs(spark.createDataFrame(FACTS, values.FACT_DDL)).count() == len(values.TRUST) - 2
