"""Fidelity is worked out in one row an event, over as many tasks as the texts need."""

import re

from factloom.operators import fidelity
from factloom.plans import texts


def test_texts_are_dealt_out_and_met_once(spark, monkeypatch):
    monkeypatch.setattr(fidelity, "TEXTS", 100)
    report = texts.fidelity_report(spark, "/root/testdata/sf0.001")
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?:SortMergeJoin|BroadcastHashJoin) ", plan)) == 1
    assert len(re.findall(r"hashpartitioning\(seed#\d+, event_id#\d+, 15\), REPARTITION_BY_NUM", plan)) == 2
    assert report.count() == 1500 and report.where("status = 'pass'").count() == 188
