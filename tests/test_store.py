"""The bucketed fact store: batches in any order against the whole, plans, failed appends, other sessions."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from factloom.functions import values
from factloom.operators import temporal
from factloom.sources.store import FactStore


def fact(seed, k, before, start):
    return (seed, k, "deal", "D1", "V1", "budget_usd", "5", (start, None), "durable", "call_note", "user", "first_party_note", before, None, False, False)


def made():
    r, rows = random.Random(6), []
    for chain in range(40):
        ids = [f"F{chain}-{k}" for k in range(r.randrange(1, 12))]
        rows += [fact(1 + chain % 2, i, b, date(2024, 1 + k, 1 + chain % 28)) for k, (i, b) in enumerate(zip(ids, [None, *ids], strict=False))]
    rows += [fact(1, "fork", "F0-0", date(2023, 1, 1)), fact(1, "lost", "never", date(2024, 1, 1)), fact(1, "after-lost", "lost", date(2024, 2, 1))]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    names = [f.name for f in spark.createDataFrame([], values.FACT_DDL).schema]
    order = ["seed", "fact_id", "entity", "entity_id", "event_id", "attribute", "value", "validity_interval", "volatility_class", "channel", "author", "trust_class", "supersedes", "plausibility", "injection", "never_memorize"]
    schema = spark.createDataFrame([], values.FACT_DDL).select(*order).schema
    return spark.createDataFrame(rows, schema).select(*names)


def same(store, whole):
    got, want = store.with_successor(), temporal.with_successor(whole)
    columns = ["seed", "fact_id", "supersedes", "succ_id", "succ_start"]
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, map(tuple, want.select(*columns).collect())))
    columns = ["seed", "root", "fact_id", "depth"]
    assert sorted(map(tuple, store.roots().select(*columns).collect())) == sorted(map(tuple, temporal.pointer_chains(whole).select(*columns).collect()))


def test_batches_in_any_order_give_the_whole(spark, tmp_path):
    rows = made()
    store, done = FactStore(spark, f"file://{tmp_path}/store", buckets=3), []
    assert store.roots().isEmpty() and store.with_successor().isEmpty()
    for k in range(4):
        part = rows[k::4]
        done += part
        store.append(frame(spark, part), f"b{k}")
        if k in (0, 3):
            same(store, frame(spark, done))
    store.append(frame(spark, rows[:5]), "b1")  # a batch that is there by its name
    assert FactStore(spark, f"file://{tmp_path}/store").facts().count() == len(rows) and store.batches() == ["b0", "b1", "b2", "b3"]


def test_what_is_stored_is_not_shuffled(spark, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/store", buckets=3)
    store.append(frame(spark, made()), "one")
    plan = store.with_successor()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Bucketed: true") == 2
    new = frame(spark, [fact(1, "later", "F0-0", date(2025, 1, 1))]).select("seed", F.col("supersedes").alias("fact_id"))
    plan = store._table("roots").join(new.hint("merge"), ["seed", "fact_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_a_failed_append_changes_nothing(spark, tmp_path, monkeypatch):
    path, rows = f"file://{tmp_path}/store", made()
    store = FactStore(spark, path, buckets=2)
    store.append(frame(spark, rows[::2]), "one")
    write = FactStore._write

    def stop(self, part, table, batch):
        if table == "facts":
            raise RuntimeError("stopped")
        return write(self, part, table, batch)

    with monkeypatch.context() as m:
        m.setattr(FactStore, "_write", stop)
        with pytest.raises(RuntimeError):
            store.append(frame(spark, rows[1::2]), "two")
    # and one that stopped while its parts were moved: its facts aren't in place
    at = store._write(frame(spark, rows[1::2]).select("seed", "fact_id", F.lit("x").alias("root"), F.lit(9).alias("depth")), "roots", "two")
    fs, target = store._fs(f"{path}/roots/batch=two")
    assert fs.rename(store._fs(at)[1], target)
    again = FactStore(spark, path)
    assert again.batches() == ["one"]
    same(again, frame(spark, rows[::2]))
    again.append(frame(spark, rows[1::2]), "two")
    same(again, frame(spark, rows))
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x").write_text("x")
    with pytest.raises(ValueError, match="no fact store"):
        FactStore(spark, f"file://{tmp_path}/other")
