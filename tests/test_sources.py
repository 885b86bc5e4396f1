import hashlib
import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import values
from factloom.operators.validate import EngineError
from factloom.sources import scratch, tables
from factloom.streaming import ingest

from .test_temporal import FACTS


def test_json_lines_and_digest(spark, tmp_path):
    df = spark.createDataFrame(FACTS, values.FACT_DDL)
    first = tables.write_jsonl(df, f"{tmp_path}/f", ["fact_id"])
    back = tables.read_jsonl(spark, f"{tmp_path}/f", "facts")
    assert tables.line_digest(back.repartition(3), ["fact_id"]) == first and back.count() == len(FACTS)
    written = "".join(r[0] + "\n" for r in spark.read.text(f"{tmp_path}/f").orderBy(F.get_json_object("value", "$.fact_id")).collect())
    assert hashlib.sha256(written.encode()).hexdigest() == first
    assert tables.digest(back.repartition(3)) == tables.digest(df) != tables.digest(back.unionByName(back.limit(1)))
    line = json.loads(spark.read.text(f"{tmp_path}/f").first()[0])
    assert list(line) == sorted(line) and "supersedes" in line
    with pytest.raises(EngineError, match="generate"):
        tables.read_jsonl(spark, f"{tmp_path}/none", "facts")


def test_corpus(spark, tmp_path):
    for k in (2, 1):
        (tmp_path / f"EV-{k}").mkdir()
        (tmp_path / f"EV-{k}" / "rendered.md").write_text(f"text {k}\nmore")
    df = tables.read_corpus(spark, str(tmp_path), 7)
    assert sorted(map(tuple, df.collect())) == [(7, "EV-1", "text 1\nmore"), (7, "EV-2", "text 2\nmore")]
    tables.write_corpus(df, f"{tmp_path}/whole")
    assert "".join(f.read_text() for f in sorted((tmp_path / "whole").glob("part-*"))) == "text 1\nmore\n\ntext 2\nmore\n\n"


def test_choices_and_settings(spark):
    df = spark.createDataFrame([(1, "b", "x"), (1, "a", "y"), (1, "c", "y")], "seed int, id string, type string")
    assert [r["id"] for r in tables.chosen(df, "id", types=["y"], limit=1).collect()] == ["a"]
    with pytest.raises(EngineError):
        tables.chosen(df, "id", only=["zz"])
    assert tables.required({"a": {"b": 3}}, "a.b") == 3
    for bad in ({}, {"a": {"b": "TBD"}}, {"a": {"b": None}}):
        with pytest.raises(EngineError, match="a.b"):
            tables.required(bad, "a.b")


def test_settings_file(tmp_path):
    (tmp_path / "s.yaml").write_text("universe:\n  seeds: [42, 43]\n  current_offset_days: TBD\n")
    found = tables.settings(str(tmp_path / "s.yaml"))
    assert tables.required(found, "universe.seeds") == [42, 43]
    with pytest.raises(EngineError, match="universe.current_offset_days"):
        tables.required(found, "universe.current_offset_days")
    (tmp_path / "t.yaml").write_text("- 1\n")
    for bad in ("t.yaml", "none.yaml"):
        with pytest.raises(EngineError, match=bad):
            tables.settings(str(tmp_path / bad))


def test_stream_splits_facts_and_violations(spark, tmp_path):
    df = spark.createDataFrame(FACTS, values.FACT_DDL).withColumn("trust_class", F.when(F.col("fact_id") == "F1", "nobody").otherwise(F.col("trust_class")))
    tables.write_jsonl(df, f"{tmp_path}/in", ["fact_id"])
    q = ingest.ingest(ingest.fact_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/facts", f"{tmp_path}/bad", f"{tmp_path}/check")
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/facts").count() == len(FACTS) - 1
    assert [(r["key"], r["check"]) for r in spark.read.parquet(f"{tmp_path}/bad").collect()] == [("F1", "trust")]


def test_shared_folder_is_required_off_one_machine():
    class Context:
        master, applicationId = "spark://somewhere:7077", "app"

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch._own(Session())


def test_kept_tables_see_changed_input(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"

    def total():
        return scratch.kept(spark, "sum", [path], lambda: spark.read.parquet(path).groupBy().sum("id")).first()[0]

    spark.range(10).write.parquet(path)
    made = total()
    assert made == 45 and total() == 45
    spark.range(20).write.mode("overwrite").parquet(path)
    assert total() == 190
