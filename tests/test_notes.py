"""Notes as maps and as VARIANT give the same; types, broken text and storage."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import notes

DOCS = ['{"a": 1, "derivation": null}', '{"a": "x", "b c": 2.5}', '{"b c": {"d": [1]}, "derivation": "sum"}', "[1, 2]", '"derivation"', "null", "{}", '{"a": 1', "", None, '{"a": true}', '{"a": 1, "derivation": null}']


@pytest.fixture(scope="module")
def made(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "id int, doc string").withColumn("notes", notes.parsed(F.col("doc")))


def sound(doc):
    try:
        return json.loads(doc) if doc else None
    except ValueError:
        return None


def test_presence_and_text(made):
    for key in ("a", "derivation", "b c", "none"):
        for r in made.select("doc", notes.has(made, key).alias("has"), notes.text(made, key).alias("text")).collect():
            value = sound(r["doc"])
            inside = isinstance(value, dict) and key in value
            assert r["has"] == inside
            found = value[key] if inside else None
            want = None if found is None else json.dumps(found, separators=(",", ":")) if isinstance(found, (dict, bool)) else str(found)
            assert r["text"] == want


def test_maps_and_variants_agree(spark):
    maps = spark.createDataFrame([(0, {"a": "1", "derivation": None}), (1, {}), (2, None), (3, {"b": "x"})], "id int, notes map<string,string>")
    variants = notes.as_variant(maps)
    assert notes.as_variant(variants) is variants
    for key in ("a", "b", "derivation"):
        asked = [df.select("id", notes.has(df, key), notes.text(df, key)).orderBy("id").collect() for df in (maps, variants)]
        assert [tuple(r) for r in asked[0]] == [tuple(r) for r in asked[1]]


def test_columns_of_a_type(made):
    got = {r["id"]: r["a"] for r in notes.columns(made, {"a": "int"}).collect()}
    assert [got[k] for k in (0, 1, 3, 6, 7)] == [1, None, None, None, None]


def test_profile_and_schema(made):
    got = {(r["key"], r["type"]): r["n"] for r in notes.profile(made, []).collect()}
    assert got == {("a", "BIGINT"): 2, ("a", "STRING"): 1, ("a", "BOOLEAN"): 1, ("derivation", "VOID"): 2, ("derivation", "STRING"): 1, ("b c", "DECIMAL(2,1)"): 1, ("b c", "OBJECT<d: ARRAY<BIGINT>>"): 1}
    assert notes.profile(made.limit(0), ["id"]).isEmpty()
    one = notes.schema(made.where("id IN (0, 1)"), []).first()["schema"]
    assert "a: VARIANT" in one and "derivation: VOID" in one


def test_written_and_read_again(made, tmp_path, spark):
    made.write.parquet(f"{tmp_path}/p")
    back = spark.read.parquet(f"{tmp_path}/p")
    show = lambda df: sorted(map(repr, df.select("id", F.to_json("notes"), notes.has(df, "derivation")).collect()))
    assert back.schema == made.schema and show(back) == show(made)


def test_keys_with_quotes_are_refused(made):
    with pytest.raises(ValueError):
        notes.has(made, 'a"b')
