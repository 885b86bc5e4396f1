"""Notes with free keys: a map of strings, or a VARIANT that keeps the types of its values.

What asks for notes asks by key and takes either form. A key is present if the notes have it, whatever its value is, JSON's
null included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _path(key: str) -> str:
    if '"' in key or "\\" in key:
        raise ValueError(f"a key of notes has no quotes or backslashes: {key}")
    return f'$["{key}"]'


def _is_variant(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.VariantType)


def parsed(json: Column) -> Column:
    """Notes of JSON text as a VARIANT; null where it isn't JSON."""
    return F.try_parse_json(json)


def as_variant(df: DataFrame, column: str = "notes") -> DataFrame:
    """df with its notes as a VARIANT; a map's values stay strings."""
    return df if _is_variant(df, column) else df.withColumn(column, F.to_variant_object(column))


def has(df: DataFrame, key: str, column: str = "notes") -> Column:
    """Whether the notes have the key; false for null notes and for notes that are no object."""
    found = F.try_variant_get(column, _path(key), "variant").isNotNull() if _is_variant(df, column) else F.array_contains(F.map_keys(column), key)
    return F.coalesce(found, F.lit(False))


def text(df: DataFrame, key: str, column: str = "notes") -> Column:
    """The key's value as text; null where it is missing or JSON's null."""
    return F.try_variant_get(column, _path(key), "string") if _is_variant(df, column) else F.col(column)[key]


def columns(df: DataFrame, kinds: dict[str, str], column: str = "notes") -> DataFrame:
    """df with a column for each key, of the type given; null where the value is missing or doesn't fit. Needs VARIANT notes."""
    return df.withColumns({key: F.try_variant_get(column, _path(key), kind) for key, kind in kinds.items()})


def profile(df: DataFrame, by: list[str], column: str = "notes") -> DataFrame:
    """(by, key, type, n): which keys VARIANT notes have, and of what types, one row for each; notes that are null or no object add nothing."""
    objects = df.where(F.schema_of_variant(column).startswith("OBJECT")).select(*by, F.col(column).alias("_notes"))
    entry = objects.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_notes").outer()))
    return entry.groupBy(*by, "key", F.schema_of_variant("value").alias("type")).agg(F.count("*").alias("n"))


def schema(df: DataFrame, by: list[str], column: str = "notes") -> DataFrame:
    """(by, schema): the one schema that all VARIANT notes of a key fit; types that don't go together become VARIANT."""
    return df.groupBy(*by).agg(F.schema_of_variant_agg(column).alias("schema"))
