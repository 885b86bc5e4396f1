"""Reading and writing the engine's records: Parquet by seed, JSON lines with digests, texts by event, reports, settings."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import values
from factloom.operators.validate import EngineError

DDL = {"facts": values.FACT_DDL, "events": values.EVENT_DDL, "questions": values.QUESTION_DDL}


def read_jsonl(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Records of a kind, with its fixed schema; a line that doesn't parse is an error, not nulls."""
    try:
        return spark.read.schema(DDL[kind]).option("mode", "FAILFAST").option("dateFormat", "yyyy-MM-dd").json(path)
    except Exception as error:
        raise EngineError(f"no {kind} at {path}; generate them first") from error


def json_line(df: DataFrame) -> Column:
    """One record as JSON: columns by name, nulls kept."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> str:
    """Writes sorted lines and returns their digest."""
    lines = df.select(*order, json_line(df).alias("_line")).orderBy(*order)
    lines.select("_line").write.mode("overwrite").text(path)
    return line_digest(df, order)


def line_digest(df: DataFrame, order: list[str]) -> str:
    """SHA-256 of the records as JSON lines in order, each ended by a line break: of the bytes that one file of them would have.

    A hash over bytes in order is one pass by nature. The lines come to the driver
    a partition at a time, so it holds one partition and no more; for tables that
    are too large for one pass, use digest().
    """
    lines = df.select(*order, json_line(df).alias("_line")).orderBy(*order).select("_line")
    total = hashlib.sha256()
    for row in lines.toLocalIterator():
        total.update(row[0].encode() + b"\n")
    return total.hexdigest()


def digest(df: DataFrame) -> str:
    """SHA-256 over a set of records that doesn't depend on order or partitioning; repeated records count.

    Each record hashes by itself; the four quarters of its hash are added up
    over all records, so one row of five numbers comes to the driver.
    """
    each = df.select(F.sha2(json_line(df), 256).alias("h"))
    lanes = [F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
    row = each.agg(F.count("*"), *lanes).first()
    return hashlib.sha256("|".join(str(v) for v in row).encode()).hexdigest()


def write_scenarios(manifests: DataFrame, texts: DataFrame, meta: DataFrame, path: str) -> None:
    """The three tables of rendered scenarios, each partitioned by seed."""
    for name, df in (("manifest", manifests), ("rendered", texts), ("meta", meta)):
        write_table(df, f"{path}/{name}", "overwrite")


def write_report(report: DataFrame, path: str) -> None:
    """A small aggregate as one file of JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(path, ignoreNullFields=False)


def write_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet partitioned by seed; append only, since facts are superseded and never changed."""
    df.write.mode(mode).partitionBy("seed").parquet(path)


def read_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(DDL[kind]).parquet(path)


def read_corpus(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """(seed, event_id, text) of path/<event_id>/rendered.md; an error if there is none."""
    files = spark.read.text(f"{path}/*/rendered.md", wholetext=True)
    df = files.select(F.lit(seed).alias("seed"), F.regexp_extract(F.input_file_name(), r"/([^/]+)/rendered\.md$", 1).alias("event_id"), F.col("value").alias("text"))
    if df.isEmpty():
        raise EngineError(f"no texts under {path}; render them first")
    return df


def write_corpus(corpus: DataFrame, path: str) -> None:
    """Texts in order of seed and event with a blank line behind each, as one text in as many files as there are ranges."""
    ordered = corpus.select("seed", "event_id", F.concat("text", F.lit("\n")).alias("value")).orderBy("seed", "event_id")
    ordered.select("value").write.mode("overwrite").text(path)


def pending(events: DataFrame, meta: DataFrame, mode: str) -> DataFrame:
    """Events without a passing text of the same render mode."""
    done = meta.where((F.col("fidelity") == "pass") & (F.col("render_mode") == mode)).select("seed", "event_id")
    return events.join(done, ["seed", "event_id"], "left_anti")


def chosen(df: DataFrame, key: str, only: list[str] | None = None, types: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows by id, then by type, then the first `limit` of each seed by key. Ids without a row are an error."""
    if only:
        df = df.where(F.col(key).isin(only))
        if df.isEmpty():
            raise EngineError(f"none of {only}")
    if types:
        df = df.where(F.col("type").isin(types))
    if limit is not None:
        df = df.withColumn("_rank", F.row_number().over(W.partitionBy("seed").orderBy(key))).where(F.col("_rank") <= limit).drop("_rank")
    return df


def required(config: dict, dotted: str):
    """A setting by its dotted name; missing, null or TBD is an error that names it."""
    value = config
    for part in dotted.split("."):
        value = value.get(part) if isinstance(value, dict) else None
    if value is None or value == "TBD":
        raise EngineError(f"setting {dotted} is missing")
    return value


def settings(path: str) -> dict:
    """A YAML file of settings; needs PyYAML. A file that isn't there or isn't a mapping is an error that names it."""
    try:
        import yaml
    except ImportError as error:
        raise EngineError("settings files need PyYAML") from error
    try:
        with open(path, encoding="utf-8") as file:
            found = yaml.safe_load(file)
    except (OSError, yaml.YAMLError) as error:
        raise EngineError(f"settings {path} can't be read") from error
    if not isinstance(found, dict):
        raise EngineError(f"settings {path} are no mapping")
    return found
