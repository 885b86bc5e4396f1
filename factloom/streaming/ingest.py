"""Appending fact records as they arrive: a stream of JSON lines, split into valid facts and violations.

The store is append-only, so the stream needs no state: each record is checked on
its own, whatever its id, and goes to the facts table if it breaks no rule; the rules broken
by the others go to a violations table. A line that is no JSON record breaks the rule
"json", with the line as detail. Rules across facts (chains) are for
validate.chain_violations() over the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.functions import values
from factloom.operators.validate import flagged_facts, violation_rows

#: The column that keeps a line that can't be read.
BAD_LINE = "_bad_line"


def fact_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(f"{values.FACT_DDL}, {BAD_LINE} string").option("columnNameOfCorruptRecord", BAD_LINE)
    return reader.option("maxFilesPerTrigger", files_per_batch).json(path)


def split(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, violations) of records: every record is in exactly one of them, and in violations once for each rule that it breaks."""
    if BAD_LINE not in records.columns:
        records = records.withColumn(BAD_LINE, F.lit(None).cast("string"))
    unread = F.array(F.struct(F.lit("json").alias("check"), F.col(BAD_LINE).alias("detail")))
    flagged = flagged_facts(records).withColumn("violations", F.when(F.col(BAD_LINE).isNotNull(), unread).otherwise(F.col("violations")))
    return flagged.where("size(violations) = 0").drop(BAD_LINE, "violations"), violation_rows(flagged, "fact_id")


def _append(facts_path: str, bad_path: str):
    def batch(df: DataFrame, epoch: int) -> None:
        # overwriting a batch's own folder makes a batch that is run again give the same tables
        good, bad = split(df)
        good.write.mode("overwrite").parquet(f"{facts_path}/batch={epoch}")
        bad.write.mode("overwrite").parquet(f"{bad_path}/batch={epoch}")

    return batch


def ingest(stream: DataFrame, facts_path: str, bad_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(_append(facts_path, bad_path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
