"""The successor of every fact, kept up as facts arrive in any order.

Each fact is a message to itself and, if it supersedes one, to that one. State is
held by (seed, fact_id): whether the fact has come and the earliest successor so far, so
a successor that comes before its predecessor waits in the predecessor's state, for as
long as it takes. A key whose answer changes in a batch gives one row; the newest row of each key is the
table that temporal.with_successor() makes of all facts. With a waiting time, a successor whose predecessor
hasn't come by then is reported once as dangling; it still counts when the predecessor comes.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from factloom.operators.temporal import start_day
from factloom.sources.scratch import workers_import_us

from .ingest import split

#: A fact that has come and has none so far gives nulls; dangling rows are of facts that haven't come.
OUT = "seed int, fact_id string, succ_id string, succ_start date, dangling boolean"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Successors(StatefulProcessor):
    """Keeps whether a fact has come, and the (start, id) of its earliest successor."""

    def __init__(self, wait_ms: int | None):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.come = handle.getValueState("come", "come boolean")
        self.best = handle.getValueState("best", "start date, id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        come, best = self.come.exists(), self.best.get() if self.best.exists() else None
        before = (come, best)
        for row in rows:
            if row["succ_id"] is None:
                come = True
            elif best is None or (row["succ_start"], row["succ_id"]) < (best[0], best[1]):
                best = (row["succ_start"], row["succ_id"])
        if (come, best) == before:
            return
        if come and not before[0]:
            self.come.update((True,))
        if best != before[1]:
            self.best.update(best)
        if come:
            yield self._row(key, best, False)
        elif self.wait_ms is not None and before[1] is None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.come.exists():  # else it came while its timer ran
            yield self._row(key, self.best.get(), True)

    @staticmethod
    def _row(key, best: tuple[date, str] | None, dangling: bool) -> Row:
        start, id_ = best or (None, None)
        return Row(seed=key[0], fact_id=key[1], succ_id=id_, succ_start=start, dangling=dangling)

    def close(self) -> None:
        pass


def successor_changes(facts: DataFrame, wait_ms: int | None = None) -> DataFrame:
    """A stream of rows OUT from a stream of facts; those that break a rule of single facts take no part."""
    workers_import_us(facts.sparkSession)
    good = split(facts)[0].where("seed IS NOT NULL")
    own = F.struct(F.col("fact_id").alias("fact_id"), F.lit(None).cast("string").alias("succ_id"), F.lit(None).cast("date").alias("succ_start"))
    up = F.struct(F.col("supersedes").alias("fact_id"), F.col("fact_id").alias("succ_id"), start_day().alias("succ_start"))
    messages = good.select("seed", F.inline(F.array(own, up))).where("fact_id IS NOT NULL")
    mode = "None" if wait_ms is None else "ProcessingTime"
    return messages.groupBy("seed", "fact_id").transformWithState(Successors(wait_ms), OUT, "Update", mode)


def follow(facts: DataFrame, path: str, checkpoint: str, wait_ms: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Writes the changes under path, a folder a batch, so that a batch that is run again gives the same. State is in RocksDB, under the checkpoint."""
    spark = facts.sparkSession
    spark.conf.set(_STORE, _ROCKS)

    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    writer = successor_changes(facts, wait_ms).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def successors(spark: SparkSession, path: str) -> DataFrame:
    """(seed, fact_id, succ_id, succ_start) of every fact that has come: the newest row of each."""
    rows = spark.read.schema(f"{OUT}, batch long").parquet(path).where("NOT dangling")
    newest = F.max_by(F.struct("succ_id", "succ_start"), "batch").alias("s")
    return rows.groupBy("seed", "fact_id").agg(newest).select("seed", "fact_id", "s.*")


def dangling(spark: SparkSession, path: str) -> DataFrame:
    """(seed, fact_id, succ_id) of predecessors that were waited for in vain and haven't come since."""
    rows = spark.read.schema(f"{OUT}, batch long").parquet(path)
    return rows.where("dangling").select("seed", "fact_id", "succ_id").join(rows.where("NOT dangling"), ["seed", "fact_id"], "left_anti")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The newest rows alone, as a table of their own."""
    successors(spark, path).write.mode("overwrite").parquet(to)
