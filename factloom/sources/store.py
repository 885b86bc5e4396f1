"""An append-only fact store on files, bucketed so that appends and as-of questions don't shuffle what is stored.

Three tables grow by batches: the facts, bucketed by their own key (seed, fact_id); the
links, one for each fact that supersedes another, bucketed by the key of the fact superseded; and the
roots, where each fact stands in its chain, bucketed by its key. The successor of every fact
is a join of facts and links bucket by bucket. An append works out chains among the new facts and looks up
in the stored tables only what these point to, so only new rows are shuffled. Where a predecessor comes after its successor, the chain
that began with the successor isn't written again: a short table of moves says to which root it has gone.

The truth is the folder: a batch is written aside and moved into place when it is whole, facts last, and a batch whose facts aren't in
place doesn't count. One writer at a time is assumed.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import values
from factloom.operators import temporal
from factloom.sources import scratch

KEY = ["seed", "fact_id"]
TABLES = {
    "moves": "seed int, fact_id string, to string, up int",
    "roots": "seed int, fact_id string, root string, depth int",
    "links": "seed int, fact_id string, succ_id string, succ_start date",
    "facts": values.FACT_DDL,
}  # in the order in which a batch's parts are moved into place


class FactStore:
    """A store in a folder, opened if it is there and made if the folder is empty."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self._name = "facts_" + hashlib.md5(self.path.encode()).hexdigest()
        fs, note = self._fs(f"{self.path}/_store.json")
        if not fs.exists(note):
            at = self._fs(self.path)[1]
            if fs.exists(at) and len(fs.listStatus(at)):
                raise ValueError(f"{self.path} isn't empty and holds no fact store")
            out = fs.create(note, False)
            out.write(bytearray(json.dumps({"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))}).encode()))
            out.close()
        text = spark.sparkContext._jvm.java.util.Scanner(fs.open(note))
        self.buckets = json.loads(text.nextLine())["buckets"]
        text.close()
        for table, ddl in TABLES.items():
            fields = T.StructType.fromDDL(ddl).add("batch", "string")
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name}_{table} ({columns}) USING parquet PARTITIONED BY (batch) CLUSTERED BY (seed, fact_id) SORTED BY (seed, fact_id) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{table}'")
        self._refresh()

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _refresh(self) -> None:
        for table in TABLES:
            self._fs(self.path)[0].mkdirs(self._fs(f"{self.path}/{table}")[1])
            self.spark.catalog.recoverPartitions(f"{self._name}_{table}")
            self.spark.catalog.refreshTable(f"{self._name}_{table}")

    def batches(self) -> list[str]:
        """The finished batches: those whose facts are in place."""
        fs, at = self._fs(f"{self.path}/facts")
        names = [x.getPath().getName() for x in fs.listStatus(at)]
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch="))

    def _table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self._name}_{name}").where(F.col("batch").isin(self.batches())).drop("batch")

    def facts(self) -> DataFrame:
        return self._table("facts")

    def _write(self, rows: DataFrame, table: str, batch: str) -> str:
        """Writes a batch's part of a table aside; returns where."""
        staged, made = f"{self.path}/_staged-{uuid.uuid4().hex}", f"staged_{uuid.uuid4().hex}"
        try:
            names = T.StructType.fromDDL(TABLES[table]).names
            out = rows.select(*names).repartition(self.buckets, *KEY).write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY)
            out.option("path", staged).saveAsTable(made)
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {made}")
        return staged

    def append(self, facts: DataFrame, batch: str) -> None:
        """Adds facts as a batch; one that the store has by that name is left as it is. No fact may be in the store already."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError(f"a batch's name is of letters, digits, _ and -: {batch}")
        if batch in self.batches():
            return
        new = scratch.written(facts.select(*T.StructType.fromDDL(values.FACT_DDL).names), "new")
        links = new.where("supersedes IS NOT NULL").select("seed", F.col("supersedes").alias("fact_id"), F.col("fact_id").alias("succ_id"), temporal.start_day().alias("succ_start"))

        # chains among the new facts; what their first facts supersede is looked up where it is stored
        chains = temporal.pointer_chains(new)
        firsts = new.select("seed", F.col("fact_id").alias("root"), F.col("supersedes").alias("_up"))
        up = chains.where("depth = 0").select("seed", "root").join(firsts.where("_up IS NOT NULL"), ["seed", "root"]).select("seed", F.col("_up").alias("fact_id"), F.col("root").alias("_first"))
        known = self._table("roots").join(up, KEY).select("seed", F.col("_first"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        both = chains.join(known.withColumnsRenamed({"seed": "_seed"}), (F.col("seed") == F.col("_seed")) & (F.col("root") == F.col("_first")), "left")
        roots = both.select("seed", "fact_id", F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce(F.col("_depth") + 1, F.lit(0))).cast("int").alias("depth"))
        roots = scratch.written(roots, "roots")

        # stored facts that supersede a new one were the first of their chains until now
        waited = self._table("links").join(roots, KEY).select("seed", F.col("succ_id").alias("fact_id"), F.col("root").alias("to"), (F.col("depth") + 1).alias("up"))

        parts = {"moves": waited, "roots": roots, "links": links, "facts": new}
        staged = {table: self._write(parts[table], table, batch) for table in TABLES}
        for table, at in staged.items():
            fs, target = self._fs(f"{self.path}/{table}/batch={batch}")
            fs.delete(target, True)  # of an append that failed half-way
            if not fs.rename(self._fs(at)[1], target):
                raise OSError(f"batch {batch} couldn't be moved into {self.path}/{table}")
        self._refresh()

    def with_successor(self) -> DataFrame:
        """The facts with succ_id and succ_start, as temporal.with_successor() gives them, without a shuffle of the store."""
        first = F.min(F.struct(F.col("succ_start").alias("start"), F.col("succ_id").alias("id"))).alias("s")
        succ = self._table("links").groupBy(*KEY).agg(first)
        return self.facts().join(succ.hint("merge"), KEY, "left").withColumns({"succ_id": F.col("s.id"), "succ_start": F.col("s.start")}).drop("s")

    def _moved(self) -> DataFrame:
        """Moves (seed, fact_id, to, up) followed to their ends: as few as there were predecessors that came late."""
        steps = scratch.written(self._table("moves"), "moves")
        now, left, before = steps, None, -1
        while left != 0 and left != before:
            on = now.select(F.col("seed").alias("_s"), F.col("fact_id").alias("_f"), F.col("to").alias("_to"), F.col("up").alias("_up"))
            met = now.join(on, (F.col("seed") == F.col("_s")) & (F.col("to") == F.col("_f")), "left")
            now = scratch.written(met.select("seed", "fact_id", F.coalesce("_to", "to").alias("to"), (F.col("up") + F.coalesce("_up", F.lit(0))).cast("int").alias("up")), "moves")
            ends = now.join(steps.select("seed", F.col("fact_id").alias("to")), ["seed", "to"], "left_semi")
            before, left = left, ends.count()
        return now

    def roots(self) -> DataFrame:
        """(seed, root, fact_id, depth) of all facts, as temporal.pointer_chains() gives them: the stored places, moved on where a chain got an earlier beginning."""
        moved = temporal.by_seed(self._moved().select("seed", F.col("fact_id").alias("root"), "to", "up"))
        found = self._table("roots").join(moved, ["seed", "root"], "left")
        return found.select("seed", F.coalesce("to", "root").alias("root"), "fact_id", (F.col("depth") + F.coalesce("up", F.lit(0))).cast("int").alias("depth"))

    def drop(self) -> None:
        """Removes the tables and their files."""
        for table in TABLES:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name}_{table}")
        fs, at = self._fs(self.path)
        fs.delete(at, True)
