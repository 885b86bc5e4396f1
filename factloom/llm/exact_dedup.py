"""Exact dedup: a persistent digest index, bucketed and sorted by hash.

New rows are reduced to one candidate a digest (a map-side combine), the
candidates meet the index in a sort-merge anti-join, and what is new is
appended; for what isn't, its count is. The index is bucketed by digest, so
neither the anti-join nor the lookup shuffles it.

The truth is the index's folder: a file names its buckets, and each batch is a folder of its own, moved
into place when it is whole. A later session that opens the folder has all finished batches and none of
a failed one; the catalog's table is only a view of it, made anew where it is missing. One writer at a time is
assumed.

Defined results: a null text counts as empty; equal texts are equal byte
sequences; of equal texts the row with the largest doc_id stays (a null doc_id
is the smallest; of rows that also share the doc_id, one stays). A digest that
an earlier batch has put into the index drops every new row that has it, whatever
its doc_id; group_size counts the rows of all batches so far. A batch that is added again under its own
name changes nothing. Empty input gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import folder, free_name, materialize, remove, shared_dir, table, text_or_empty

#: A group with at least one row in so many is looked up by broadcast; there are at most so many of them.
HOT_SHARE = 1000

INDEX = T.StructType([
    T.StructField("digest", T.BinaryType()),
    T.StructField("keep_id", T.LongType()),
    T.StructField("keep_row", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("first", T.BooleanType()),
    T.StructField("batch", T.StringType()),
])
#: The file that tells an index's folder from others.
_NOTE = "_digest_index.json"


class DigestIndex:
    """A folder of batches, each bucketed and sorted by digest. Rows with `first` name the row that stays; the others count what came later."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        """path: the index's folder, opened if it holds an index and made if it is empty; name: of the catalog's table over it; buckets: of a new index, by default the session's shuffle partitions."""
        self.spark = spark
        self.path = (path or f"{shared_dir(spark)}/{name or 'digest-index-' + uuid.uuid4().hex}").rstrip("/")
        self.name = name or "digest_index_" + hashlib.md5(self.path.encode()).hexdigest()
        fs, at = folder(spark, self.path)
        note, new = f"{self.path}/{_NOTE}", buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if fs.exists(at) and not fs.exists(self._at(note)) and len(fs.listStatus(at)):
            raise ValueError(f"{self.path} isn't empty and holds no digest index")
        if not fs.exists(self._at(note)):
            fs.mkdirs(at)
            out = fs.create(self._at(note), False)
            out.write(bytearray(json.dumps({"buckets": new}).encode()))
            out.close()
        note_in = spark.sparkContext._jvm.java.util.Scanner(fs.open(self._at(note)))
        self.buckets = json.loads(note_in.nextLine())["buckets"]
        note_in.close()
        self._view()

    def _at(self, path: str):
        return folder(self.spark, path)[1]

    def exists(self) -> bool:
        return folder(self.spark, self.path)[0].exists(self._at(f"{self.path}/{_NOTE}"))

    def _view(self) -> None:
        """The catalog's table over the folder; a table of that name over another folder is refused."""
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in INDEX)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({fields}) USING parquet PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        place = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").where("col_name = 'Location'").first()["data_type"]
        if self._at(place).toUri().getPath() != self._at(self.path).toUri().getPath():
            raise ValueError(f"the catalog's table {self.name} is over {place}, not {self.path}")
        self.spark.catalog.recoverPartitions(self.name)  # the batches that the folder has
        self.spark.catalog.refreshTable(self.name)

    def batches(self) -> list[str]:
        """The finished batches."""
        fs, at = folder(self.spark, self.path)
        names = [x.getPath().getName() for x in fs.listStatus(at)]
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch="))

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame, batch: str) -> None:
        """Adds rows (digest, keep_id, keep_row, n, first) as a batch; rows that are first must have no digest that is first in the index."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError(f"a batch's name is of letters, digits, _ and -: {batch}")
        staged, made = f"{self.path}/_staged-{batch}-{uuid.uuid4().hex}", f"{self.name}_{uuid.uuid4().hex}"
        try:
            (
                rows.select(*(f.name for f in INDEX if f.name != "batch"))
                .repartition(self.buckets, "digest")
                .write.format("parquet")
                .bucketBy(self.buckets, "digest").sortBy("digest")
                .option("path", staged).saveAsTable(made)
            )
            fs, at = folder(self.spark, staged)
            if not fs.rename(at, self._at(f"{self.path}/batch={batch}")):
                raise OSError(f"batch {batch} couldn't be moved into {self.path}")
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {made}")
            remove(self.spark, staged)
        self._view()

    def drop(self) -> None:
        """Removes the table and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


def unseen(groups: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of groups, one a digest, whose digest the index doesn't hold: a sort-merge anti-join with the buckets."""
    return groups.join(index.table().where("first").select("digest").hint("merge"), "digest", "left_anti")


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("digest"))
    return materialize(slim.select("id", "digest", F.monotonically_increasing_id().alias("row")), "digests")


def _add(keyed: DataFrame, index: DigestIndex, batch: str) -> None:
    """Puts the digests of one batch into the index."""
    groups = keyed.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("best"), F.count("*").alias("n"))
    if index.batches():
        groups = materialize(groups, "groups")  # read twice

    def logged(df: DataFrame, first: bool) -> DataFrame:
        kept = [F.when(F.lit(first), F.col(f"best.{c}")).alias(f"keep_{c}") for c in ("id", "row")]
        return df.select("digest", *kept, "n", F.lit(first).alias("first"))

    rows = logged(unseen(groups, index), True)
    if index.batches():
        known = index.table().where("first").select("digest").hint("merge")
        rows = rows.unionByName(logged(groups.join(known, "digest", "left_semi"), False))
    index.append(rows, batch)


def _decided(keyed: DataFrame, index: DigestIndex, batch: str, id_col: str) -> DataFrame:
    """Each row of keyed with what the index says of its digest; a digest with many of the rows is looked up by broadcast."""
    keep = F.max(F.when(F.col("first"), F.struct("keep_id", "keep_row", "batch"))).alias("k")
    mine = F.sum(F.when(F.col("batch") == batch, F.col("n"))).alias("mine")
    totals = index.table().groupBy("digest").agg(keep, F.sum("n").alias("group_size"), mine).where("mine IS NOT NULL")
    totals = totals.select("digest", "k.keep_id", "k.keep_row", F.col("k.batch").alias("kept_in"), "group_size", "mine")
    rows = keyed.count()
    hot = totals.where(F.col("mine") * HOT_SHARE >= F.lit(max(rows, 2 * HOT_SHARE)))
    by_broadcast = keyed.join(F.broadcast(hot), "digest")
    by_merge = keyed.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(totals.hint("merge"), "digest")
    return by_broadcast.unionByName(by_merge).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        ((F.col("row") == F.col("keep_row")) & (F.col("kept_in") == batch)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """Rows (id, keep_id, group_size, kept, text_sha256), one for each row of docs, after adding docs to the index as one batch.

    With a name, a batch that is tried again after it got into the index isn't added twice. Its docs must come in the same files then, since rows
    are told apart by their place.
    """
    batch = batch or uuid.uuid4().hex
    keyed = _digests(docs, id_col, text_col)
    if batch not in index.batches():
        _add(keyed, index, batch)
    return _decided(keyed, index, batch, id_col)


def deduplicate_whole(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same with an index of its own, which is dropped behind it."""
    index = DigestIndex(docs.sparkSession)
    found = materialize(deduplicate(docs, index, id_col, text_col), "decisions")
    index.drop()
    return found


def keep_first_copies(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that deduplicate() drops, with all their columns; without an index, deduplicate_whole() does."""
    names = docs.columns
    sha, drop_id, drop_sha = (free_name(names, c) for c in ("own_sha", "drop_id", "drop_sha"))
    found = materialize(deduplicate(docs, index, id_col, text_col), "decisions") if index else deduplicate_whole(docs, id_col, text_col)
    dropped = found.where(~F.col("kept")).select(F.col(id_col).alias(drop_id), F.col("text_sha256").alias(drop_sha)).distinct()
    # a row repeated with its doc_id is both kept and dropped: it stays once
    kept = found.where("kept").select(F.col(id_col).alias("keep_id"), F.col("text_sha256").alias("keep_sha"))
    both = materialize(dropped.join(kept, F.col(drop_id).eqNullSafe(F.col("keep_id")) & (F.col(drop_sha) == F.col("keep_sha")), "left_semi"), "repeated")
    own = docs.withColumn(sha, F.sha2(text_or_empty(text_col), 256))
    same = F.col(id_col).eqNullSafe(F.col(drop_id)) & (F.col(sha) == F.col(drop_sha))
    left = own.join(dropped, same, "left_anti").select(*names)
    if both.isEmpty():
        return left
    again = own.join(both, same, "left_semi").dropDuplicates([id_col, sha]).select(*names)
    return left.unionByName(again)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_whole(table(spark, sf_dir, "documents"))


OP7_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
