"""SimHash near-dedup: a byte-position inverted index with count filtering.

A fingerprint has 8 positional bytes. Two fingerprints at 4 or fewer differing
bits differ in at most 4 bytes, so they share at least 4 of the 8 positional
bytes. Postings of one positional byte hold 1/256 of all fingerprints, which
makes candidates grow with the square of the input; the index therefore keys
its postings by three positional bytes. Of any 7 positions such a pair shares
at least 3, so the 35 triples of the first 7 positions find every pair. Within
a posting, blocks of fingerprints are compared: shared positional bytes are
tallied for each pair, pairs below the guaranteed minimum of 4 are left, and
the rest are verified by their differing bits.

Copies are folded to one row a fingerprint first. A posting gives a spanning
forest of its links, not its pairs; a posting of more than BLOCK fingerprints
is dealt out as pairs of blocks. Components come from alternating large-star
and small-star rounds over those edges, with a written table between rounds.

Defined results: null or wordless text has fingerprint zero, linked like any
other; texts of 1 to 3 words have one shingle, the whole sequence; shingles count
as often as they occur; rows repeated or of equal fingerprint share a component;
component_id is the smallest doc_id of the component (null only if all are null).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, materialize, table, workers_import_us

WORDS = 4
MAX_BITS = 4
HASH_SEED = 42
MIN_BYTES = 4
#: Positional bytes in a posting's key.
KEY_BYTES = 3
#: Fingerprints of one posting that a task compares at once.
BLOCK = 8192

_STEP = 1 << 16


def fingerprint(text: bytes, words: int = WORDS, seed: int = HASH_SEED) -> int:
    """The 64-bit SimHash of the word shingles of UTF-8 text, A-Z lower-cased."""
    tokens = text.lower().split()  # of bytes: both know ASCII only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
        starts = np.concatenate(([0], gaps[: len(tokens) - words] + 1)).tolist()
        ends = np.concatenate((gaps[words - 1 :], [len(joined)])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _STEP):
        part = hashes[at : at + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Rows (id, fp): fp is the fingerprint as a signed long."""
    workers_import_us(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.array([fingerprint(t.as_py() or b"", words) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64), pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def _forest(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (smaller root, member) that connect values (sorted, distinct, signed) as all their links do."""
    n = len(values)
    root = np.arange(n)
    bits = values.view(np.uint64)
    step = max(1, min(n, 4_000_000 // max(n, 1)))
    for at in range(0, n - 1, step):
        diff = bits[at : at + step, None] ^ bits[None, at + 1 :]
        # the count filter: positional bytes that are equal, at least MIN_BYTES of 8
        equal = (diff.view(np.uint8).reshape(*diff.shape, 8) == 0).sum(axis=2, dtype=np.uint8)
        x, y = np.nonzero(equal >= MIN_BYTES)
        near = np.bitwise_count(diff[x, y]) <= MAX_BITS
        x, y = x[near] + at, y[near] + at + 1
        keep = x < y
        root = _united(root, x[keep], y[keep])
    other = np.flatnonzero(root != np.arange(n))
    return values[root[other]], values[other]


def _united(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """root (the smallest index of each one's tree) after linking each x with its y."""
    while len(x):
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            break
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        low, high = np.minimum(a, b), np.maximum(a, b)
        hook = root.copy()
        np.minimum.at(hook, high, low)
        while True:
            nxt = hook[hook]
            if (nxt == hook).all():
                break
            hook = nxt
        root = hook[root]
    return root


def _small_runs(keys: np.ndarray, values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within many short runs at once: each value with those 1, 2, ... places on in its run."""
    left, right = [], []
    end_of = np.repeat(starts + sizes, sizes)
    at = np.concatenate([np.arange(s, s + k) for s, k in zip(starts.tolist(), sizes.tolist(), strict=True)]) if len(starts) else np.empty(0, int)
    for d in range(1, int(sizes.max(initial=1))):
        ok = at + d < end_of
        at, end_of = at[ok], end_of[ok]
        diff = values[at].view(np.uint64) ^ values[at + d].view(np.uint64)
        equal = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        near = (equal >= MIN_BYTES) & (np.bitwise_count(diff) <= MAX_BITS)
        left.append(values[at[near]])
        right.append(values[at[near] + d])
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _postings(batches: Iterator[pa.RecordBatch], block: int | None) -> Iterator[pa.RecordBatch]:
    """Reads postings sorted by (key, fp). Gives links (null, a, b) and, if block is set, rows (key, fp, block number) of larger postings."""
    held_k, held_v = np.empty(0, np.int64), np.empty(0, np.int64)
    large: tuple[int, int] | None = None  # the posting that is being passed on, and how many of it have been

    def links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["key", "a", "b"])

    def passed_on(key: int, values: np.ndarray, done: int) -> pa.RecordBatch:
        number = (np.arange(done, done + len(values)) // block).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(values), key), pa.int64()), pa.array(values, pa.int64()), pa.array(number, pa.int64())], names=["key", "a", "b"])

    def full(keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        starts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1))
        sizes = np.diff(np.concatenate((starts, [len(keys)])))
        few = (sizes > 1) & (sizes <= 32)
        if few.any():
            a, b = _small_runs(keys, values, starts[few], sizes[few])
            if len(a):
                yield links(a, b)
        for s, n in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True):
            if block and n > block:
                yield passed_on(int(keys[s]), values[s : s + n], 0)
                continue
            a, b = _forest(np.ascontiguousarray(values[s : s + n]))
            if len(a):
                yield links(a, b)

    for batch in batches:
        keys, values = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        if large is not None and len(keys):
            same = int(np.searchsorted(keys, large[0], side="right"))
            if same:
                yield passed_on(large[0], values[:same], large[1])
                large = (large[0], large[1] + same)
            if same == len(keys):
                continue
            keys, values, large = keys[same:], values[same:], None
        keys, values = np.concatenate((held_k, keys)), np.concatenate((held_v, values))
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        yield from full(keys[:last], values[:last])
        held_k, held_v = keys[last:], values[last:]
        if block and len(held_k) > block:
            yield passed_on(int(held_k[0]), held_v, 0)
            large = (int(held_k[0]), len(held_k))
            held_k, held_v = np.empty(0, np.int64), np.empty(0, np.int64)
    yield from full(held_k, held_v)


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (a, b), a spanning forest of each posting, over distinct fingerprints (fp)."""
    spark = distinct.sparkSession
    workers_import_us(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    first = 8 - (MIN_BYTES - KEY_BYTES)
    keys = [
        F.lit(n << 24).cast("long").bitwiseOR(F.shiftleft(byte[p], 16)).bitwiseOR(F.shiftleft(byte[q], 8)).bitwiseOR(byte[r])
        for n, (p, q, r) in enumerate(combinations(range(first), KEY_BYTES))
    ]
    postings = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp").repartition(parts, "key").sortWithinPartitions("key", "fp")
    found = materialize(postings.mapInArrow(lambda rows: _postings(rows, block), "key long, a long, b long"), "links")
    few = found.where(F.col("key").isNull()).select("a", "b")

    # larger postings: every pair of blocks is a posting of its own, and a pair (i, i) isn't needed where there is (i, j)
    large = found.where(F.col("key").isNotNull()).select("key", F.col("a").alias("fp"), F.col("b").alias("block"))
    if large.isEmpty():
        return few.distinct()
    blocks = large.groupBy("key").agg(F.max("block").alias("top")).select(F.col("key").alias("large_key"), "top")
    other = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), "top"), lambda j: (j != F.col("block")) | (F.col("top") == 0)))
    dealt = large.join(blocks, F.col("key") == F.col("large_key")).select("key", "fp", "block", other.alias("other"))
    pair = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    dealt = dealt.select(pair.alias("key"), "fp").repartition(parts, "key").sortWithinPartitions("key", "fp")
    more = dealt.mapInArrow(lambda rows: _postings(rows, None), "key long, a long, b long").select("a", "b")
    return few.unionByName(more).distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Rows (node, root) for every node of edges (a, b): root is the smallest node of its component.

    Alternating large-star and small-star; each round is a few shuffles of
    edges, and the table written after it cuts the lineage.
    """
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components haven't settled in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _components_of(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (of_fp, root, component_id), one for each fingerprint of prints (id, fp): its component and the smallest id there."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct")
    parts = components(links(distinct.select("fp"), block))
    rooted = distinct.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    low = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(low, "root").select(F.col("fp").alias("of_fp"), "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """Rows (id, fingerprint, component_id), one for each row of docs."""
    prints = materialize(fingerprints(docs, id_col, text_col, words), "prints")
    found = prints.join(_components_of(prints, block), F.col("fp") == F.col("of_fp"))
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, spare_null: bool = True) -> DataFrame:
    """docs with one row of each component, of its smallest doc_id.

    Rows of a null doc_id all stay if spare_null; else one stays where a component has no doc_id.
    Rows whose doc_id is null or occurs again can't be told apart by it, so only their fingerprints are worked out once more.
    """
    names = docs.columns
    prints = materialize(fingerprints(docs, id_col, text_col, words), "prints")
    of = materialize(_components_of(prints), "components")
    gone, odd_id = free_name(names, "gone_id"), free_name(names, "odd_id")
    odd = materialize(prints.where("id IS NOT NULL").groupBy("id").count().where("count > 1").select(F.col("id").alias(odd_id)), "odd")
    dropped = prints.join(of, F.col("fp") == F.col("of_fp")).where(F.col("id") != F.col("component_id")).select(F.col("id").alias(gone))
    dropped = dropped.unionByName(odd.select(F.col(odd_id).alias(gone))).distinct()
    known = docs.where(F.col(id_col).isNotNull())
    kept = known.join(dropped, F.col(id_col) == F.col(gone), "left_anti").select(*names)
    nulls = docs.where(F.col(id_col).isNull())
    again = None if odd.isEmpty() else known.join(odd, F.col(id_col) == F.col(odd_id), "left_semi").select(*names)
    if spare_null:
        kept = kept.unionByName(nulls)
    elif not prints.where("id IS NULL").isEmpty():
        again = nulls if again is None else again.unionByName(nulls)
    return kept if again is None else kept.unionByName(_one_a_component(again, of, id_col, text_col, words))


def _one_a_component(docs: DataFrame, of: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Of the rows that carry their component's smallest doc_id, one for each component; rows are told apart by a number written with them."""
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("n"), F.struct(*docs.columns).alias("row")), "again")
    prints = fingerprints(rows.select("n", F.col("row")[text_col].alias("text")), "n", "text", words)
    ids = rows.select("n", F.col("row")[id_col].cast("long").alias("own_id"))
    lowest = prints.join(of, F.col("fp") == F.col("of_fp")).join(ids, F.col("id") == F.col("n")).where(F.col("own_id").eqNullSafe(F.col("component_id")))
    chosen = lowest.groupBy("root").agg(F.min("n").alias("chosen"))
    return rows.join(chosen, F.col("n") == F.col("chosen"), "left_semi").select("row.*")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
