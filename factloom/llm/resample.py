"""Importance resampling towards a target distribution of hashed word features.

A document's features are its runs of 1 to 2 words; a feature's bucket is its
CRC-32 modulo the number of buckets. Features are found by a byte automaton over
the Arrow buffer of a batch: a lookup table classifies every byte, words are where
the classes differ from one byte to the next, and the CRC's table steps all words
of a slice on by one byte at a time. A two-word feature goes on from the state that
the word before it has reached.

Bucket counts of the corpus and of the target are one vector a task, summed in a
tree. Each bucket has an integer gain; a document's weight is its features' mean
gain, and a seeded Gumbel number added to it makes the highest scores a weighted
sample without repetition. Scores are integers within some 90,000 values whatever
the input's size, so their histogram gives the cut and what stands before each score,
and ranks need no sort of the whole.

Defined results: null or wordless text has no features and weight 0; a row without
a doc_id has no score, is never drawn and doesn't count among those to draw from; rows
of equal score and doc_id get ranks in any order; an empty target or corpus counts as
zero in every bucket. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, tree_reduced, workers_import_us

BUCKETS = 10_000
SEED = 7
MIN_WORDS = 20
#: Of a hundred documents that can be drawn, so many are.
SHARE = 25

#: Bytes that are classified and stepped over at once.
SLICE = 4_000_000
#: The bytes of a word beyond these are stepped over one word at a time.
TOGETHER = 64

_ONES = 0xFFFFFFFF
_SPACE = 32


def _crc_table() -> np.ndarray:
    table_ = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table_ = np.where(table_ & 1, np.uint32(0xEDB88320) ^ (table_ >> np.uint32(1)), table_ >> np.uint32(1)).astype(np.uint32)
    return table_


_CRC = _crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Of lower-cased bytes: digits, letters and all of a character beyond ASCII.
_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _stepped(state: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC states after each word of data, from the states before it; longest first, so that those still running are a prefix."""
    order = np.argsort(-sizes, kind="stable")
    now, at = state[order], starts[order]
    running = np.cumsum(np.bincount(np.minimum(sizes, TOGETHER), minlength=TOGETHER + 1)[::-1])[::-1]
    for k in range(TOGETHER):
        m = int(running[k + 1])
        if not m:
            break
        now[:m] = _CRC[(now[:m] ^ data[at[:m] + k]) & 255] ^ (now[:m] >> 8)
    for i in range(int(np.count_nonzero(sizes > TOGETHER))):
        a = int(at[i])
        rest = data[a + TOGETHER : a + int(sizes[order[i]])].tobytes()
        now[i] = zlib.crc32(rest, int(now[i]) ^ _ONES) ^ _ONES
    out = np.empty_like(now)
    out[order] = now
    return out


def _buckets(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, doc: np.ndarray, old: bool, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of the features of words in order; if old, the first word has been counted and only links the next to it."""
    one = _stepped(np.full(len(starts), _ONES, np.uint32), data, starts, sizes)
    second = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    before = one[second - 1]
    before = _CRC[(before ^ _SPACE) & 255] ^ (before >> 8)
    two = _stepped(before, data, starts[second], sizes[second])
    fresh = slice(int(old), None)
    return np.concatenate((doc[fresh], doc[second])), (np.concatenate((one[fresh], two)) ^ np.uint32(_ONES)) % buckets


def features(texts: pa.Array, buckets: int = BUCKETS, step: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, buckets, documents of the words) of an array of texts, a slice at a time.

    A slice ends between words; where that is within a text, the next one starts with the slice's last word again.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at, done, end, old = int(bounds[0]), int(bounds[0]), int(bounds[-1]), False
    while done < end:
        stop = min(done + step, end)
        limit = int(bounds[np.searchsorted(bounds, stop)])  # the end of the text that stop is in
        while stop < limit:
            part = whole[stop : min(stop + 65536, limit)]
            gap = np.flatnonzero(~_IN_WORD[_LOWER[part]])
            if len(gap):
                stop += int(gap[0])
                break
            stop += len(part)
        inner = bounds[np.searchsorted(bounds, at, "right") : np.searchsorted(bounds, stop)] - at  # texts that start behind at
        first = int(np.searchsorted(bounds, at, "right")) - 1
        data = _LOWER[np.insert(whole[at:stop], inner, _SPACE)]
        edges = np.flatnonzero(np.diff(_IN_WORD[data].astype(np.int8), prepend=0, append=0))
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        gaps = inner + np.arange(len(inner))
        doc = first + np.searchsorted(gaps, starts)
        if len(starts):
            docs, found = _buckets(data, starts, sizes, doc, old, buckets)
            if len(found):
                yield docs, found, doc[int(old) :]
        done = stop
        last = int(doc[-1]) if len(doc) else -1
        if len(starts) and stop < int(bounds[last + 1]):  # the text goes on
            at, old = at + int(starts[-1]) - int(np.searchsorted(gaps, starts[-1])), True
        else:
            at, old = stop, False


def _summed(a: bytes, b: bytes) -> bytes:
    return (np.frombuffer(a, np.int64) + np.frombuffer(b, np.int64)).tobytes()


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket: a vector a task, summed in a tree."""
    workers_import_us(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found, _ in features(batch.column(0), buckets):
                counts += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], names=["state"])

    done = tree_reduced(texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "state binary"), _summed)
    return np.frombuffer(done, np.int64) if done else np.zeros(buckets, np.int64)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of how much likelier a bucket is in the target), one added to every bucket."""
    n = len(corpus)
    all_s, all_t = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words, n_features, weight), one for each row of docs."""
    workers_import_us(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for doc, found, of_word in features(batch.column(1), len(gain)):
                low, high = int(of_word[0]), int(of_word[-1]) + 1
                words[low:high] += np.bincount(of_word - low, minlength=high - low)
                # sums of integers far below 2 ** 53, so exact as doubles
                total[low:high] += np.bincount(doc - low, weights=gain[found], minlength=high - low).astype(np.int64)
            n = np.maximum(2 * words - 1, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["id", "n_words", "n_features", "weight"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "id long, n_words long, n_features long, weight long")


def scored(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """weights (id, weight, ...) with score: weight and the id's Gumbel number, in thousandths and rounded down."""
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((hashed + 0.5) / 4294967296.0)))
    return weights.withColumn("score", F.col("weight") + gumbel)


def ranked(scores: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """scores (id, n_words, score, ...) with rank: 1, 2, ... from the highest score down for the share that is drawn, else null.

    scores should be a written table. Its histogram over scores comes to the driver: at most some 90,000 rows, since a
    score is the sum of two numbers of bounded range.
    """
    spark = scores.sparkSession
    able = F.coalesce(F.col("n_words") >= min_words, F.lit(False)) & F.col("score").isNotNull()
    bins = sorted(((r[0], r[1]) for r in scores.where(able).groupBy("score").count().collect()), reverse=True)
    drawn = share * sum(n for _, n in bins) // 100
    before: list[tuple[int, int]] = []
    seen = 0
    for score, n in bins:
        if seen >= drawn:
            break
        before.append((score, seen))
        seen += n
    if not before:
        return scores.withColumn("rank", F.lit(None).cast("long"))
    top = able & (F.col("score") >= before[-1][0])
    offsets = F.broadcast(spark.createDataFrame(before, "of_score long, before long"))
    place = F.row_number().over(Window.partitionBy("score").orderBy("id")) + F.col("before")
    upper = scores.where(top).join(offsets, F.col("score") == F.col("of_score")).withColumn("rank", place.cast("long")).drop("of_score", "before")
    upper = upper.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return upper.unionByName(scores.where(~top).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Rows (id, n_words, n_features, weight, score, rank), one for each row of docs."""
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    rows = materialize(scored(weighed(docs, gain, id_col, text_col), seed), "scores")
    return ranked(rows, share, min_words).withColumnRenamed("id", id_col)


def keep_drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The rows of docs that are drawn, with all their columns; ids should be unique."""
    drawn = resample(docs, target, id_col, **settings).where(F.col("rank").isNotNull()).select(F.col(id_col).alias("drawn_id")).distinct()
    return docs.join(drawn, docs[id_col] == drawn["drawn_id"], "left_semi")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = r"""
WITH RECURSIVE steps(k, v, c) AS (
    SELECT 0, i, i::BIGINT FROM range(256) t(i)
    UNION ALL
    SELECT k + 1, v, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM steps WHERE k < 8
),
crc AS (SELECT list(c ORDER BY v) AS step FROM steps WHERE k = 8),
texts AS (
    SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents
    UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark
),
words AS (
    SELECT side, r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM texts
),
runs AS (
    SELECT side, r, unnest(w) AS f FROM words
    UNION ALL
    SELECT side, r, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
),
named AS (
    SELECT f, list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT) AS b
    FROM (SELECT DISTINCT f FROM runs)
),
bucketed AS (
    SELECT f, xor(list_reduce(b, lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
    FROM named, crc
),
hits AS (SELECT side, r, bucket FROM runs JOIN bucketed USING (f)),
counts AS (
    SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 't') AS t FROM hits GROUP BY bucket
),
totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM counts),
gain AS (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS g FROM counts, totals
),
weights AS (
    SELECT r, count(*) AS n_features, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM hits JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r
),
scores AS (
    SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM words LEFT JOIN weights USING (r) WHERE side = 'd'
),
able AS (
    SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scores WHERE n_words >= 20 AND score IS NOT NULL
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM able
UNION ALL
SELECT doc_id, n_features, weight, score, NULL FROM scores WHERE NOT coalesce(n_words >= 20 AND score IS NOT NULL, false)
"""
