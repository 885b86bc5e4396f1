"""Embedding whitening by merged statistics of partitions.

Each task reduces its vectors to their number, sums, mean and centred scatter; two
such states merge by Chan's formula, in pairs and in a tree. The covariance that
comes to the driver is as wide as a vector, whatever the number of rows; its
eigenvectors there give the components, and a second pass over the data measures
how far the whitened vectors' covariance is from the identity.

Vectors are brought to whole numbers x = floor(scale * entry) first, so that
equal vectors are equal exactly, sums are exact and no order of merging shows in
them. An offset common to all entries changes neither deviations nor components, so
none is added.

Defined results: rows whose vector is null, empty, or holds a null, NaN or infinite
entry are dropped, and so are those of another length than the most frequent one (of
equally frequent ones the longest); whole numbers beyond 2 ** 53 are taken as 2 ** 53; equal vectors count once in
the fit, and every row is transformed; components whose eigenvalue is zero to double precision
are left out, so vectors that are all alike give no rows; a deviation that no long can hold is null.
Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, tree_reduced, workers_import_us

SCALE = 64
COMPONENTS = 16
#: Whole numbers up to this are exact as doubles.
LARGEST = 2**53
#: An eigenvalue of at most this share of the trace is zero.
ZERO = 1e-12

#: Vectors that are centred at once.
_STEP = 4096


@dataclass
class Moments:
    """Of some vectors: how many, their exact sums, and the scatter about their mean. Values that aren't whole have float sums."""

    n: int
    sums: np.ndarray  # of Python integers, or of floats
    scatter: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums], np.float64)

    @staticmethod
    def of(values: np.ndarray) -> Moments:
        whole = values.dtype.kind == "i"
        wide = whole and len(values) and int(np.abs(values).max()) > 2**40
        sums = values.astype(object).sum(axis=0) if wide else values.sum(axis=0).astype(object if whole else np.float64)
        centred = values - np.array([s / len(values) for s in sums], np.float64)
        return Moments(len(values), sums, centred.T @ centred)

    def merged(self, other: Moments) -> Moments:
        """Chan's formula: the scatters add up, with what the distance of the means adds."""
        if not (self.n and other.n):
            return self if self.n else other
        n, apart = self.n + other.n, other.mean - self.mean
        return Moments(n, self.sums + other.sums, self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n))


NO_MOMENTS = Moments(0, np.zeros(0), np.zeros((0, 0)))


def _merged(a: bytes, b: bytes) -> bytes:
    return pickle.dumps(pickle.loads(a).merged(pickle.loads(b)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls; all lists have the same length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def moments(vectors: DataFrame, through=None) -> Moments:
    """The moments of vectors (x), or of what the function `through` makes of a matrix of them."""
    workers_import_us(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = NO_MOMENTS
        for batch in batches:
            values = _matrix(batch.column(0)) if batch.num_rows else np.zeros((0, 0))
            for at in range(0, len(values), _STEP):
                part = values[at : at + _STEP]
                now = now.merged(Moments.of(through(part) if through else part))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(now)], pa.binary())], names=["state"])

    state = tree_reduced(vectors.select("x").mapInArrow(run, "state binary"), _merged)
    return pickle.loads(state) if state else NO_MOMENTS


@dataclass
class Whitening:
    """n vectors with exact sums; unit eigenvectors in columns by falling eigenvalue, the trace of the covariance, and the largest error of the identity."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    error: float = 0.0

    def spread(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: longs, or Python integers where those are too short."""
        top = max([int(np.abs(x).max(initial=0)) * self.n, *(abs(int(s)) for s in self.sums)])
        kind = np.int64 if top < 2**61 else object
        return x.astype(kind) * self.n - self.sums.astype(kind)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.spread(x).astype(np.float64) / self.n) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        d = self.spread(x)
        if int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2**63:
            return (d * d).sum(axis=1).tolist()
        full = (d.astype(object) ** 2).sum(axis=1).tolist()
        return [v if v < 2**63 else None for v in full]


def whole_vectors(rows: DataFrame, vector_col: str = "embedding", scale: int = SCALE) -> Column:
    """The column as whole numbers, null where it is left out."""
    v = F.col(vector_col).cast("array<double>")
    sound = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    top = float(LARGEST)
    x = F.transform(v, lambda c: F.greatest(F.lit(-top), F.least(F.lit(top), F.floor(F.least(F.greatest(c * scale, F.lit(-top)), F.lit(top))).cast("double"))).cast("long"))
    return F.when(sound, x)


def sound_rows(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows (id, x) of those that count."""
    slim = rows.select(F.col(id_col).cast("long").alias("id"), whole_vectors(rows, vector_col, scale).alias("x")).where("x IS NOT NULL")
    length = slim.groupBy(F.size("x").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).first()
    return slim.where(F.size("x") == (length["k"] if length else 0))


def fit(sound: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of sound (id, x); None if there are none."""
    distinct = materialize(sound.select("x").distinct(), "vectors")
    seen = moments(distinct)
    if not seen.n:
        return None
    values, vectors = np.linalg.eigh(seen.scatter / seen.n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    trace = float(np.trace(seen.scatter / seen.n))
    some = values > ZERO * max(trace, 0.0)
    values, vectors = values[some], vectors[:, some]
    if vectors.size:  # of the two signs, the one that makes the largest entry positive
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    done = Whitening(seen.n, seen.sums, vectors, values, trace)
    if len(values):
        again = moments(distinct, done.whitened)
        done.error = float(np.abs(again.scatter / again.n - np.eye(len(values))).max())
    return done


def transform(sound: DataFrame, w: Whitening) -> DataFrame:
    """Rows (id, deviation, whitened) of sound (id, x): the whitened vector as an array."""
    workers_import_us(sound.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                out = w.whitened(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w.deviations(x), pa.int64()), lists], names=["id", "deviation", "whitened"])

    return sound.select("id", "x").mapInArrow(run, "id long, deviation long, whitened array<double>")


def by_component(sound: DataFrame, w: Whitening | None, id_col: str = "vec_id") -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error)."""
    if w is None or not len(w.values):
        shape = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return sound.sparkSession.createDataFrame([], shape)
    explained = F.array(*(F.lit(float(e / w.trace)) for e in w.values))
    each = transform(sound, w).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(w.error).alias("identity_error"),
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    sound = sound_rows(table(spark, sf_dir, "embeddings"))
    return by_component(sound, fit(sound))
