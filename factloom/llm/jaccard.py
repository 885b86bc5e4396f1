"""Similarity join of documents on the Jaccard index of their word shingles, by an R-tree over count vectors.

Tokens (distinct shingles) are hashed into groups, and a document is the point of its
groups' counts. The summed coordinate minima of two points are at least the overlap
of their sets; with a node's coordinate maxima in place of a point they bound the
overlap with all below it. What the bounds leave is verified on the sets.

Such points lie too close together for one tree over all documents to part them, so
points are routed first, by the groups as well. Sets of n tokens that link differ in at most
D = n * (100 - p) / p tokens. Tokens are hashed into K > D groups, by intervals of their hash, so at least K - D
groups hold the same tokens in both; groups are put in one order for all documents (many tokens
first, then by digest), and of that order the first D + 1 of each document must
have one in common. K depends on the size's power of two; a document near the
next smaller one is routed there as well. Documents that share such a group, directly or by
others, form a region, and each region has a tree. A region of more than
REGION tokens is dealt out by ranges of size and hashed blocks, and every pair of blocks
whose sizes can link has a tree.

Copies are folded to one class a set first. In a region links between classes already connected aren't
looked at again, so a region gives a spanning forest of its links; pairs() gives them all.

Defined results: null, empty or wordless text has no shingles and links with nothing; texts
of fewer words than a shingle have one, the whole sequence; repeated rows and equal sets
share a component; component_id is the smallest doc_id of the component (null only if all are null).
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, workers_import_us
from .simhash import components

WORDS = 3
PERCENT = 90
#: Coordinates of a point in a tree.
GROUPS = 64
#: Tokens of a region that one task takes in.
REGION = 2_000_000
#: Classes whose texts are read again are looked up by broadcast up to so many.
BROADCAST_ROWS = 200_000

_LEAF = 16
#: Sizes from one power of this to the next are a range of a region that is dealt out; above 100 / PERCENT, so that only neighbours can link.
_RANGE = 1.2


def tokens(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of UTF-8 text, A-Z lower-cased."""
    found = text.lower().split()  # of bytes: both know ASCII only
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    digest = xxhash.xxh3_64_intdigest
    if len(found) <= words:
        return np.array([digest(joined)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], gaps[: len(found) - words] + 1)).tolist()
    ends = np.concatenate((gaps[words - 1 :], [len(joined)])).tolist()
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, ends, strict=True)], np.uint64))


def most_apart(n: int, percent: int) -> int:
    """In how many tokens a set that links with one of n tokens, or fewer, can differ from it."""
    return n * (100 - percent) // percent


def _family(found: np.ndarray, level: int, percent: int) -> np.ndarray:
    """The digests of the groups that route a set among those whose smaller partner has 2 ** level tokens or more, and under twice as many."""
    largest = (2 << level) - 1
    apart = most_apart(largest, percent)
    groups = apart + apart // 2 + 2
    group = (((found >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)  # ascends as the hashes do
    starts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1))
    sizes = np.zeros(groups, np.int64)
    sums = np.zeros(groups, np.uint64)
    sizes[group[starts]] = np.diff(np.append(starts, len(group)))
    sums[group[starts]] = np.add.reduceat(found, starts)
    digests = (sums ^ (np.arange(groups, dtype=np.uint64) + np.uint64((level + 1) << 40)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    first = np.lexsort((digests, -sizes))[: most_apart(min(len(found), largest), percent) + 1]
    return digests[first]


def routes(found: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of which two sets that link, and aren't equal, have at least one in common."""
    n = len(found)
    if not most_apart(n, percent):
        return np.empty(0, np.uint64)
    level = n.bit_length() - 1
    out = [_family(found, level, percent)]
    if level and 100 * ((1 << level) - 1) >= percent * n:
        out.append(_family(found, level - 1, percent))
    return np.concatenate(out)


class Tree:
    """A packed R-tree: points in tiles by size and by half of their coordinates, nodes with coordinate maxima and the range of sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        slabs = max(1, int((len(points) / _LEAF) ** 0.5))
        slab = np.argsort(np.argsort(sizes, kind="stable")) * slabs // max(1, len(sizes))
        self.order = np.lexsort((points[:, : points.shape[1] // 2].sum(axis=1), slab))
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > 1:
            top, least, most = self.levels[-1]
            cuts = np.arange(0, len(top), _LEAF)
            self.levels.append((np.maximum.reduceat(top, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)))

    def near(self, points: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of a point, number of a tree's point, bound) wherever the bound allows a link."""
        at = np.arange(len(points))
        node = np.zeros(len(points), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            top, least, most = self.levels[k]
            if k < len(self.levels) - 1:
                node = (node[:, None] * _LEAF + np.arange(_LEAF)).ravel()
                at = np.repeat(at, _LEAF)
                at, node = at[node < len(top)], node[node < len(top)]
            fits = (100 * most[node] >= percent * sizes[at]) & (percent * least[node] <= 100 * sizes[at])
            at, node = at[fits], node[fits]
            bound = np.minimum(points[at], top[node]).sum(axis=1, dtype=np.int64)
            enough = (100 + percent) * bound >= percent * (sizes[at] + least[node])
            at, node, bound = at[enough], node[enough], bound[enough]
        return at, self.order[node], bound


def count_vectors(sets: list[np.ndarray], groups: int = GROUPS) -> np.ndarray:
    sizes = np.array([len(s) for s in sets])
    cell = np.repeat(np.arange(len(sets)), sizes) * groups + (np.concatenate(sets) % np.uint64(groups)).astype(np.int64)
    return np.bincount(cell, minlength=len(sets) * groups).reshape(len(sets), groups).astype(np.int32)


def _overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many tokens each of the others (none empty) has in common with one."""
    joined = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, joined), len(one) - 1)
    return np.add.reduceat((one[at] == joined).astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))


def linked(sets: list[np.ndarray], side: np.ndarray | None = None, percent: int = PERCENT, forest: bool = True) -> list[tuple[int, int, int]]:
    """(number, number, overlap) of sets that link, all of them or a spanning forest; side: only pairs of one 0 and one 1."""
    sizes = np.array([len(s) for s in sets], np.int64)
    points = count_vectors(sets)
    left = np.arange(len(sets)) if side is None else np.flatnonzero(side == 0)
    right = left if side is None else np.flatnonzero(side == 1)
    if not (len(left) and len(right)):
        return []
    tree = Tree(points[right], sizes[right])
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out: list[tuple[int, int, int]] = []
    step = 64
    for at in range(0, len(left), step):
        own = left[at : at + step]
        q, r, bound = tree.near(points[own], sizes[own], percent)
        q, r = own[q], right[r]
        if side is None:
            q, r, bound = q[r > q], r[r > q], bound[r > q]
        if not len(q):
            continue
        order = np.lexsort((-bound, q))
        q, r = q[order], r[order]
        cuts = np.flatnonzero(np.diff(q, prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(q)], strict=True):
            one, rest, most = int(q[a]), r[a:b].tolist(), 4
            while rest:
                if forest:
                    mine = find(one)
                    rest = [x for x in rest if find(x) != mine]
                    if not rest:
                        break
                some, rest, most = rest[:most], rest[most:], 2 * most
                for x, common in zip(some, _overlaps(sets[one], [sets[x] for x in some]).tolist(), strict=True):
                    if 100 * common >= percent * (len(sets[one]) + len(sets[x]) - common) and not (forest and find(one) == find(x)):
                        root[max(find(one), find(x))] = min(find(one), find(x))
                        out.append((one, x, common))
    return out


def _sets(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """Rows (id, own, n, digest, node, routes): a task gives the routes of equal sets once. own: a hash of the text, node: a part of the digest."""
    workers_import_us(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            n, digests, keys = [], [], []
            for text in batch.column(2).cast(pa.binary()):
                found = tokens(text.as_py() or b"", words)
                n.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                keys.append(None if digests[-1] in seen else routes(found, percent).view(np.int64))
                seen.add(digests[-1])
            nodes = [None if d is None else int.from_bytes(d[:8], "big", signed=True) for d in digests]
            out = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names=["id", "own", "n", "digest", "node", "routes"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("own"), F.col(text_col).cast("string").alias("text"))
    return materialize(slim.mapInArrow(run, "id long, own long, n long, digest binary, node long, routes array<long>"), "sets")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (route, node) sorted; gives (a, b) of each route's least node and every other one."""
    route, low, last = None, 0, 0
    for batch in batches:
        routes_, nodes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        if not len(routes_):
            continue
        starts = np.concatenate(([0], np.flatnonzero(np.diff(routes_)) + 1))
        lows = nodes[starts]
        on = route == int(routes_[0])
        if on:
            lows[0] = low
        lows = np.repeat(lows, np.diff(np.append(starts, len(nodes))))
        fresh = np.diff(nodes, prepend=last if on else nodes[0] - 1) != 0
        fresh[starts[1:]] = True
        take = fresh & (nodes != lows)
        route, low, last = int(routes_[-1]), lows[-1], nodes[-1]
        if take.any():
            yield pa.RecordBatch.from_arrays([pa.array(lows[take]), pa.array(nodes[take])], names=["a", "b"])


def _regions(sets: DataFrame) -> DataFrame:
    """Rows (digest, n, id, own, region): the classes that share routes with others, with a row that stands for each."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = sets.where("size(routes) > 0").select(F.explode("routes").alias("route"), "node").repartition(parts, "route").sortWithinPartitions("route", "node")
    region = components(routed.mapInArrow(_met, "a long, b long"))
    classes = sets.where("digest IS NOT NULL").groupBy("digest", "node", "n").agg(F.min(F.struct("id", "own")).alias("best"))
    found = classes.join(region.withColumnRenamed("node", "of_node"), F.col("node") == F.col("of_node"))
    return materialize(found.select("digest", "n", F.col("best.id").alias("stands"), F.col("best.own").alias("stands_own"), F.col("root").alias("region")), "regions")


def _dealt(regions: DataFrame, region_tokens: int) -> DataFrame:
    """regions with the keys under which each class meets others: its region, or pairs of blocks; side is null where all rows of a key meet."""
    level = F.floor(F.log("n") / F.log(F.lit(_RANGE))).cast("int")
    ranged = regions.withColumn("level", level)
    whole = regions.groupBy("region").agg(F.sum("n").alias("tokens")).where(F.col("tokens") > region_tokens).select(F.col("region").alias("large"))
    none = F.array().cast("array<struct<key:bigint,side:int>>")
    small = regions.join(whole, F.col("region") == F.col("large"), "left_anti").withColumn("keys", F.array(F.struct(F.xxhash64("region").alias("key"), F.lit(None).cast("int").alias("side"))))
    large = ranged.join(whole, F.col("region") == F.col("large"), "left_semi")
    blocks = large.groupBy("region", "level").agg(F.ceil(F.sum("n") / region_tokens).cast("int").alias("blocks"))
    blocks = blocks.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("level", "blocks"))).alias("of")).withColumnRenamed("region", "of_region")
    dealt = large.join(blocks, F.col("region") == F.col("of_region")).withColumn("block", F.pmod(F.xxhash64("digest"), F.element_at("of", F.col("level"))).cast("int"))

    def numbers(at) -> object:
        return F.when(F.coalesce(F.element_at("of", at), F.lit(0)) > 0, F.sequence(F.lit(0), F.element_at("of", at) - 1)).otherwise(F.array().cast("array<int>"))

    def meeting(a, i, b, j, side) -> object:
        return F.struct(F.xxhash64("region", a, i, b, j).alias("key"), side.cast("int").alias("side"))

    own, up, down = F.col("level"), F.col("level") + 1, F.col("level") - 1
    here = F.col("block")
    same = F.transform(numbers(own), lambda j: meeting(own, F.least(here, j), own, F.greatest(here, j), F.when(j != here, F.when(here < j, 0).otherwise(1))))
    above = F.transform(numbers(up), lambda j: meeting(own, here, up, j, F.lit(0)))
    below = F.transform(numbers(down), lambda j: meeting(down, j, own, here, F.lit(1)))
    dealt = dealt.withColumn("keys", F.concat(none, same, above, below))
    return small.select("digest", "stands", "stands_own", "keys").unionByName(dealt.select("digest", "stands", "stands_own", "keys"))


def _links(docs: DataFrame, sets: DataFrame, id_col: str, text_col: str, words: int, percent: int, region_tokens: int, forest: bool) -> DataFrame:
    """Rows (a, b, overlap) of digests of classes that link."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = materialize(_dealt(_regions(sets), region_tokens), "wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("own", F.xxhash64("text"))
    stands = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    members = texts.join(stands, F.col("id").eqNullSafe(F.col("stands")) & (F.col("own") == F.col("stands_own"))).select("text", "digest", "keys")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tokens(t.as_py() or b"", words).tobytes() for t in batch.column(0).cast(pa.binary())]
            same = [xxhash.xxh3_128_digest(f) == d.as_py() for f, d in zip(found, batch.column(1), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.binary())], names=["digest", "keys", "tokens"])
            yield out.filter(pa.array(same, pa.bool_()))

    kinds = "digest binary, keys array<struct<key:bigint,side:int>>, tokens binary"
    met = members.mapInArrow(again, kinds).select(F.explode("keys").alias("k"), "digest", "tokens").select("k.key", "k.side", "digest", "tokens")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def done() -> pa.RecordBatch:
            names, sets_ = list(held), [np.frombuffer(v[1], np.uint64) for v in held.values()]
            sides = [v[0] for v in held.values()]
            pairs = linked(sets_, None if None in sides else np.array(sides), percent, forest) if len(names) > 1 else []
            columns = [pa.array([names[p[k]] for p in pairs], pa.binary()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([p[2] for p in pairs], pa.int64())], names=["a", "b", "overlap"])

        for batch in batches:
            for k, side, digest, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if held:
                        yield done()
                    key, held = k, {}
                held[digest] = (side, found)  # a repeated row counts once
        if held:
            yield done()

    ordered = met.repartition(parts, "key").sortWithinPartitions("key", "digest")
    return ordered.mapInArrow(joined, "a binary, b binary, overlap long")


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, region_tokens: int = REGION) -> DataFrame:
    """Rows (id, n_shingles, component_id), one for each row of docs."""
    workers_import_us(docs.sparkSession)
    sets = _sets(docs, id_col, text_col, words, percent)
    tied = components(_links(docs, sets, id_col, text_col, words, percent, region_tokens, True).select("a", "b"))
    classes = sets.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("first"))
    rooted = classes.join(tied, F.col("digest") == F.col("node"), "left").select("digest", "first", F.coalesce("root", "digest").alias("root"))
    rooted = materialize(rooted, "rooted")
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(lowest, "root").select(F.col("digest").alias("of_digest"), "component_id")
    found = sets.join(of, F.col("digest") == F.col("of_digest"), "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, region_tokens: int = REGION) -> tuple[DataFrame, DataFrame]:
    """All links (a, b, overlap) between classes of equal sets, and the membership (id, n_shingles, class); a class is a set's digest."""
    sets = _sets(docs, id_col, text_col, words, percent)
    found = _links(docs, sets, id_col, text_col, words, percent, region_tokens, False)
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "overlap").distinct()
    return found, sets.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("digest").alias("class"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE words AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
sets AS (
    SELECT r, doc_id,
           list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
               ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s
    FROM words
),
classes AS (SELECT s, min(r) AS c, min(doc_id) AS first FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT c, len(s) AS n, unnest(s) AS t FROM classes),
links AS (
    SELECT a.c AS a, b.c AS b
    FROM tokens a JOIN tokens b ON a.t = b.t AND a.c <> b.c AND 10 * b.n >= 9 * a.n AND 10 * a.n >= 9 * b.n
    GROUP BY a.c, b.c, a.n, b.n
    HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
),
reach AS (
    SELECT c AS node, c AS other FROM classes
    UNION
    SELECT node, b FROM reach JOIN links ON other = a
),
lowest AS (SELECT node, min(first) AS component_id FROM reach JOIN classes ON other = c GROUP BY node)
SELECT doc_id, len(sets.s) AS n_shingles, CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component_id END AS component_id
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN lowest ON node = c
"""
