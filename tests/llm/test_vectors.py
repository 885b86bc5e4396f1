"""Whitening, the shingle join and importance resampling against computations of their own."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import jaccard, resample, whitening


# --- whitening


def whitened_by_hand(rows):
    """{vec_id: (deviation, matrix row)}, explained and n, with numpy's covariance over distinct vectors."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    distinct = np.array(sorted({tuple(x) for _, x in good}))
    n, sums = len(distinct), distinct.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(distinct.T, bias=True))
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    out = {i: (sum((n * a - int(s)) ** 2 for a, s in zip(x, sums)), (np.array([float(Fraction(n * a - int(s), n)) for a, s in zip(x, sums)]) @ vectors) / np.sqrt(values)) for i, x in good}
    return out, values / np.trace(np.cov(distinct.T, bias=True)), n


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20)) * 0.2
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base.astype(np.float32))]
    rows += [(1000 + i, rows[5][1]) for i in range(150)]  # a common vector counts once in the fit
    rows += [(2000, None), (2001, []), (2002, [None] * 20), (2003, [float("nan")] * 20), (2004, [float("inf")] + [0.0] * 19), (2005, [0.5] * 7)]
    return rows + [rows[7]]


@pytest.mark.parametrize("parts", [1, 7])
def test_whitening(spark, vectors, parts):
    df = spark.createDataFrame([(*r, 1) for r in vectors], "vec_id long, embedding array<float>, ID int").repartition(parts)
    sound = whitening.sound_rows(df)
    w = whitening.fit(sound)
    got = whitening.by_component(sound, w).collect()
    want, explained, n = whitened_by_hand([r for r in vectors if r[0] < 2000])
    assert w.error < 1e-9 and len(got) == 16 * 451 and {r.vec_id for r in got} == set(want)
    by = {(r.vec_id, r.component): r for r in got}
    for k in range(16):
        ours, theirs = np.array([by[i, k + 1].whitened for i in sorted(want)]), np.array([want[i][1][k] for i in sorted(want)])
        assert min(np.abs(ours - theirs).max(), np.abs(ours + theirs).max()) < 1e-8
        assert math.isclose(by[3, k + 1].explained, explained[k], rel_tol=1e-9)
    assert all(r.n == n == 300 and r.deviation == want[r.vec_id][0] and r.identity_error == w.error for r in got)


def test_whitening_of_few_vectors(spark):
    shape = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])] * 3):
        sound = whitening.sound_rows(spark.createDataFrame(rows, shape))
        got = whitening.by_component(sound, whitening.fit(sound))
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and not got.collect()
    flat = whitening.sound_rows(spark.createDataFrame([(1, [1.0, 5.0]), (2, [2.0, 5.0])], shape))
    assert [(r.vec_id, r.component, r.deviation, abs(round(r.whitened, 9))) for r in sorted(whitening.by_component(flat, whitening.fit(flat)).collect())] == [(1, 1, 64**2, 1.0), (2, 1, 64**2, 1.0)]
    far = whitening.sound_rows(spark.createDataFrame([(1, [1e37, 0.0]), (2, [-1e37, 1.0])], shape))
    assert {r.deviation for r in whitening.by_component(far, whitening.fit(far)).collect()} == {None}


def test_moments_merge_in_any_order():
    rng = np.random.default_rng(1)
    values = rng.integers(-(10**6), 10**6, size=(400, 5)) + 10**9
    whole = whitening.Moments.of(values)
    for cuts in ([1, 2, 399], [200], [50, 51, 300]):
        parts = [whitening.Moments.of(p) for p in np.split(values, cuts)]
        random.Random(len(cuts)).shuffle(parts)
        state = whitening.NO_MOMENTS
        for p in parts:
            state = state.merged(p)
        assert state.n == 400 and list(state.sums) == list(whole.sums) and np.abs(state.scatter - whole.scatter).max() < 1e-11 * whole.scatter.max()  # off the diagonal little is left of large sums
    assert np.allclose(whole.scatter / 400, np.cov(values.T, bias=True), rtol=1e-9)


# --- shingle join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([" ".join(w)] if 0 < len(w) < 3 else [" ".join(w[i : i + 3]) for i in range(len(w) - 2)])


def components_by_hand(rows, percent=90):
    sets = {k: shingles(t) for k, (_, t) in enumerate(rows)}
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = set()
    for a, b in combinations(sets, 2):
        common, both = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * both:
            root[max(find(a), find(b))] = min(find(a), find(b))
            if sets[a] != sets[b]:
                links.add(frozenset((sets[a], sets[b])))
    ids = {}
    for k in sets:
        ids.setdefault(find(k), []).append(rows[k][0])
    low = {r: min((i for i in found if i is not None), default=None) for r, found in ids.items()}
    return [(rows[k][0], len(sets[k]), low[find(k)]) for k in sets], len(links)


def near_copies():
    """Texts with 0 to 12 words changed, of many lengths, about the threshold; chains of changes; short and odd texts."""
    r = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for size in (3, 4, 5, 9, 11, 12, 20, 21, 40, 64, 65, 130, 300, 900):
        base = [r.choice(words) for _ in range(size)]
        rows.append(" ".join(base))
        for changes in (0, 1, 1, 1, 2, 3, 5, 8, 12):
            other = list(base)
            for _ in range(changes):
                at = r.randrange(size)
                other[at : at + r.choice((0, 1))] = [r.choice(words)]
            rows.append(" ".join(other))
        for _ in range(6):  # each one word on from the one before
            base[r.randrange(size)] = r.choice(words)
            rows.append(" ".join(base))
    rows += [None, "", " \t\n", "one", "One", "one two", "ONE\ttwo", "ÄÖ ä", "äö ä", "one two three", "x " * 5000, "x " * 6000]
    r.shuffle(rows)
    return [(k * 7 % 1009, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("region_tokens", [jaccard.REGION, 2000, 150])
def test_shingle_join(spark, region_tokens):
    rows = near_copies()
    rows += [(None, rows[3][1]), (None, "nowhere else at all"), rows[8], (rows[9][0], rows[20][1])]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, ID string, digest int").repartition(5)
    want, n_links = components_by_hand(rows)
    assert sorted(map(repr, map(tuple, jaccard.components_of(df, region_tokens=region_tokens).collect()))) == sorted(map(repr, want))
    if region_tokens == 2000:
        links, members = jaccard.pairs(df, region_tokens=region_tokens)
        assert links.count() == n_links > 100 and members.count() == len(rows)


def test_shingle_join_without_rows(spark):
    shape = "doc_id long, text string"
    for rows in ([], [(1, None), (2, ""), (3, None)]):
        assert sorted(map(tuple, jaccard.components_of(spark.createDataFrame(rows, shape)).collect())) == [(i, 0, i) for i, _ in rows]


def test_other_thresholds(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.components_of(df, percent=70).collect())) == sorted(components_by_hand(rows, 70)[0])


def test_linking_sets_share_a_route():
    r = random.Random(2)
    for n in [*range(9, 60), 127, 128, 141, 142, 143, 500, 1023, 1024, 1137]:
        base = [r.getrandbits(64) for _ in range(n)]
        for gone in range(n // 9 + 1):  # some go, others come, as many as a link allows
            come = jaccard.most_apart(n, 90) - gone if gone < n // 9 else 0
            other = base[gone:] + [r.getrandbits(64) for _ in range(come)]
            common = n - gone
            if 100 * common >= 90 * (n + come):
                assert set(jaccard.routes(np.unique(np.array(base, np.uint64))).tolist()) & set(jaccard.routes(np.unique(np.array(other, np.uint64))).tolist()), (n, gone)


def test_tree_bounds_miss_nothing():
    r = np.random.default_rng(4)
    base = [r.integers(0, 2**63, size=n, dtype=np.uint64) for n in (30, 40, 200, 210)]
    sets = [np.unique(np.concatenate((b[: len(b) - k], r.integers(0, 2**63, size=k, dtype=np.uint64)))) for b in base for k in [*range(8)] * 12]
    all_, forest = jaccard.linked(sets, forest=False), jaccard.linked(sets)
    want = {(a, b) for a, b in combinations(range(len(sets)), 2) if 100 * len(x := np.intersect1d(sets[a], sets[b])) >= 90 * (len(sets[a]) + len(sets[b]) - len(x))}
    assert {tuple(sorted(p[:2])) for p in all_} == want and len(all_) == len(want) > len(forest)
    side = np.arange(len(sets)) % 2
    assert {tuple(sorted(p[:2])) for p in jaccard.linked(sets, side, forest=False)} == {p for p in want if (p[0] + p[1]) % 2}


# --- importance resampling


def words_of(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def features_of(text):
    w = words_of(text)
    return [zlib.crc32(f) % 10_000 for f in w + [a + b" " + b for a, b in zip(w, w[1:])]]


TEXTS = [None, "", "...", "one", "One TWO", "a1-b2_c3", "naïve Straße ß", "日本語 " * 40, "x" * 70 + " " + "y" * 65, "tail", "z" * 200, "a b " * 50, "é" * 90 + "\x00\x7f" + "q" * 64]


@pytest.mark.parametrize("step", [1, 7, 64, 1000, 10**6])
def test_features_whatever_the_slices(step):
    r = random.Random(step)
    texts = TEXTS + [" ".join(r.choice(["ab", "cde", "f", "日本", "g-h", "," * 9]) for _ in range(r.randrange(60))) for _ in range(40)]
    for arr in (pa.array(texts), pa.array(["front", *texts])[1:], pa.array(texts, pa.large_string())):
        found, words = [[] for _ in texts], [0] * len(texts)
        for docs, buckets, of_words in resample.features(arr, step=step):
            for d, b in zip(docs.tolist(), buckets.tolist()):
                found[d].append(b)
            for d in of_words.tolist():
                words[d] += 1
        assert [sorted(f) for f in found] == [sorted(features_of(t)) for t in texts] and words == [len(words_of(t)) for t in texts]


def test_resampling(spark):
    r = random.Random(9)
    vocabulary = [f"v{k}" for k in range(200)]
    rows = [(k, " ".join(r.choices(vocabulary[: r.choice((30, 200))], k=r.randrange(60)))) for k in range(300)]
    rows += [(300 + k, t) for k, t in enumerate(TEXTS)] + [(400 + k, rows[0][1] + " same") for k in range(100)] + [(5, rows[5][1]), (None, rows[1][1])]
    target = [" ".join(r.choices(vocabulary[:30], k=50)) for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, score int, RANK int").repartition(6)
    got = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string")).collect()

    s, t = [0] * 10_000, [0] * 10_000
    for _, text in rows:
        for b in features_of(text):
            s[b] += 1
    for text in target:
        for b in features_of(text):
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10_000) / ((x + 1) * (sum(t) + 10_000)))) for x, y in zip(s, t)]
    want = []
    for i, text in rows:
        f = features_of(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = None if i is None else int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        want.append((i, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))))
    able = sorted((w for w in want if w[4] >= 20 and w[3] is not None), key=lambda w: (-w[3], w[0]))
    drawn = able[: 25 * len(able) // 100]
    assert sorted(map(repr, ((x.doc_id, x.n_features, x.weight, x.score, x.n_words) for x in got))) == sorted(map(repr, want))
    ranks = sorted((x.rank, x.doc_id) for x in got if x["rank"] is not None)
    assert [k for k, _ in ranks] == list(range(1, len(drawn) + 1)) and [i for _, i in ranks] == [w[0] for w in drawn]
    kept = resample.keep_drawn(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {w[0] for w in drawn}


def test_resampling_without_rows(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resample.resample(none, none).collect() == []
    assert [(r.n_features, r.weight, r["rank"]) for r in resample.resample(one, none).collect()] == [(3, -693, None)]
