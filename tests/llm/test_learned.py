"""op5, op6 and op8 against plain computations: full chains, gradients by differences, sorted draws, covering by hand."""

import itertools
import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import mixture, quality_rules, toxicity
from factloom.llm.common import table

SF = "/root/testdata/sf0.01"


# ---- op5
def full_marginals(model, words):
    """P(TOXIC) of every token, by forward-backward over all tokens with logarithms."""
    if not words:
        return np.zeros(0)
    e = np.zeros((len(words), 2))
    for k, w in enumerate(words):
        known = [model.weights[f] for f in toxicity.features_of(w) if f in model.weights]
        e[k, 1] = model.bias + sum(known)
    c = np.array(model.chain)
    fwd, bwd = np.zeros_like(e), np.zeros_like(e)
    fwd[0] = e[0] + [0, model.start]
    for k in range(1, len(words)):
        fwd[k] = e[k] + np.logaddexp(fwd[k - 1][0] + c[0], fwd[k - 1][1] + c[1])
    for k in range(len(words) - 2, -1, -1):
        x = e[k + 1] + bwd[k + 1]
        bwd[k] = np.logaddexp(c[:, 0] + x[0], c[:, 1] + x[1])
    both = fwd + bwd
    return np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1]))


def test_scores_like_full_chains(spark):
    docs = table(spark, SF, "documents")
    model = toxicity.train(docs, table(spark, SF, "labels"))
    assert model.weights
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in toxicity.score(docs, model).collect():
        words = toxicity.words_of(texts[r["doc_id"]])
        p = full_marginals(model, words)
        seen = [k for k, w in enumerate(words) if any(f in model.weights for f in toxicity.features_of(w))]
        z = model.curve[0] + model.curve[1] * np.log1p(sum(p[k] for k in seen)) + model.curve[2] * max((p[k] for k in seen), default=0.0)
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-6 and r["predicted"] == (r["score"] >= 0.7)
        assert len(r["spans"]) <= sum(p[k] >= 0.5 for k in seen)


def log_likelihood(params, n, windows):
    """By summing over all taggings of each window."""
    w, c, start, bias = params[:n], params[n : n + 4].reshape(2, 2), params[-2], params[-1]
    total = 0.0
    for (seq, mark), times in windows.items():
        def energy(tags):
            e = sum((bias + sum(w[f] for f in fs)) for fs, t in zip(seq, tags, strict=True) if t)
            return e + start * tags[0] + sum(c[a, b] for a, b in itertools.pairwise(tags))

        every = [energy(t) for t in itertools.product((0, 1), repeat=len(seq))]
        total += times * (energy(mark) - np.logaddexp.reduce(every))
    return total


def test_gradient_like_differences():
    rng = np.random.default_rng(3)
    n = 4
    windows = Counter()
    for _ in range(12):
        size = int(rng.integers(1, 6))
        seq = tuple(tuple(int(f) for f in rng.choice(n, size=rng.integers(0, 3), replace=False)) for _ in range(size))
        windows[seq, tuple(int(t) for t in rng.integers(0, 2, size=size))] += int(rng.integers(1, 4))
    params = rng.normal(size=n + 6)
    length = 2 * toxicity.WINDOW + 1
    valid, gold = np.zeros((len(windows), length), bool), np.zeros((len(windows), length), int)
    at = []
    for r, (seq, mark) in enumerate(windows):
        valid[r, : len(seq)], gold[r, : len(seq)] = True, mark
        at += [(r, c, f) for c, fs in enumerate(seq) for f in fs]
    rows, cols, feats = (np.array(v, int) for v in zip(*at, strict=True))
    times = np.array(list(windows.values()), float)
    grad = np.zeros_like(params)
    both = valid[:, 1:]
    for a in (0, 1):
        for b in (0, 1):
            grad[n + 2 * a + b] = (((gold[:, :-1] == a) & (gold[:, 1:] == b) & both).sum(axis=1) * times).sum()
    toxicity._add_gradient(grad, params, n, valid, gold, times, rows, cols, feats)
    for k in range(len(params)):
        step = np.zeros_like(params)
        step[k] = 1e-5
        want = (log_likelihood(params + step, n, windows) - log_likelihood(params - step, n, windows)) / 2e-5
        assert abs(grad[k] - want) < 1e-5, k


def test_fit_reads_bounded_whole_rows(spark):
    rows = [(k, ("you idiot " if k % 2 else "a fine day ") * 30 + str(k)) for k in range(60)] + [(3, "another text of three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    a, b = toxicity.train(docs, labels), toxicity.train(docs.repartition(7), labels.repartition(5))
    assert a == b and any(f.startswith("=idiot") or f == "idio" for f in a.weights)
    assert toxicity.train(docs, labels, fit_chars=0).constant == 0.0

# ---- op6
def filled(sizes, weights, budget, most):
    """Clamping all that are above at once and sharing the excess, until none is above."""
    out, active, left = {s: 0.0 for s in sizes}, [s for s in sizes if sizes[s] > 0 and weights[s] > 0], float(budget)
    while active:
        total = sum(weights[s] for s in active)
        over = [s for s in active if left * weights[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weights[s] / total for s in active}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        active = [s for s in active if s not in over]
    return out


def test_water_filling_like_rounds():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        sizes = {k: int(v) for k, v in enumerate(rng.integers(0, 1000, size=n) * (rng.random(n) < 0.9))}
        weights = {k: (5.0, 2.0, 1.0)[k % 3] for k in sizes}
        a, b = (f(sizes, weights, 1.5 * sum(sizes.values()), 2.0) for f in (mixture.water_fill, filled))
        assert all(math.isclose(a[k], b[k], rel_tol=1e-9, abs_tol=1e-6) for k in sizes)
    many = {k: 1 + k % 977 for k in range(200_000)}
    assert len(mixture.water_fill(many, {k: 1.0 + k % 5 for k in many}, 1.5 * sum(many.values()), 2.0)) == len(many)


def sampled(slim):
    """How often each row (id, source, size, draw) is taken, from the draws alone: large documents up to their share of what whole
    epochs leave, small ones up to the sum nearest to what is then missing."""
    by = defaultdict(list)
    for k, r in enumerate(slim):
        by[r["source"]].append((r["draw"], r["size"], k))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for _, n, _ in by[s]) for s in order}
    target = filled(sizes, {s: mixture.WEIGHTS[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2.0)
    times = {}
    for s, rows in by.items():
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        missing = target[s] - whole * sizes[s]
        large, small = ([r for r in sorted(rows) if (r[1] * mixture.LARGE > sizes[s]) == x] for x in (True, False))
        share, run, once = missing / sizes[s] * sum(n for _, n, _ in large) if sizes[s] else 0, 0, set()
        rest, crossing = sum(n for _, n, _ in small), None
        for _, n, i in large:
            if run + n > share:
                crossing = (n, i)
                break
            run += n
            once.add(i)
        if crossing and max(run + crossing[0] - missing, 0) < max(missing - run - rest, 0):
            run += crossing[0]
            once.add(crossing[1])
        missing -= run
        run = 0
        for _, n, i in small:
            if run + n > missing:
                if missing - run > run + n - missing and run <= missing:
                    once.add(i)
                break
            run += n
            once.add(i)
        times.update({i: whole + (i in once) for _, _, i in rows})
    return [times[k] for k in range(len(slim))]


def test_sample_like_sorted_draws(spark):
    docs = table(spark, SF, "documents")
    slim = mixture._slim(docs, "doc_id", "text", "source", mixture.SEED).collect()
    got = {r["doc_id"]: r["times"] for r in mixture.mix(docs).collect()}
    assert got == {r["id"]: n for r, n in zip(slim, sampled(slim), strict=True)}


# ---- op8
def test_decision_list_like_covering_by_hand(spark):
    """Rows of two statistics: the list must be what grows and prunes from the rows themselves."""
    rng = np.random.default_rng(8)
    docs = []
    for k in range(900):
        n = int(rng.integers(20, 60))
        bad = rng.random() < 0.3
        words = ["x" * int(rng.integers(1, 12)) + str(int(x)) for x in rng.integers(0, 5000, size=n)]
        if bad and k % 3:
            words = [w + "#" for w in words]
        elif bad:
            words = [w + "!" for w in words]
        docs.append((k, " ".join(words), int(not bad)))
    df = spark.createDataFrame(docs, "doc_id long, text string, quality int")
    out = {r["doc_id"]: r for r in quality_rules.judge(df.select("doc_id", "text"), df.select("doc_id", "quality")).collect()}
    assert all(out[i]["kept"] == bool(q) for i, _, q in docs) and {out[i]["rule"] for i, _, q in docs if not q} == {1, 2}
    # each threshold lies between the classes, and each rule holds up on rows that it hasn't seen
    stats = quality_rules.statistics(df.select("doc_id", "text"))
    rules = quality_rules.learn(stats, df.select("doc_id", "quality"))
    assert sorted(r[0].stat for r in rules) == ["exclamations_per_word", "symbols_per_word"] and all(len(r) == 1 and r[0].above and 0 < r[0].bound < 1 for r in rules)


def test_growing_takes_the_best_gain():
    class Rows:
        def where(self, _):
            return self

    names = ["a", "b"]
    counts = {"a": [[10, 1], [0, 9]], "b": [[5, 5], [5, 5]]}
    kept = quality_rules._counts, quality_rules._widest, quality_rules.all_of
    quality_rules._counts, quality_rules._widest, quality_rules.all_of = (lambda *_: counts), (lambda _, c: c), (lambda _: None)
    try:
        rule = quality_rules._grow(Rows(), names, {"a": [1.0], "b": [1.0]})
    finally:
        quality_rules._counts, quality_rules._widest, quality_rules.all_of = kept
    gains = {(s, above): w * (math.log2(w / (h + w)) - math.log2(0.5)) for s in names for above, (h, w) in ((False, counts[s][0]), (True, counts[s][1])) if w >= quality_rules.LEAST_COVER}
    assert (rule[0].stat, rule[0].above) == max(gains, key=gains.get) == ("a", True)
