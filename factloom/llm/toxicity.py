"""Toxicity: a linear-chain conditional random field tags toxic spans.

Fitting. Labels are given for documents only, so tokens are labelled from them:
a word, or one of its prefixes, that stands in clearly more toxic than clean
documents marks its tokens in toxic documents as toxic (TOXIC), all others are
clean (CLEAN). A two-state chain with word and prefix features is fitted to
windows around marked and look-alike tokens by gradient ascent on its
conditional likelihood. A third of the sample is kept apart to fit a logistic
curve from a document's marginals to its score.

Scoring. Forward-backward over the whole document gives each token's marginal.
Tokens without features emit alike, so a run of them is one power of a 2x2
matrix, taken in closed form; the marginals are those of the full chain. The
score rises with the expected number of toxic tokens and with the largest
marginal; tokens at MARK or more are merged into spans of character offsets.

The fit uses at most FIT_ROWS labelled rows and FIT_CHARS characters, those
smallest by a hash of their doc_id; rows whose crc32(doc_id) mod 3 is 1 are never
used. Scoring covers every row and whole texts.

Defined results: null text is empty; empty texts get the score of a text without
any toxic token; without labels, or with one class only, every score is the
share of toxic labels (0 without labels). Repeated rows score alike; of several
texts with one labelled doc_id the fit reads the smallest.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, workers_import_us

#: Most labelled rows, and most characters of their texts, that the fit reads.
FIT_ROWS = 6000
FIT_CHARS = 64_000_000
HOLD_OUT = 1
THRESHOLD = 0.7
MARK = 0.5
PREFIXES = (4, 5, 6, 7)
#: Least documents, and share of them toxic, for a feature to mark tokens.
LEAST_DOCS = 3
LEAST_SHARE = 0.75
MAX_FEATURES = 20_000
WINDOW = 5

_WORDS = re.compile(r"[^\W\d_]+")
_CACHE_WORDS = 100_000
#: Windows whose gradient is worked out at once.
_PART = 4096


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == HOLD_OUT


def words_of(text: str) -> list[str]:
    low = text.lower()
    return _WORDS.findall(low) if len(low) == len(text) else [w.lower() for w in _WORDS.findall(text)]


def features_of(word: str) -> list[str]:
    """A word's own feature and those of its proper prefixes."""
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) > n)]


@dataclass
class Model:
    """weights: by feature, (emission of TOXIC against CLEAN); chain: log transitions [from, to]; bias: emission without features."""

    weights: dict[str, float] = field(default_factory=dict)
    chain: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])
    start: float = 0.0
    bias: float = -6.0
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    constant: float | None = None

    def emission(self, word: str) -> float | None:
        get = self.weights.get
        known = [w for w in (get("=" + word), *(get(word[:n]) for n in PREFIXES if len(word) > n)) if w is not None]
        return self.bias + sum(known) if known else None


class Tagger:
    """Applies a model; remembers the words it has seen."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        m = np.exp(np.array(model.chain))
        m = m * np.array([1.0, np.exp(model.bias)])[None, :]
        values, right = np.linalg.eig(m)
        order = np.argsort(-values.real)
        values, right = values.real[order], right.real[:, order]
        left = np.linalg.inv(right)
        self.ratio = float(values[1] / values[0])
        self.first, self.second = (np.outer(right[:, k], left[k]).tolist() for k in (0, 1))
        self.step = np.exp(np.array(model.chain)).tolist()

    def run(self, n: int) -> tuple[float, float, float, float]:
        """The product over n featureless tokens, divided by its growth."""
        r = self.ratio**n
        (a, b), (c, d) = self.first
        (e, f), (g, h) = self.second
        return a + r * e, b + r * f, c + r * g, d + r * h

    def marginals(self, words: list[str]) -> list[tuple[int, float]]:
        """(position, probability of TOXIC) of each token that has a feature."""
        known, model = self.known, self.model
        if len(known) > _CACHE_WORDS:
            known.clear()
        for word in set(words).difference(known):
            known[word] = model.emission(word)
        hits = [(at, e) for at, e in enumerate(map(known.__getitem__, words)) if e is not None]
        if not hits:
            return []
        (t00, t01), (t10, t11) = self.step
        forward, x, y, last = [], 1.0, float(np.exp(model.start)), -1
        for at, e in hits:
            gap = at - last - 1
            if last < 0 and gap:  # the first token has no transition into it
                y *= float(np.exp(model.bias))
                gap -= 1
            if gap > 0:
                a, b, c, d = self.run(gap)
                x, y = x * a + y * c, x * b + y * d
            if at:
                x, y = x * t00 + y * t10, x * t01 + y * t11
            y *= np.exp(e)
            s = x + y
            x, y = x / s, y / s
            forward.append((x, y))
            last = at
        a, b, c, d = self.run(len(words) - 1 - last)
        u, v = a + b, c + d
        out = []
        for k in range(len(hits) - 1, -1, -1):
            x, y = forward[k]
            s = x * u + y * v
            out.append((hits[k][0], y * v / s))
            if k:
                v *= np.exp(hits[k][1])
                u, v = t00 * u + t01 * v, t10 * u + t11 * v
                gap = hits[k][0] - hits[k - 1][0] - 1
                if gap:
                    a, b, c, d = self.run(gap)
                    u, v = a * u + b * v, c * u + d * v
                s = u + v
                u, v = u / s, v / s
        return out[::-1]

    def score(self, found: list[tuple[int, float]]) -> float:
        if self.model.constant is not None:
            return self.model.constant
        a, b, c = self.model.curve
        z = a + b * np.log1p(sum(p for _, p in found)) + c * max((p for _, p in found), default=0.0)
        return float(1 / (1 + np.exp(-z)))

    def spans(self, text: str, found: list[tuple[int, float]]) -> list[dict]:
        """Character offsets of neighbouring marked words, merged."""
        marked = {at for at, p in found if p >= MARK}
        out: list[dict] = []
        if not marked:
            return out
        last = max(marked)
        before = -2
        for at, m in enumerate(_WORDS.finditer(text)):
            if at in marked:
                if at == before + 1:
                    out[-1]["end"] = m.end()
                else:
                    out.append({"start": m.start(), "end": m.end()})
                before = at
            if at >= last:
                break
        return out


def fit(rows: list[tuple[str, int]]) -> Model:
    """A model from (text, toxic) rows, in any order but the same for the same order."""
    labels = [y for _, y in rows]
    if not rows or len(set(labels)) < 2:
        return Model(constant=float(labels[0]) if labels else 0.0)
    apart = [k for k in range(len(rows)) if k % 3 == 2]
    own = [k for k in range(len(rows)) if k % 3 != 2]
    if len({labels[k] for k in own}) < 2 or len({labels[k] for k in apart}) < 2:
        own = apart = list(range(len(rows)))

    # a feature below LEAST_DOCS toxic documents can't be pure enough, so only the others are counted in clean ones
    toxic, clean = Counter(), Counter()
    for k in own:
        if labels[k]:
            toxic.update({f for w in set(words_of(rows[k][0])) for f in features_of(w)})
    toxic = Counter({f: n for f, n in toxic.items() if n >= LEAST_DOCS})
    for k in own:
        if not labels[k]:
            clean.update({f for w in set(words_of(rows[k][0])) for f in features_of(w) if f in toxic})
    n_toxic = sum(labels[k] for k in own)
    base = n_toxic / len(own)
    score = {}
    for f, n in toxic.items():
        m = clean.get(f, 0)
        share = (n + base) / (n + m + 1)
        if n + m >= LEAST_DOCS and share >= max(LEAST_SHARE, base + 0.2):
            score[f] = (share - base) * np.sqrt(n + m)
    strong = set(sorted(score, key=lambda f: (-score[f], f))[: MAX_FEATURES // 2])
    # look-alikes: features that strong words share with clean ones, so that the chain can weigh them
    watched = dict.fromkeys(strong, 0.0)
    for f in strong:
        for g in [f, *(features_of(f[1:]) if f[0] == "=" else [])]:
            watched[g] = max(watched.get(g, 0.0), score[f])
    index = {f: k for k, f in enumerate(sorted(sorted(watched, key=lambda f: (-watched[f], f))[:MAX_FEATURES]))}
    if not index:
        return Model(constant=base)

    windows = Counter()  # equal windows are fitted once, by their number
    for k in own:
        words = words_of(rows[k][0])
        own_words = {}
        for w in set(words):
            fs = features_of(w)
            if at := tuple(index[f] for f in fs if f in index):
                own_words[w] = at, int(any(f in strong for f in fs))
        tokens = [own_words.get(w, ((), 0)) for w in words]
        hits = [i for i, (f, _) in enumerate(tokens) if f]
        at = 0
        for i in hits or [0] * bool(words):
            if i < at:
                continue
            lo, at = max(0, i - WINDOW), i + WINDOW + 1
            part = tokens[lo:at]
            windows[tuple(f for f, _ in part), tuple(m * labels[k] for _, m in part)] += 1
    weights, chain, start, bias = _ascend(windows, len(index))
    model = Model({f: float(weights[k]) for f, k in index.items() if abs(weights[k]) > 1e-3}, chain.tolist(), float(start), float(bias))

    tagger = Tagger(model)
    x = []
    for k in apart:
        found = tagger.marginals(words_of(rows[k][0]))
        x.append((1.0, np.log1p(sum(p for _, p in found)), max((p for _, p in found), default=0.0)))
    model.curve = _logistic(np.array(x), np.array([labels[k] for k in apart], dtype=float))
    return model


def _ascend(windows: Counter, n: int, rounds: int = 60, rate: float = 0.15, decay: float = 1e-3):
    """Fits emissions, transitions, start and bias of the two-state chain by Adam on the mean conditional log-likelihood."""
    size, length = len(windows), 2 * WINDOW + 1
    times = np.array(list(windows.values()), dtype=float)
    total = times.sum()
    valid = np.zeros((size, length), dtype=bool)
    gold = np.zeros((size, length), dtype=int)
    rows, cols, feats = [], [], []
    for r, (seq, mark) in enumerate(windows):
        valid[r, : len(seq)] = True
        gold[r, : len(seq)] = mark
        for c, fs in enumerate(seq):
            for f in fs:
                rows.append(r)
                cols.append(c)
                feats.append(f)
    rows, cols, feats = (np.array(v, dtype=int) for v in (rows, cols, feats))
    params = np.zeros(n + 6)  # weights, chain, start, bias
    params[-1] = -3.0
    pair = np.zeros(4)
    both = valid[:, 1:]
    for a in (0, 1):
        for b in (0, 1):
            pair[2 * a + b] = (((gold[:, :-1] == a) & (gold[:, 1:] == b) & both).sum(axis=1) * times).sum()
    cuts = [*range(0, size, _PART), size]
    parts = [(lo, hi, slice(*np.searchsorted(rows, (lo, hi)))) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    first, second = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, rounds + 1):
        grad = np.zeros_like(params)
        grad[n : n + 4] = pair
        for lo, hi, own in parts:
            _add_gradient(grad, params, n, valid[lo:hi], gold[lo:hi], times[lo:hi], rows[own] - lo, cols[own], feats[own])
        grad = grad / total - decay * params / max(1.0, np.sqrt(total) / 10)
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        params = params + rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return params[:n], params[n : n + 4].reshape(2, 2), params[-2], params[-1]


def _add_gradient(grad: np.ndarray, params: np.ndarray, n: int, valid: np.ndarray, gold: np.ndarray, times: np.ndarray, rows: np.ndarray, cols: np.ndarray, feats: np.ndarray) -> None:
    """Adds the gradient of some windows: what is labelled less what forward-backward expects."""
    size, length = valid.shape
    e = params[-1] + np.bincount(rows * length + cols, weights=params[feats], minlength=size * length).reshape(size, length)
    pot = np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], axis=2)
    chain = np.exp(params[n : n + 4].reshape(2, 2))
    fwd = np.zeros((size, length, 2))
    fwd[:, 0] = pot[:, 0] * np.array([1.0, np.exp(params[-2])])
    fwd[:, 0] /= fwd[:, 0].sum(axis=1, keepdims=True)
    for c in range(1, length):
        nxt = (fwd[:, c - 1] @ chain) * pot[:, c]
        nxt /= nxt.sum(axis=1, keepdims=True)
        fwd[:, c] = np.where(valid[:, c : c + 1], nxt, fwd[:, c - 1])
    bwd = np.ones((size, length, 2))
    for c in range(length - 2, -1, -1):
        inner = pot[:, c + 1] * bwd[:, c + 1]
        nxt = inner @ chain.T
        joint = fwd[:, c, :, None] * chain[None] * inner[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        grad[n : n + 4] -= (valid[:, c + 1] * times) @ joint.reshape(size, 4)
        nxt /= nxt.sum(axis=1, keepdims=True)
        bwd[:, c] = np.where(valid[:, c + 1 : c + 2], nxt, bwd[:, c])
    post = fwd * bwd
    miss = np.where(valid, gold - post[:, :, 1] / post.sum(axis=2), 0.0) * times[:, None]
    grad[:n] += np.bincount(feats, weights=miss[rows, cols], minlength=n)
    grad[-2] += miss[:, 0].sum()
    grad[-1] += miss.sum()


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Newton's method with a small ridge; the slopes are kept from turning negative."""
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        step = np.linalg.solve(hess, grad)
        w = w + step
        w[1:] = np.maximum(w[1:], 0.0)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> Model:
    """Fits on at most fit_rows labelled rows of fit_chars characters outside the held-out remainder. What comes to the driver has these bounds."""
    chosen = (
        labels.select(F.col(id_col).alias("own_id"), F.col(label_col).alias("y"))
        .where(F.col("own_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("own_id")))
        .distinct().withColumn("draw", F.xxhash64("own_id")).orderBy("draw", "own_id", "y").limit(fit_rows)
    )
    found = docs.select(F.col(id_col).alias("of"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("of") == F.col("own_id"))
    found = found.groupBy("draw", "own_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    run = F.sum(F.length("text")).over(W.orderBy("draw", "own_id", "y"))  # over fit_rows rows at most
    rows = found.withColumn("run", run).where(F.col("run") <= fit_chars).select("draw", "own_id", "y", "text").collect()
    rows.sort(key=lambda r: (r["draw"], r["own_id"], r["y"]))
    return fit([(r["text"], int(r["y"])) for r in rows])


def scored(text: Column, model: Model) -> Column:
    """A column struct(score, spans) for a text column."""

    @F.arrow_udf("struct<score:double,spans:array<struct<start:int,end:int>>>")
    def run(texts: pa.Array) -> pa.Array:
        tagger = Tagger(model)
        scores, spans = [], []
        for at in range(0, len(texts), 256):  # so few texts are Python strings at a time
            for t in texts.slice(at, 256).to_pylist():
                t = t or ""
                found = tagger.marginals(words_of(t))
                scores.append(tagger.score(found))
                spans.append(tagger.spans(t, found))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["score", "spans"])

    return run(F.coalesce(text, F.lit("")))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (id, held_out, score, predicted, spans), one for each row of docs."""
    workers_import_us(docs.sparkSession)
    out = docs.select(F.col(id_col), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), scored(F.col(text_col), model).alias("found"))
    return out.select(id_col, "held_out", F.col("found.score").alias("score"), (F.col("found.score") >= threshold).cast("int").alias("predicted"), F.col("found.spans").alias("spans"))


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs below the threshold, with all their columns."""
    workers_import_us(docs.sparkSession)
    return docs.where(scored(F.col(text_col), model)["score"] < threshold)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
