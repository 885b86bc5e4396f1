import hashlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from factloom.llm import bpe, common, mixture, toxicity
from factloom.llm.common import table

from .test_learned import full_marginals, sampled

SF = "/root/testdata/sf0.001"


def fingerprint(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def toxic(model, text):
    if model.constant is not None:
        return model.constant >= toxicity.THRESHOLD
    words = toxicity.words_of(text)
    p = [x for x, w in zip(full_marginals(model, words), words, strict=True) if any(f in model.weights for f in toxicity.features_of(w))]
    z = model.curve[0] + model.curve[1] * np.log1p(sum(p)) + model.curve[2] * max(p, default=0.0)
    return 1 / (1 + np.exp(-z)) >= toxicity.THRESHOLD


def test_run_like_brute_force(spark):
    """Every decision worked out plainly: full chains for scores, texts compared as they are, all pairs of fingerprints, sorted draws, the library's ids."""
    docs = table(spark, SF, "documents")
    model = toxicity.train(docs, table(spark, SF, "labels"))
    left = {r["doc_id"]: r for r in docs.collect() if not toxic(model, r["text"] or "")}
    last = {}
    for i, r in left.items():
        last[r["text"] or ""] = max(i, last.get(r["text"] or "", -1))
    left = {i: left[i] for i in sorted(last.values())}
    prints = {i: fingerprint(r["text"] or "") for i, r in left.items()}
    root = {i: i for i in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(left)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    left = {i: left[i] for i in ids if find(i) == i}
    slim = mixture._slim(spark.createDataFrame([tuple(r) for r in left.values()], docs.schema), "doc_id", "text", "source", mixture.SEED).collect()
    own = bpe.encoder(*bpe.default_ranks())
    coded = {i: own.encode_ordinary(r["text"] or "") for i, r in left.items()}
    want = sorted((r["id"], len(coded[r["id"]]), hashlib.sha256(np.array(coded[r["id"]], "<u4").tobytes()).hexdigest()) for r, n in zip(slim, sampled(slim), strict=True) for _ in range(n))
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in out) == want
    assert all(own.decode_bytes(list(r["ids"])).decode() == (left[r["doc_id"]]["text"] or "") for r in out)


def test_stages_keep_columns(spark):
    docs = table(spark, SF, "documents").selectExpr("*", "1 AS keep_id", "'x' AS fingerprint")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).isEmpty()


def test_shared_folder_is_required_off_one_machine():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://somewhere:7077", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
