import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from factloom.llm import exact_dedup, mixture, simhash
from factloom.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, x, "en", s, 0, "clash") for i, x, s in rows], DOCS)


CASES = [(1, "a b", "s"), (5, "a b", "s"), (3, "c", "t"), (7, None, None), (8, "", None), (9, "c ", "t"), (None, "a b", "s"), (5, "a b", "s"), (11, "word " * 50_000, "t")]


def test_exact_dedup(spark):
    out = exact_dedup.deduplicate(docs(spark, CASES), exact_dedup.DigestIndex(spark)).collect()
    assert len(out) == len(CASES)
    by = defaultdict(list)
    for r in out:
        by[r["text_sha256"]].append(r)
    same = by[hashlib.sha256(b"a b").hexdigest()]
    assert {r["keep_id"] for r in same} == {5} and {r["group_size"] for r in same} == {4} and sum(r["kept"] for r in same) == 1
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert {(r["doc_id"], r["kept"]) for r in empty} == {(7, False), (8, True)}
    kept = exact_dedup.keep_first_copies(docs(spark, CASES))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 8, 9, 11] and kept.columns == docs(spark, []).columns


def test_exact_dedup_against_an_index(spark):
    index = exact_dedup.DigestIndex(spark)
    exact_dedup.deduplicate(docs(spark, CASES[:3]), index).count()
    again = {r["doc_id"]: r for r in exact_dedup.deduplicate(docs(spark, [(20, "c", "s"), (21, "new", "s")]), index).collect()}
    assert (again[20]["keep_id"], again[20]["kept"]) == (3, False) and again[21]["kept"]
    assert index.table().where("first").count() == 3
    more = {r["doc_id"]: r for r in exact_dedup.deduplicate(docs(spark, [(30, "a b", "s"), (31, "a b", "s")]), index).collect()}
    assert {(r["keep_id"], r["kept"], r["group_size"]) for r in more.values()} == {(5, False, 4)}
    groups = spark.createDataFrame([(bytearray(32),)], "digest binary")
    plan = exact_dedup.unseen(groups, index)._jdf.queryExecution().executedPlan().toString()
    index_side = plan[plan.index("SortMergeJoin") :].split("+- ")[-1]
    assert "LeftAnti" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in index_side
    index.drop()
    assert not index.exists()
    assert exact_dedup.deduplicate(docs(spark, []), exact_dedup.DigestIndex(spark)).isEmpty()


def test_exact_dedup_in_two_batches(spark):
    """Any split by doc_id gives what one pass gives, null and repeated doc_ids included."""
    rows = [(None if k % 11 == 0 else k % 40, f"text {k % 7}", "s") for k in range(120)]
    before = {t.name for t in spark.catalog.listTables()}
    out = exact_dedup.deduplicate_whole(docs(spark, rows)).collect()
    size, best = defaultdict(int), {}
    for i, x, _ in rows:
        size[x] += 1
        best[x] = max(best.get(x, -1), -1 if i is None else i)
    sha = {hashlib.sha256(x.encode()).hexdigest(): x for x in size}
    assert len(out) == 120 and all((r["keep_id"], r["group_size"]) == (best[sha[r["text_sha256"]]], size[sha[r["text_sha256"]]]) for r in out)
    assert sorted(r["text_sha256"] for r in out if r["kept"]) == sorted(sha)
    assert exact_dedup.deduplicate_whole(docs(spark, [])).isEmpty()
    assert {t.name for t in spark.catalog.listTables()} == before


def in_a_session_of_its_own(path, name, rows):
    """(doc_id, keep_id, kept, group_size) of a batch that another process adds to the index."""
    import json
    import subprocess
    import sys
    import tempfile

    code = f"""
import json
from pyspark.sql import SparkSession
from factloom.llm import exact_dedup
scratch = {tempfile.mkdtemp(prefix="spark-")!r}
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").config("spark.checkpoint.dir", "file://" + scratch).config("spark.sql.warehouse.dir", scratch + "/w").getOrCreate()
docs = spark.createDataFrame({rows!r}, "doc_id long, text string")
found = exact_dedup.deduplicate(docs, exact_dedup.DigestIndex(spark, {name!r}, {path!r})).collect()
print("FOUND" + json.dumps(sorted([r["doc_id"], r["keep_id"], r["kept"], r["group_size"]] for r in found)))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    return json.loads(done.stdout.split("FOUND")[1]) if "FOUND" in done.stdout else pytest.fail(done.stderr[-2000:])


def test_the_index_outlives_its_session(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    assert in_a_session_of_its_own(path, "seen", [(1, "a"), (2, "b"), (3, "a")]) == [[1, 3, False, 2], [2, 2, True, 1], [3, 3, True, 2]]
    assert in_a_session_of_its_own(path, "seen", [(6, "a"), (7, "b"), (8, "a"), (9, "a")]) == [[6, 3, False, 5], [7, 2, False, 2], [8, 3, False, 5], [9, 3, False, 5]]
    index = exact_dedup.DigestIndex(spark, "seen_here", path)
    assert (len(index.batches()), index.buckets, index.table().count()) == (2, 3, 4)
    more = exact_dedup.deduplicate(docs(spark, [(20, "a", "s"), (21, "c", "s")]), index).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["kept"], r["group_size"]) for r in more) == [(20, 3, False, 6), (21, 21, True, 1)]


def test_failed_appends_leave_the_index_as_it_was(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, path=path)
    exact_dedup.deduplicate(docs(spark, [(1, "a", "s")]), index, batch="one").count()

    def stop(self, *_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:  # after the files are written, before they are in place
        m.setattr(exact_dedup.DigestIndex, "_at", stop)
        with pytest.raises(RuntimeError):
            index.append(spark.createDataFrame([(bytearray(b"x"), 1, 1, 1, True)], "digest binary, keep_id long, keep_row long, n long, first boolean"), "two")
    (tmp_path / "index" / "_staged-two-left").mkdir()
    again = exact_dedup.DigestIndex(spark, path=path)
    assert again.batches() == ["one"] and again.table().count() == 1
    with monkeypatch.context() as m:  # in place, but the catalog's table isn't told
        m.setattr(exact_dedup.DigestIndex, "_view", stop)
        with pytest.raises(RuntimeError):
            exact_dedup.deduplicate(docs(spark, [(2, "a", "s"), (3, "b", "s")]), index, batch="two")
    again = exact_dedup.DigestIndex(spark, path=path)
    assert again.batches() == ["one", "two"] and again.table().count() == 3
    for _ in range(2):  # tried again, it is found to be there
        found = exact_dedup.deduplicate(docs(spark, [(2, "a", "s"), (3, "b", "s")]), again, batch="two").collect()
        assert sorted((r["doc_id"], r["keep_id"], r["kept"], r["group_size"]) for r in found) == [(2, 1, False, 2), (3, 3, True, 1)]


def test_other_folders_are_refused(spark, tmp_path):
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "file").write_text("x")
    with pytest.raises(ValueError, match="no digest index"):
        exact_dedup.DigestIndex(spark, path=f"file://{tmp_path}/other")
    exact_dedup.DigestIndex(spark, "taken", f"file://{tmp_path}/a")
    with pytest.raises(ValueError, match="taken"):
        exact_dedup.DigestIndex(spark, "taken", f"file://{tmp_path}/b")


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_on_whole_table(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    ids, prints = [r["doc_id"] for r in rows], [brute_print(r["text"]) for r in rows]
    got = {r["doc_id"]: r for r in simhash.op10(spark, SF).collect()}
    assert {i: int(got[i]["fingerprint"], 16) for i in ids} == dict(zip(ids, prints, strict=True))
    assert {i: got[i]["component_id"] for i in ids} == brute_components(ids, prints)


def test_simhash_edges(spark):
    rows = [(1, None, "s"), (2, " \n", "s"), (3, "One", "s"), (4, "one", "s"), (4, "one", "s"), (None, "one", "s"), (6, "ÄB c d e f", "s")]
    got = sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs(spark, rows)).collect())
    assert [x[2] for x in got] == [3, 1, 1, 3, 3, 3, 6] and got[1][1] == "0" * 16
    assert simhash.near_duplicates(docs(spark, [])).isEmpty()
    assert sorted(r["doc_id"] or -1 for r in simhash.keep_one_of_each(docs(spark, rows)).collect()) == [-1, 1, 3, 6]


def test_near_dedup_with_repeated_and_missing_ids(spark):
    rows = [(1, "one", "s"), (5, "One", "s"), (5, "a text of its own", "s"), (7, "again and again", "s"), (7, "Again and again", "s"), (None, "ONE", "s"), (None, "no id here", "s"), (None, "No id here", "s"), (9, "last of all", "s")]
    kept = simhash.keep_one_of_each(docs(spark, rows), spare_null=False)
    assert sorted((r["doc_id"] or -1, r["text"].lower()) for r in kept.collect()) == [(-1, "no id here"), (1, "one"), (5, "a text of its own"), (7, "again and again"), (9, "last of all")]
    assert kept.columns == docs(spark, []).columns
    assert simhash.keep_one_of_each(docs(spark, rows)).where("doc_id IS NULL").count() == 3
    staged = corpus_pipeline.drop_near_copies(spark, docs(spark, rows), SF)
    assert staged.count() == 5


def test_dense_postings_are_dealt_out(spark):
    """Many fingerprints near one another: small blocks must give the components of all pairs."""
    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 62))
    values = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, size=rng.integers(0, 5), replace=False)) for _ in range(400)} | {int(v) for v in rng.integers(1 << 62, size=200)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    parts = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, block=40)).collect()}
    want = brute_components(list(range(len(values))), values)
    groups = defaultdict(set)
    for i, r in want.items():
        groups[r].add(signed[i])
    got = defaultdict(set)
    for v in signed:
        got[parts.get(v, v)].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 9)), min_size=1, max_size=8))
def test_water_filling(rows):
    sizes, weights = {k: n for k, (n, _) in enumerate(rows)}, {k: w for k, (_, w) in enumerate(rows)}
    budget = 1.5 * sum(sizes.values())
    got = mixture.water_fill(sizes, weights, budget, 2.0)
    assert all(0 <= got[k] <= 2 * sizes[k] + 1e-9 for k in sizes) and abs(sum(got.values()) - budget) < 1e-6
    free = [got[k] / weights[k] for k in sizes if 0 < got[k] < 2 * sizes[k] - 1e-9]
    assert not free or max(free) - min(free) < 1e-6


def test_mixture(spark):
    rows = {r["doc_id"]: r for r in mixture.op6(spark, SF).collect()}
    again = {r["doc_id"]: r for r in mixture.op6(spark, SF).collect()}
    assert rows == again
    source = {r["doc_id"]: r["source"] for r in table(spark, SF, "documents").select("doc_id", "source").collect()}
    taken, target, biggest = defaultdict(int), {}, defaultdict(int)
    for i, r in rows.items():
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] % max(r["size"], 1) == 0
        taken[source[i]] += r["taken"]
        target[source[i]] = r["target"]
        biggest[source[i]] = max(biggest[source[i]], r["size"])
    for s in target:
        assert abs(taken[s] - target[s]) <= biggest[s]
    repeated = mixture.repeat_to_mix(table(spark, SF, "documents"))
    assert repeated.count() == sum(r["times"] for r in rows.values())


def test_mixture_takes_the_nearer_cut_of_large_documents(spark):
    """Equal weights and a budget of 1.75 or 1.25 give each source that many times its size."""
    rows = [(1, "one " * 40, "a"), *((10 + k, "two " * 20, "b") for k in range(2)), *((20 + k, f"w{k} " * 10, "c") for k in range(4)), (30, "big " * 36, "d"), *((31 + k, f"s{k} x", "d") for k in range(2))]
    for budget, a in ((1.75, 80), (1.25, 40)):
        taken, target = defaultdict(int), {}
        for r in mixture.mix(docs(spark, rows), weights=(1.0,), budget=budget).collect():
            s = next(s for i, _, s in rows if i == r["doc_id"])
            assert r["times"] <= 2
            taken[s] += r["taken"]
            target[s] = r["target"]
        assert target == {s: budget * 40 for s in "abcd"} and taken["a"] == a and abs(taken["b"] - target["b"]) <= 10 and taken["c"] - target["c"] in (-10, 0, 10) and abs(taken["d"] - target["d"]) <= 10
    few = [(1, "one " * 41, "a"), (2, "a b", "a")]
    assert {r["doc_id"]: r["times"] for r in mixture.mix(docs(spark, few), budget=1.95).collect()}[1] == 2


def test_mixture_edges(spark):
    assert mixture.mix(docs(spark, [])).isEmpty()
    out = mixture.mix(docs(spark, CASES)).collect()
    assert len(out) == len(CASES) and {r["target"] for r in out if r["source_size"] == 0} <= {0.0}
    assert mixture.repeat_to_mix(docs(spark, CASES)).columns == docs(spark, []).columns
