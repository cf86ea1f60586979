import re

import numpy as np

from tests.llm import samples
from veriflate.llm import minhash as M
from veriflate.llm.graph import components


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(pairs):
    nodes = {}
    for i, t in pairs:
        if i is not None:
            nodes.setdefault(i, []).append(sets(t))
    root = {i: i for i in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(nodes)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in nodes[a] for y in nodes[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def edited(seed, count, base, lo, hi):
    rng = samples.random.Random(seed)
    out = []
    for _ in range(count):
        w = base.split()
        for _ in range(rng.randrange(lo, hi)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_components(spark):
    rng = samples.random.Random(4)
    base = " ".join(samples.words(rng, 150, 5000))
    group = [base] + edited(5, 60, base, 1, 12)  # copies around the threshold, linked through one another
    pairs = samples.odd() + samples.texts(1, 150) + [(1000 + i, t) for i, t in enumerate(group)]
    out = M.near_duplicates(samples.frame(spark, pairs)).collect()
    want = brute(pairs)
    assert len(out) == len(pairs)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id), r
    sizes = {(i, len(sets(t))) for i, t in pairs}
    assert {(r.doc_id, r.n_shingles) for r in out} == sizes
    assert len({want[1000 + i] for i in range(61)}) > 1  # some are too far


def test_empty(spark):
    assert M.near_duplicates(samples.frame(spark, [])).count() == 0


def test_signature_estimates_similarity():
    rng = samples.random.Random(2)
    near = []
    for _ in range(60):
        w = samples.words(rng, 400, 10**6)
        v = list(w)
        for i in rng.sample(range(400), 11):
            v[i] = "z"
        a, b = M.shingle_sets([" ".join(x).encode() for x in (w, v)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        near.append((M.signature(a) == M.signature(b)).mean() - true)
    assert abs(np.mean(near)) < 0.02
    one = M.signature(M.shingle_sets([b"only one"])[0])
    assert len(set(one.tolist())) == 1 and len(one) == M.BINS


def test_bitmaps_bound_the_intersection():
    rng = samples.random.Random(3)
    for _ in range(40):
        w = samples.words(rng, rng.randrange(6, 300))
        v = w[: rng.randrange(5, len(w))] + samples.words(rng, 20)
        a, b = M.shingle_sets([" ".join(x).encode() for x in (w, v)])
        p, q = M.bitmap(a), M.bitmap(b)
        while len(p) != len(q):
            if len(p) < len(q):
                q = q[: len(q) // 2] ^ q[len(q) // 2 :]
            else:
                p = p[: len(p) // 2] ^ p[len(p) // 2 :]
        apart = sum(int(x).bit_count() for x in (p ^ q).view(np.uint64))
        assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - apart) / 2


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (200, 200), (None, 5), (300, 7)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 300: 0}


def test_an_id_with_several_texts_is_one_node(spark):
    rng = samples.random.Random(21)
    a, b, c = (" ".join(samples.words(rng, 40)) for _ in range(3))
    near = b.rsplit(" ", 1)[0]
    pairs = [(3, a), (5, a), (5, b), (9, b), (11, near), (20, c), (20, c), (21, c), (20, near + " more words of its own " + a)]
    out = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in M.near_duplicates(samples.frame(spark, pairs)).collect()}
    assert {v for (i, _), v in out.items() if i in (5, 9, 11)} == {(3, False)}
    assert out[3, 36] == (3, True)
    assert {v for (i, _), v in out.items() if i in (20, 21)} == {(20, True), (20, False)}


def test_buckets_are_played_in_parts(spark, monkeypatch):
    rng = samples.random.Random(22)
    text = samples.words(rng, 60)
    pairs = []
    for i in range(60):
        w = list(text)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(60)] = f"x{rng.randrange(999)}"
        pairs.append((i, " ".join(w)))
    whole = sorted(map(tuple, M.near_duplicates(samples.frame(spark, pairs)).collect()))
    monkeypatch.setattr(M, "SIDE", 7)
    assert sorted(map(tuple, M.near_duplicates(samples.frame(spark, pairs)).collect())) == whole


def test_links_are_confirmed_by_one_sorting_join(spark, monkeypatch):
    rng = samples.random.Random(23)
    base = " ".join(samples.words(rng, 200, 5000))
    pairs = list(enumerate([base, *edited(24, 40, base, 1, 12)])) + samples.texts(25, 40, 100)
    want, stored, keep = brute(pairs), [], M.store

    def seen(df, name):
        stored.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, name)

    def joins():
        """Keys of the joins that sort, the last one first, of each table of links."""
        stored.clear()
        out = M.near_duplicates(samples.frame(spark, pairs)).collect()
        assert {r.doc_id: r.component_id for r in out} == want
        return [re.findall(r"SortMergeJoin \[(\w+)#", plan) for name, plan in stored if name == "links"]

    monkeypatch.setattr(M, "store", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert joins() == [["b"], ["b"]]  # few edges are broadcast
        monkeypatch.setattr(M, "small", lambda df: df)
        assert [keys[:2] for keys in joins()] == [["b", "a"], ["b", "a"]]  # more are joined, a first
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
