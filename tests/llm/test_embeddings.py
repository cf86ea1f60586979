import numpy as np

from veriflate.llm import embeddings as M


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "k") for i, v in rows], "vec_id long, embedding array<float>, label int, count int, key string")


def brute(rows):
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if v is not None and None not in v and len(v) and np.isfinite(np.array(v, float)).all() and any(v)}
    ids = sorted(good)
    root, links = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and len(good[a]) == len(good[b]):
                x, y = good[a], good[b]
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= M.COSINE:
                    links[a] += 1
                    links[b] += 1
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i, _ in rows}


def sample(seed, n, dim=24):
    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        if out and rng.random() < 0.6:
            v = out[rng.integers(max(0, len(out) - 40), len(out))][1] + rng.normal(0, rng.choice([0.0, 0.1, 0.25, 0.33]), dim)
        else:
            v = rng.normal(0, 1, dim)
        out.append((100 + i, v))
    return [(i, v.astype(np.float32).tolist()) for i, v in out]


def check(spark, rows):
    out = M.near_vectors(frame(spark, rows)).collect()
    want = brute(rows)
    assert len(out) == len(rows)
    wrong = [r for r in out if (r.n_links, r.component_id) != want[r.vec_id] or r.kept != (r.vec_id == r.component_id)]
    assert wrong == []
    return out


def test_against_brute_force(spark):
    odd = [(1, None), (2, []), (3, [0.0] * 24), (4, [1.0, None] + [0.0] * 22), (5, [float("nan")] + [1.0] * 23), (6, [float("inf")] + [1.0] * 23), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1e-30] * 24), (10, [1e30] * 24)]
    out = check(spark, odd + sample(1, 500))
    assert sum(r.n_links for r in out) > 300


def test_large_cells_are_cut(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 40)
    rng = np.random.default_rng(5)
    c = rng.normal(0, 1, 24)
    rows = sample(2, 150) + [(1000 + i, (c + rng.normal(0, 0.17, 24)).astype(np.float32).tolist()) for i in range(200)]
    check(spark, rows)


def at_the_threshold(rng, n, dim):
    a = rng.normal(0, 1, (n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(0, 1, a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return a, (M.COSINE + 1e-6) * a + np.sqrt(1 - (M.COSINE + 1e-6) ** 2) * side


def test_recall_of_the_calibrated_count():
    bits, count = M.calibrate(200_000)
    lines = M.Lines(64, bits, count)
    a, b = at_the_threshold(np.random.default_rng(1), 4000, 64)
    near = np.abs(lines.places(a).astype(int) - lines.places(b)) <= M.NEAR
    met = (lines.cells(a) == lines.cells(b)) & near
    assert (met.sum(1) >= M.NEED).mean() > 0.999


def test_recall_holds_at_every_size():
    for n in (0, 1, 10**3, 10**6, 10**9, 10**12, 10**15):
        bits, lines = M.calibrate(n)
        p = M.INSIDE * (1 - np.arccos(M.COSINE) / np.pi) ** bits
        miss = sum(M.math.comb(lines, i) * p**i * (1 - p) ** (lines - i) for i in range(M.NEED))
        assert miss <= M.MISS and lines <= M.LINES


def test_recall_end_to_end(spark):
    a, b = at_the_threshold(np.random.default_rng(2), 1500, 32)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    x = np.array([v for _, v in rows]).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= M.COSINE).sum() - len(x)
    got = sum(r.n_links for r in M.near_vectors(frame(spark, rows)).collect())
    assert want > 2000 and want * 0.999 <= got <= want


def test_null_ids_repeated_rows_and_no_rows(spark):
    out = M.near_vectors(frame(spark, [(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 4.1])])).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in out) == [(0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert M.near_vectors(frame(spark, [])).count() == 0
