import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np

from tests.llm import samples
from veriflate.llm import suffix_tree as M


def counted(stream):
    raw = stream.bytes.astype(np.uint64)
    code = np.zeros(len(raw), np.uint64)
    for i in range(M.DEPTH + 1):
        code[M.DEPTH :] |= raw[M.DEPTH - i : len(raw) - i] << np.uint64(8 * i)
    return code[stream.predicted()]


def levels(code, least):
    rows, counts = [], []
    for j in range(M.DEPTH + 1):
        u, c = np.unique(code & np.uint64((1 << 8 * (j + 1)) - 1), return_counts=True)
        n = Counter()
        for x, y in zip(u >> np.uint64(8), c, strict=True):
            n[int(x)] += int(y)
        keep = np.array([n[int(x)] >= least for x in u >> np.uint64(8)])
        rows.append(u[keep].view(np.int64))
        counts.append(c[keep])
    return rows, counts


def test_automaton_finds_the_longest_suffix():
    rng = samples.random.Random(3)
    texts = [" ".join(rng.choice(["abab cab", "cab abc a", "bcab", "a b a b"]).split() * rng.randrange(4)).encode() for _ in range(300)]
    stream = M.Stream(texts)
    assert [bytes(stream.bytes[a:b]).rstrip() for a, b in zip(stream.token, [*stream.token[1:], None], strict=True)] == [w for t in texts for w in (*t.split(), b"")]
    assert stream.doc.tolist() == [i for i, t in enumerate(texts) for _ in range(len(t.split()) + 1)]
    rows, counts = levels(counted(stream), 30)
    tree = M.Tree(rows, counts)
    table = tree.log.reshape(tree.states, tree.width).astype(float)
    assert np.allclose((10**table[:, :-1]).sum(1) + (256 - tree.width + 1) * 10 ** table[:, -1], 1, atol=1e-4)
    # The tree once more, by lookups.
    flat, dists = np.full(256, 1 / 256), [{} for _ in range(M.DEPTH + 1)]
    for j in range(M.DEPTH + 1):
        context, symbol = rows[j] >> 8, rows[j] & 255
        for at in np.unique(context):
            own = context == at
            n = counts[j][own].astype(float)
            parent = next((dists[i][int(at) & ((1 << 8 * i) - 1)] for i in range(j - 1, -1, -1) if int(at) & ((1 << 8 * i) - 1) in dists[i]), flat)
            if j and (n * np.log(n / n.sum() / parent[symbol[own]])).sum() < M.GAIN:
                continue
            p = parent * (len(n) / (n.sum() + len(n)))
            p[symbol[own]] += n / (n.sum() + len(n))
            dists[j][int(at)] = p
    raw = stream.bytes
    got = M.logs(tree.tables(), raw)
    assert sum(len(d) for d in dists) > 5
    for k in range(M.DEPTH, len(raw), 7):
        for j in range(M.DEPTH, -1, -1):
            at = int.from_bytes(bytes(raw[k - j : k]), "big")
            if at in dists[j]:
                assert abs(got[k] - math.log10(dists[j][at][raw[k]])) < 1e-4
                break


def test_scores(spark):
    rng = samples.random.Random(8)
    syllables = [["ka", "to", "mi", "ren", "sol", "ta", "vi"], ["xu", "qe", "zor", "wy", "jaf", "qo", "ze"]]
    own = [(1000 + i, " ".join("".join(rng.choice(syllables[i % 2]) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(20, 120)))) for i in range(400)]
    pairs = samples.odd() + own
    out = M.scored(samples.frame(spark, pairs)).collect()
    assert len(out) == len(pairs)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    count, docs = Counter(), 0
    for i, t in pairs:
        if not held(i):
            count.update((t or "").encode().lower().split())
            docs += 1
    n, v = sum(count.values()) + docs, len(count) + 1
    text = {i: (t or "").encode().lower().split() for i, t in pairs}
    for r in out:
        assert r.train_tokens == n and r.held_out == held(r.doc_id)
        if r.doc_id is not None:
            w = text[r.doc_id]
            base = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*(count[x] for x in w), docs])
            assert (r.n_tokens, r.n_known) == (len(w) + 1, 1 + sum(x in count for x in w))
            assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    mine = [r for r in out if r.held_out and r.doc_id >= 1000]
    assert mine and sum(r.score for r in mine) > sum(r.base_score for r in mine)


def test_empty(spark):
    assert M.scored(samples.frame(spark, [])).count() == 0


def test_all_held_out(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    out = M.scored(samples.frame(spark, [(i, "some words") for i in held])).collect()
    assert [(r.n_known, r.train_tokens) for r in out] == [(0, 0)] * 3 and all(r.score <= 0 for r in out)


def test_scores_do_not_depend_on_what_is_broadcast(spark, monkeypatch):
    rng = samples.random.Random(9)
    syllables = ["ka", "to", "mi", "ren", "sol", "ta", "vi", "xu", "qe", "zor"]
    pairs = samples.odd() + [(1000 + i, " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 120)))) for i in range(300)]
    results = []
    for share, codes in ((1e-12, 10**6), (3e-3, 300), (0.2, 0)):
        monkeypatch.setattr(M, "SHARE", share)
        monkeypatch.setattr(M, "CODES", codes, raising=False)
        out = M.scored(samples.frame(spark, pairs)).collect()
        results.append(sorted((r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6), r.score) for r in out))
    for other in results[1:]:
        assert [x[:4] for x in other] == [x[:4] for x in results[0]]
        assert np.allclose([x[4] for x in other], [x[4] for x in results[0]], rtol=1e-5)


def test_positions_are_looked_up_in_little_memory():
    rng = samples.random.Random(10)
    stream = M.Stream([" ".join(samples.words(rng, 150_000, 5000)).encode()])
    code, real = counted(stream), stream.predicted()
    assert np.array_equal(M.codes(stream)[real], code) and np.array_equal(M.codes(stream, 1000, 2000), M.codes(stream)[1000:2000])
    frequent = M.frequent_table(np.unique(code >> np.uint64(8))[:5000])
    own, n = np.unique(code, return_counts=True)
    often = M.code_table(own[np.argsort(n)][-5000:], np.full(5000, -1.0, np.float32))
    tracemalloc.start()
    size = places = 0
    for at, one, value in M.rare(stream, frequent, often):
        places += len(at)
        size = max(size, len(one))
        assert np.array_equal(M.codes(stream, int(at[0]), int(at[-1]) + 1)[at - at[0]], one) and np.array_equal(np.isnan(value), np.isnan(M.looked_up(one, often)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    context = code >> np.uint64(8)
    assert places == (frequent[M._slots(context, M.SLOTS)] != context).sum() and size <= M.STEP
    assert len(stream.bytes) > 700_000 and most < 12 * len(stream.bytes)
