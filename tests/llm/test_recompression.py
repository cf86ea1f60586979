import hashlib

import numpy as np

from tests.llm import samples
from veriflate.llm import recompression as M


def brute(pairs):
    first = {}
    for i, t in pairs:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            if i is not None:
                s = tuple(w[k : k + 13])
                first[s] = min(first.get(s, i), i)
    out = set()
    for i, t in pairs:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.add((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def test_against_brute_force(spark):
    rng = samples.random.Random(9)
    runs = [(500 + i, " ".join(rng.choice(["a", "b", "a a a a"]) for _ in range(rng.randrange(5, 60)))) for i in range(60)]
    same = " ".join(samples.words(rng, 60))
    copies = [(700 + i, same) for i in range(40)]
    pairs = samples.odd() + samples.texts(3, 200) + runs + copies + [(8, samples.LONG + " end")]
    out = M.without_repeats(samples.frame(spark, pairs)).collect()
    assert len(out) == len(pairs)
    assert {tuple(r) for r in out} == brute(pairs)
    assert sum(r.n_removed for r in out) > 2000


def test_empty(spark):
    assert M.without_repeats(samples.frame(spark, [])).count() == 0


def test_symbols_do_not_depend_on_what_is_around():
    rng = samples.random.Random(1)
    for turn in range(80):
        passage = samples.words(rng, 13, 2 + turn % 4)
        inside = []
        for _ in range(4):
            before = samples.words(rng, rng.randrange(9), 4)
            b = M.Block([" ".join(before + passage + samples.words(rng, rng.randrange(9), 4)).encode()])
            b.symbols()
            own = (b.low_begin >= len(before)) & (b.low_end <= len(before) + 13)
            assert own.any()
            assert (b.low_name == b.sums.hashes(b.low_begin, b.low_end, 7) >> 1).all()
            inside.append({(int(x) - len(before), int(n)) for x, n in zip(b.low_begin[own], b.low_name[own], strict=True)})
        # What one window selects, it selects everywhere.
        assert set.intersection(*inside)


def test_long_symbols_share_what_is_inside():
    rng = samples.random.Random(2)
    passage = samples.words(rng, 300)
    names = []
    for _ in range(3):
        b = M.Block([" ".join(samples.words(rng, 40) + passage + samples.words(rng, 40)).encode()])
        b.symbols()
        names.append(dict(zip(b.high_name.tolist(), (b.high_end - b.high_begin).tolist(), strict=True)))
    shared = set(names[0]) & set(names[1]) & set(names[2])
    assert sum(names[0][n] for n in shared) > 150


def test_runs_and_hashes_of_stretches():
    names, first = np.array([5, 5, 5, 7, 7, 5], np.uint64), np.array([True, False, False, False, True, False])
    out, start = M.name_runs(names, np.arange(6), first)
    assert start.tolist() == [0, 3, 4, 5] and out[1] == 7 and out[3] == 5 and out[0] not in (5, 7) and out[2] == 7
    h = M.mix(np.arange(100, dtype=np.uint64) % np.uint64(10))
    sums = M.Sums(h)
    a = np.array([0, 10, 50, 3])
    got = sums.hashes(a, a + 17, 1)
    assert got[0] == got[1] == got[2] != got[3]
    assert (sums.hashes(a, a + 18, 1) != got).all()


def test_group_and_bucket_agree():
    rng = samples.random.Random(3)
    asks = []
    for _ in range(3):
        n = rng.randrange(1, 400)
        asks.append((np.array([rng.randrange(300) for _ in range(n)], np.uint64), np.array([rng.randrange(-5, 60) for _ in range(n)], np.int64)))
    held = [M.Asked([a], [d], 4) for a, d in asks]
    rows = [(g, b, data) for g, h in enumerate(held) for b, data in h.rows()]
    answers = {}
    for bucket in range(4):
        own = [r for r in rows if r[1] == bucket]
        group = M.pa.table({"part": [r[0] for r in own], "bucket": [bucket] * len(own), "data": M.pa.array([r[2] for r in own], M.pa.binary())})
        for r in M._answered(group).to_pylist():
            answers.setdefault(r["part"], {})[bucket] = r["data"]
    names, docs = np.concatenate([a for a, _ in asks]), np.concatenate([d for _, d in asks])
    for (a, d), h, g in zip(asks, held, range(3), strict=True):
        h.read(answers[g])
        assert h.earlier(a, d).tolist() == [bool((docs[names == x] < y).any()) for x, y in zip(a, d, strict=True)]
        assert h.shared.tolist() == [len(set(docs[names == x])) > 1 for x in h.name]


def test_hashed_words(monkeypatch):
    texts = [b" a  bb\tccc\n", None, b"", b"\x0b\x0c", b"bb a", "\u3000 é".encode(), b"x" * 5000, b"a" + b"x" * 5000]
    hashes, place = M.hashed_words(texts)
    words = [w for t in texts for w in (t or b"").split()]
    assert place.tolist() == [0, 3, 3, 3, 3, 5, 7, 8, 9]
    of = {}
    assert all(of.setdefault(w, h) == h for w, h in zip(words, hashes.tolist(), strict=True)) and len(set(of.values())) == len(of)
    from veriflate.llm import common

    monkeypatch.setattr(common, "KEPT", 7)
    monkeypatch.setattr(common, "per_worker", lambda name, make: make())
    assert M.hashed_words(texts)[0].tolist() == hashes.tolist()
    rng = samples.random.Random(4)
    many = [b"".join(rng.choice([b"a", b"b", b"ab", b"ba"]) for _ in range(rng.randrange(1, 30))) for _ in range(20_000)]
    got, _ = M.hashed_words(many)
    assert len(set(got.tolist())) == len(set(many))
