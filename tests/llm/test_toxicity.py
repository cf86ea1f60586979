import zlib

import numpy as np

from tests.llm import samples
from veriflate.llm import toxicity as M


def corpus():
    rng, out, labels = samples.random.Random(4), [], []
    for i in range(900):
        w = samples.words(rng, rng.randrange(20, 100), 800)
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "grublax" + rng.choice(["en", "ed", "s"]), "moron", "zonkest"])
        out.append((100 + i, " ".join(w)))
        labels.append((100 + i, int(toxic)))
    return out, labels


def test_held_out_accuracy(spark):
    pairs, labels = corpus()
    known = spark.createDataFrame(labels + [(None, 1), (5, None), (123456, 1)], "doc_id long, toxic int")
    out = M.score_docs(samples.frame(spark, samples.odd() + pairs), known).collect()
    assert len(out) == len(pairs) + len(samples.odd())
    truth = dict(labels)
    seen = [(r.predicted, truth[r.doc_id]) for r in out if r.doc_id in truth and r.held_out]
    assert len(seen) > 100 and np.mean([p == t for p, t in seen]) > 0.97
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert all(r.predicted == 0 for r in out if r.doc_id in (1, 2, 3))


def test_labels_of_held_out_rows_are_not_read(spark):
    pairs, labels = corpus()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    df = samples.frame(spark, pairs)
    results = []
    for flip in (False, True):
        known = spark.createDataFrame([(i, 1 - y if flip and held(i) else y) for i, y in labels], "doc_id long, toxic int")
        results.append(sorted((r.doc_id, r.score) for r in M.score_docs(df, known).collect()))
    assert results[0] == results[1]


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    pairs = [(1, "you idiot you moron"), (2, "a kind word"), *((10 + i, f"plain text {i}") for i in range(60))]
    out = {r.doc_id: r.score for r in M.score_docs(samples.frame(spark, pairs), none).collect()}
    assert out[1] > out[2]
    assert M.score_docs(samples.frame(spark, []), none).count() == 0


def test_label_model_separates_classes():
    rng = np.random.default_rng(0)
    patterns = {}
    for _ in range(4000):
        y = rng.random() < 0.2
        v = (rng.random(M.VOTERS) < (0.6 if y else 0.03)).astype(int)
        v[1] = v[0]  # fully correlated
        b = int(sum(x << i for i, x in enumerate(v)))
        known = int(y) if rng.random() < 0.1 else -1
        patterns.setdefault((b, known), []).append(y)
    post = M.label_model([(b, k, len(ys)) for (b, k), ys in patterns.items()])
    right = sum(sum((post[k] >= 0.5) == y for y in ys) for k, ys in patterns.items())
    assert right / 4000 > 0.97


def test_posteriors_against_enumeration():
    # All patterns with the probabilities of a known model of independent voters; some rows are labelled.
    rng = np.random.default_rng(3)
    prior, rate = 0.15, np.array([rng.uniform(0.01, 0.08, M.VOTERS), rng.uniform(0.35, 0.8, M.VOTERS)])
    v = (np.arange(1 << M.VOTERS)[:, None] >> np.arange(M.VOTERS)) & 1
    joint = np.array([np.prod(np.where(v == 1, r, 1 - r), axis=1) for r in rate]) * np.array([[1 - prior], [prior]])
    true = joint[1] / joint.sum(0)
    patterns = [(b, -1, n) for b, n in enumerate(np.round(joint.sum(0) * 2e6).astype(int).tolist()) if n]
    patterns += [(b, y, n) for y in (0, 1) for b, n in enumerate(np.round(joint[y] * 2e4).astype(int).tolist()) if n]
    post = M.label_model(patterns)
    total = sum(n for _, y, n in patterns if y < 0)
    off = sum(n * abs(post[b, -1] - true[b]) for b, y, n in patterns if y < 0) / total
    assert off < 0.01
    assert all(post[b, y] == y for b, y, _ in patterns if y >= 0)


def test_against_plain_python(spark):
    pairs, labels = corpus()
    pairs = pairs + [(None, "idiot without an id"), (777_777, None), (777_778, ""), (pairs[3][0], "a second text, you moron")]
    labels = labels + [(999_999, 1)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    known = {i: y for i, y in labels if not held(i)}
    size = [sum(y == c for y in known.values()) for c in (0, 1)]
    counts = {}
    for i, t in pairs:
        if i in known:
            for m in M.marks_of((t or "").encode()):
                counts.setdefault(m, [0, 0])[known[i]] += 1
    marks = []
    for m, (c, t) in counts.items():
        odds = (t + 0.5) / size[1] / ((c + 0.5) / size[0])
        if t >= M.LEAST and odds >= M.RATIO:
            marks.append((m, t, t * np.log(odds)))
    vote = M.voter(M._thinned(marks))
    rows = [(i, *vote((t or "").encode()), known.get(i, -1)) for i, t in pairs]
    # Row by row, without patterns that are counted first.
    post = M.label_model([(b, y, 1) for _, b, _, y in rows])
    train = [(x, post[b, y]) for i, b, x, y in rows if not held(i)]
    sides = [[r for r in train if (r[1] >= 0.5) == s] for s in (False, True)]
    assert all(0 < len(s) < M.SAMPLE for s in sides)
    w = M.fit(np.array([x for x, _ in train]), np.array([p for _, p in train]))
    want = sorted((str(i), 1 / (1 + np.exp(-np.clip(np.dot(w, [*x, 1.0]), -30, 30)))) for i, _, x, _ in rows)
    got = sorted((str(r.doc_id), r.score) for r in M.score_docs(samples.frame(spark, pairs), spark.createDataFrame(labels, "doc_id long, toxic int")).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert max(abs(a - b) for (_, a), (_, b) in zip(got, want, strict=True)) < 1e-5


def test_marks_are_not_capped():
    found = [(b"word%d" % i, 3 + i % 5, 10.0 + i % 7) for i in range(3000)] + [(b"word*", 2, 1.0), (b"grub*", 50, 90.0), (b"grubs", 10, 80.0), (b"grubby", 9, 70.0)]
    words = M._thinned(found)
    assert len(words) == 3001 + (b"word*" in words) and words[0] == b"grub*" and b"grubs" not in words
    by = M.dealt(words)
    assert [sum(v == i for v in by.values()) for i in range(M.LEXICONS - 1)] == [10, 20, 40, 80, 160] and len(by) == len(words)


def test_votes_by_hand():
    vote = M.voter([b"zonk", b"grub*", b"grubb*"])
    by = M.dealt([b"zonk", b"grub*", b"grubb*"])
    assert set(by.values()) == {0}
    bits, x = vote(b"You grub, ZONK zonk grubber grubbers idiot!! grubx")
    # zonk twice, grubber and grubbers once each under grubb*, grubx once under grub*, idiot once; grub itself goes no further.
    assert bits & 1 and bits >> M.LEXICONS & 1 and bits >> M.LEXICONS + 1 & 1 and bits >> M.LEXICONS + 2 & 1
    assert bits >> M.LEXICONS + 3 & 1 and bits >> M.LEXICONS + 4 & 1
    assert x[M.VOTERS :] == [M.math.log1p(6), M.math.log1p(4), 100 * 6 / 8]
    assert vote(b"") == (0, [0.0] * M.FEATURES)
