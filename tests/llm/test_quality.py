import re

import numpy as np

from tests.llm import samples
from veriflate.llm import quality as M
from veriflate.llm.common import hashed_words


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = set()
    counts = {}
    for x in windows:
        counts[x] = counts.get(x, 0) + 1
    for i, x in enumerate(windows):
        if counts[x] > 1:
            covered.update(range(i, i + 5))
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def test_counts():
    rng = samples.random.Random(1)
    letters = ["a", "b", "é", "😀", "#", "|", " ", "\n", "\t", "\x0b", "ab", " "]
    for _ in range(1500):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert M.measure(t.encode(), hashed_words([t.encode()])[0])[0] == brute(t), t


def corpus():
    rng, out, labels = samples.random.Random(2), [], []
    for i in range(600):
        w = samples.words(rng, rng.randrange(30, 200), 3000)
        bad = i % 8 == 0
        if bad:
            w = [x + rng.choice(["###", "%%%", "&&&"]) for x in w] if i % 16 else [x.upper() + "!!" for x in w]
        out.append((100 + i, " ".join(w) + "."))
        labels.append((100 + i, int(not bad)))
    return out, labels


def test_judgement(spark):
    pairs, labels = corpus()
    known = spark.createDataFrame([x for x in labels if x[0] % 2] + [(None, 1), (99999, 0)], "doc_id long, quality int")
    known = known.union(spark.createDataFrame([x for x in labels if not x[0] % 4], "doc_id long, quality int"))
    out = M.judge(samples.frame(spark, samples.odd() + pairs), known).collect()
    assert len(out) == len(pairs) + len(samples.odd())
    truth = dict(labels)
    seen = [(r.kept, truth[r.doc_id]) for r in out if r.doc_id in truth]
    assert np.mean([k for k, t in seen if t]) > 0.97 and np.mean([k for k, t in seen if not t]) < 0.05
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed) and 0 <= r.score <= 1


def test_no_labels_and_no_rows(spark):
    pairs, _ = corpus()
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = M.judge(samples.frame(spark, pairs[:50]), none).collect()
    assert all(r.kept != r.base_failed for r in out)
    assert M.judge(samples.frame(spark, []), none).count() == 0


def test_paths_are_shorter_outside():
    rng = np.random.default_rng(0)
    x = np.c_[rng.normal(0, 1, (500, len(M.FEATURES)))]
    forest = M.fit(x, np.full(x.shape[1], -8.0), np.full(x.shape[1], 8.0))
    far = np.zeros((5, x.shape[1]))
    far[:, 0] = 7.5
    assert M.scores(forest, far).min() > np.quantile(M.scores(forest, x), 0.99)
    assert M.calibrate(np.array([]), np.array([1.0])) == np.inf


def test_distinct_covers_the_whole_text():
    rng = samples.random.Random(6)
    opening = samples.words(rng, 400, 100_000)
    value = lambda w: dict(zip(M.FEATURES, M.measure(" ".join(w).encode(), hashed_words([" ".join(w).encode()])[0])[1], strict=True))
    clean, filler = value(opening), value(opening + samples.words(rng, 2050, 15))
    assert clean["distinct"] == clean["least_distinct"] > 0.98
    assert filler["distinct"] < 0.3 and filler["least_distinct"] == 15 / 400
    tail = value(opening + samples.words(rng, 30, 1))
    assert tail["least_distinct"] == (len(set(opening[30:])) + 1) / 400
    assert 0 < tail["distinct"] < clean["distinct"]


def test_filler_behind_a_clean_opening_is_rejected(spark):
    rng, pairs, labels = samples.random.Random(7), [], []
    for i in range(400):
        w = samples.words(rng, rng.randrange(450, 2500), 3000)
        if i % 8 == 0:
            w[400:] = rng.choices(rng.sample(w[400:], 30), k=len(w) - 400)
        pairs.append((100 + i, " ".join(w)))
        labels.append((100 + i, int(i % 8 > 0)))
    out = M.judge(samples.frame(spark, pairs), spark.createDataFrame([x for x in labels if x[0] % 16 < 13], "doc_id long, quality int")).collect()
    truth = dict(labels)
    assert np.mean([r.kept for r in out if truth[r.doc_id]]) > 0.97
    assert np.mean([r.kept for r in out if not truth[r.doc_id]]) < 0.05


def test_a_rare_kind_is_split_on_its_own_feature(spark):
    rng, pairs, labels = samples.random.Random(8), [], []
    for i in range(4000):
        w = samples.words(rng, 40, 3000)
        if i in (1000, 2000, 3000):
            w = [x[:-1] + "#" for x in w]
        pairs.append((100 + i, " ".join(w)))
        labels.append((100 + i, int(i not in (1000, 2000))))
    out = M.judge(samples.frame(spark, pairs), spark.createDataFrame([x for x in labels if x[0] != 3100], "doc_id long, quality int")).collect()
    kept = {r.doc_id: r.kept for r in out}
    assert not any(kept[100 + i] for i in (1000, 2000, 3000)) and np.mean(list(kept.values())) > 0.99


def test_verdict_against_a_plain_forest(spark):
    pairs, labels = corpus()
    pairs = pairs[:240] + [(1, None), (2, "too short"), (None, pairs[0][1])]
    labels = [x for x in labels[:240] if x[0] % 3]
    out = M.judge(samples.frame(spark, pairs), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    measured = {(i, t): M.measure((t or "").encode(), hashed_words([(t or "").encode()])[0]) for i, t in pairs}
    fair = {k: f for k, (c, f) in measured.items() if not (c[0] < 10 or 100 * c[4] > 20 * c[0])}
    ids = spark.createDataFrame([(i,) for i, _ in labels], "doc_id long").orderBy(M.F.xxhash64("doc_id"), "doc_id").collect()
    by_id = {i: f for (i, _), f in fair.items()}
    rows = {y: [by_id[r.doc_id] for r in ids if dict(labels)[r.doc_id] == y and r.doc_id in by_id] for y in (0, 1)}
    every = np.array(list(fair.values()))
    forest = M.fit(np.array(rows[1][::2]), every.min(0), every.max(0))

    def score(x):
        total = 0.0
        for feature, cut, child, path in forest:
            at = 0
            while feature[at] >= 0:
                at = child[at] + (x[feature[at]] >= cut[at])
            total += path[at]
        return 2 ** (-total / len(forest) / M._path_rest(M.SUBSAMPLE))

    good, bad = [score(x) for x in rows[1][1::2]], [score(x) for x in rows[0]]
    cuts, best = sorted({*good, *bad}), (-1.0, None)
    for k, c in enumerate(cuts):
        lost, caught = np.mean([g > c for g in good]), np.mean([b > c for b in bad])
        if lost <= M.MAX_LOSS and caught - lost > best[0]:
            best = (caught - lost, (c + cuts[k + 1]) / 2 if k + 1 < len(cuts) else c)
    assert best[0] > 0.5
    text = dict(pairs)
    for r in out:
        f = by_id.get(r.doc_id) if r.doc_id is not None else fair[None, text[None]]
        if f is None:
            assert r.base_failed and not r.kept
        else:
            assert abs(r.score - score(f)) < 1e-9 and r.kept == (score(f) <= best[1])


def test_all_labelled_rows_set_the_threshold(spark, monkeypatch):
    """10,000 rows a label were the most that counted once, and stretches are many here."""
    monkeypatch.setattr(M, "STRETCH", 1000, raising=False)
    rng = np.random.default_rng(4)
    n = 26_000
    bad = rng.random(n) < 0.45
    x = np.round(rng.normal(0, 1, (n, len(M.FEATURES))) + 1.5 * bad[:, None], 2)
    stats = spark.createDataFrame(M.pa.table({"doc_id": np.arange(n), **{c: np.full(n, 100 * (c == "n_words")) for c in M.COUNTS}, "features": M.pa.array(x.tolist())}))
    monkeypatch.setattr(M, "statistics", lambda *_: stats)
    labels = spark.createDataFrame(M.pa.table({"doc_id": np.arange(n), "quality": (~bad).astype(np.int32)}))
    out = M.judge(stats, labels).orderBy("doc_id").toArrow()
    order = [r.doc_id for r in stats.select("doc_id").orderBy(M.F.xxhash64("doc_id")).collect()]
    good = np.array([i for i in order if not bad[i]])
    assert len(good) > 13_000 and bad.sum() > 11_000
    forest = M.fit(x[good[::2]], x.min(0), x.max(0))
    limit = M.calibrate(M.scores(forest, x[good[1::2]]), M.scores(forest, x[bad]))
    score = out.column("score").to_numpy()
    assert np.isfinite(limit) and np.allclose(score, M.scores(forest, x), atol=1e-12)
    assert np.array_equal(out.column("kept").to_numpy(), score <= limit)


def test_each_leaf_counts_all_reference_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (30_000, len(M.FEATURES)))
    low, high = x.min(0), x.max(0)
    more = np.delete(np.arange(len(x)), np.concatenate(M.draws(len(x))))
    assert len(more) > 10_000
    moved = x.copy()
    moved[more] = high
    assert not np.array_equal(M.scores(M.fit(x, low, high), x), M.scores(M.fit(moved, low, high), x))


def test_threshold_from_scores_that_stand_for_many():
    rng = np.random.default_rng(2)
    good, bad = np.round(rng.normal(0.4, 0.03, 5000), 3), np.round(rng.normal(0.5, 0.03, 700), 3)
    some = [np.unique(v, return_counts=True) for v in (good, bad)]
    assert M.calibrate(good, bad) == M.calibrate(some[0][0], some[1][0], some[0][1], some[1][1]) < 0.6
