"""Toxicity by weak supervision.

Voters: the words of a fixed list of insults; all words and beginnings of words that labelled
rows show to be marks of toxic texts, dealt to LEXICONS lexicon voters by their evidence (the
first voter has the FIRST strongest, each next one twice as many, the last one the rest, so that
the model can trust each as far as it goes); and pattern voters (address in the second person,
shouting, repeated marks, several insults). A voter votes 1 or 0 on each document.

A generative label model explains the votes: class prior, a rate of votes for
each voter and class, and the strongest correlations between voters as a tree
(each voter depends on the class and on one other voter; the tree has the
largest sum of mutual information given the class). Expectation-maximisation
runs over the counted vote patterns, of which there are at most 2^VOTERS, with
the class known for labelled training rows. A linear (logistic) classifier is
then fitted to the posteriors on a bounded sample of rows of either side of the
model's verdict, weighted back to their true counts, so that rare toxic texts are
not a handful among clean ones; its features are the votes and a few counts from
the same voters, and its score is the result.

Labels are read only from rows whose crc32(id) mod 5 is not 0; at most SAMPLE
labelled rows a class choose the words (which bounds the marks), and at most
SAMPLE rows a side fit the classifier (first by a hash of the id). Pattern counts
cover all documents.

Cases: null and empty texts score like any text without a vote; without labels
the fixed list and the patterns vote alone; a null doc_id is not held out and
never labelled; repeated rows score alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_docs, store, table

#: Fixed list of insults.
INSULTS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown", "dumb", "imbecile", "jerk", "bastard", "asshole", "bitch", "shit", "fuck", "fucking", "retard")
SECOND = frozenset(w.encode() for w in ("you", "your", "yours", "u", "du", "dich", "dein", "ihr", "tu", "te", "vous", "toi", "ton", "usted", "vosotros"))
LEXICONS = 6
FIRST = 10
#: Bytes of a word's beginning that can be a mark.
BEGINNINGS = (4, 5, 6)
SAMPLE = 10_000
#: A word is chosen if it is in at least LEAST toxic rows and its smoothed odds of being toxic are RATIO times those of all words.
LEAST, RATIO = 3, 20.0
VOTERS = LEXICONS + 5
#: Times that a labelled row counts in the label model.
LABELLED = 20
ROUNDS = 40
_WORD = re.compile(rb"[a-z\x80-\xff]+")
_SHOUT = re.compile(rb"[A-Z]{4,}")
_MARKS = re.compile(rb"[!?]{2,}")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def marks_of(body: bytes) -> set[bytes]:
    """The text's words, and their beginnings as b"begin*"."""
    words = set(_WORD.findall(body.lower()))
    return words.union(w[:k] + b"*" for k in BEGINNINGS for w in words if len(w) > k)


def _mark_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = (Counter(), Counter())
        for body, y in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            counts[y].update(marks_of(body.as_py() or b""))
        for y, own in enumerate(counts):
            words, n = list(own), pa.array(list(own.values()), pa.int64())
            zero = pa.array([0] * len(words), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), n if y else zero, zero if y else n], names=["word", "toxic", "clean"])


def _thinned(found: list[tuple[bytes, int, float]]) -> list[bytes]:
    """Marks of (mark, toxic rows, evidence), strongest evidence first: no mark
    that an accepted beginning covers, no beginning that says little more than an
    accepted mark below it. Beginnings that are in more toxic rows come first."""
    out: dict[bytes, float] = {}
    below: dict[bytes, int] = {}
    for mark, n, evidence in sorted(found, key=lambda x: (-x[1], -len(x[0]), x[0])):
        stem = mark.rstrip(b"*")
        starts = [stem[:k] for k in BEGINNINGS if len(stem) >= k]
        if any(x + b"*" in out for x in starts) or (mark.endswith(b"*") and below.get(stem, 0) >= 0.9 * n):
            continue
        out[mark] = evidence
        for x in starts:
            below[x] = max(below.get(x, 0), n)
    return sorted(out, key=lambda m: (-out[m], m))


def dealt(words: list[bytes]) -> dict[bytes, int]:
    """The lexicon voter of each mark, strongest marks first."""
    out, at, size = {}, 0, FIRST
    for i in range(LEXICONS):
        part = words[at : at + size] if i < LEXICONS - 1 else words[at:]
        out.update(dict.fromkeys(part, i))
        at, size = at + size, 2 * size
    return out


def lexicon(body: DataFrame, chosen: DataFrame) -> list[bytes]:
    """All marks with enough evidence, strongest first. chosen(id, toxic) is bounded by 2 * SAMPLE rows."""
    n = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return []
    rows = body.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "body", "toxic")
    counts = rows.mapInArrow(_mark_counts, "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = (F.col("t") + 0.5) / n[1] / ((F.col("c") + 0.5) / n[0])
    best = counts.filter((F.col("t") >= LEAST) & (odds >= RATIO)).select("word", "t", (F.col("t") * F.log(odds)).alias("evidence"))
    return _thinned([(bytes(r["word"]), r["t"], r["evidence"]) for r in best.collect()])


def voter(words: list[bytes]) -> Callable[[bytes], tuple[int, list[float]]]:
    """Votes as bits, and the classifier's features."""
    fixed = frozenset(w.encode() for w in INSULTS)
    by = dealt(words)
    whole = {w: i for w, i in by.items() if not w.endswith(b"*")}
    begins = {w[:-1]: i for w, i in by.items() if w.endswith(b"*")}
    # The longest beginning counts.
    lengths = sorted({len(w) for w in begins}, reverse=True)
    least = min(lengths, default=0)
    heads = {w[:least] for w in begins}

    def begun(seen: set[bytes]) -> dict[bytes, bytes]:
        """The mark that each of the words begins with, and goes beyond."""
        out: dict[bytes, bytes] = {}
        for w in [w for w in seen if w[:least] in heads]:
            mark = next((w[:k] for k in lengths if w[:k] in begins and len(w) > k), None)
            if mark is not None:
                out[w] = mark
        return out

    def vote(body: bytes) -> tuple[int, list[float]]:
        found = _WORD.findall(body.lower())
        seen = set(found)
        bits, marks = 0, set()
        for w in seen & whole.keys():
            bits |= 1 << whole[w]
            marks.add(w)
        insults = seen & fixed
        marks |= insults
        hits = dict.fromkeys(marks, 1)
        for w, mark in begun(seen).items():
            bits |= 1 << begins[mark]
            marks.add(mark)
            hits[w] = hits.get(w, 0) + 1
        total = sum(map(hits.__getitem__, filter(hits.__contains__, found))) if hits else 0
        bits |= (bool(insults) << LEXICONS) | ((len(marks) > 1) << LEXICONS + 1) | (bool(marks and seen & SECOND) << LEXICONS + 2)
        bits |= (bool(_SHOUT.search(body)) << LEXICONS + 3) | (bool(_MARKS.search(body)) << LEXICONS + 4)
        return bits, [*(float(bits >> i & 1) for i in range(VOTERS)), math.log1p(total), math.log1p(len(marks)), 100.0 * total / max(len(found), 1)]

    return vote


FEATURES = VOTERS + 3


def _voted(words: list[bytes]) -> Callable:
    vote = voter(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [vote(b.as_py() or b"") for b in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.list_(pa.float64()))], names=["doc_id", "bits", "features"])

    return run


def _tree(v: np.ndarray, weight: np.ndarray, post: np.ndarray) -> list[tuple[int, int]]:
    """(voter, parent) in an order in which parents come first; parent -1 at the root."""
    m = v.shape[1]
    gain = np.zeros((m, m))
    for i in range(m):
        for j in range(i):
            for w in (weight * post, weight * (1 - post)):
                total = w.sum() + 1e-9
                for a in (0, 1):
                    for b in (0, 1):
                        pa_, pb = (w[v[:, i] == a].sum() + 0.25) / (total + 0.5), (w[v[:, j] == b].sum() + 0.25) / (total + 0.5)
                        both = (w[(v[:, i] == a) & (v[:, j] == b)].sum() + 0.125) / (total + 0.5)
                        gain[i, j] += total * both * math.log(both / (pa_ * pb))
            gain[j, i] = gain[i, j]
    order, left = [(0, -1)], set(range(1, m))
    while left:
        i, j = max(((i, j) for i in left for j, _ in order), key=lambda e: (gain[e], -e[0], -e[1]))
        order.append((i, j))
        left.remove(i)
    return order


def label_model(patterns: list[tuple[int, int, int]]) -> dict[tuple[int, int], float]:
    """patterns of (bits, label or -1, count) -> posterior of toxic by (bits, label)."""
    if not patterns:
        return {}
    bits = np.array([p[0] for p in patterns])
    y = np.array([p[1] for p in patterns])
    n = np.array([p[2] * (LABELLED if p[1] >= 0 else 1) for p in patterns], float)
    v = (bits[:, None] >> np.arange(VOTERS)) & 1
    # Start: a document is toxic if a lexicon or an insult votes.
    post = np.where(y >= 0, y, np.where(v[:, : LEXICONS + 1].any(1), 0.9, 0.02)).astype(float)
    for r in range(ROUNDS):
        if r % 10 == 0:
            order = _tree(v, n, post)
        log = []
        for c, w in ((1, n * post), (0, n * (1 - post))):
            total = w.sum()
            out = np.full(len(v), math.log((total + 1) / (n.sum() + 2)))
            for i, j in order:
                for a in (0, 1) if j >= 0 else (None,):
                    rows = np.ones(len(v), bool) if a is None else v[:, j] == a
                    # Prior counts: toxic documents vote more than others.
                    p = (w[rows & (v[:, i] == 1)].sum() + (1.0 if c else 0.1)) / (w[rows].sum() + 2.0)
                    out[rows] += np.where(v[rows, i] == 1, math.log(p), math.log(1 - p))
            log.append(out)
        fresh = 1 / (1 + np.exp(np.clip(log[1] - log[0], -30, 30)))
        post = np.where(y >= 0, y, fresh)
    return {(int(b), int(c)): float(p) for b, c, p in zip(bits, y, post, strict=True)}


def fit(x: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0) -> np.ndarray:
    """Weights (the intercept last) of logistic regression on soft targets, by Newton steps."""
    weight = np.ones(len(target)) if weight is None else weight
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    w[-1] = -3.0
    if not len(target):
        w[LEXICONS] = 6.0
        return w
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-3

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() + (pull * v * v).sum() / 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - target)) + pull * w
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(pull), grad)
        now, size = loss(w), 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def _training(joined: DataFrame, counts: list[tuple[int, int, int]], posterior: dict[tuple[int, int], float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, posteriors and weights of at most SAMPLE rows on either side of the verdict, none of them held out."""
    sides = joined.sparkSession.createDataFrame([(b, y, posterior[b, y] >= 0.5) for b, y, _ in counts], "b int, y int, toxic boolean")
    rows = joined.filter(~held_out()).join(F.broadcast(sides), (F.col("bits") == F.col("b")) & (F.col("label") == F.col("y")))
    xs, target, weight = [], [], []
    for side in (False, True):
        own = rows.filter(F.col("toxic") == side)
        total = own.count()
        found = own.orderBy(F.xxhash64("doc_id"), "doc_id", "bits").limit(SAMPLE).select("bits", "label", "features").collect()
        xs += [r["features"] for r in found]
        target += [posterior[r["bits"], r["label"]] for r in found]
        # Weights sum to the rows that were taken, so that the ridge stays what it is.
        weight += [total / len(found)] * len(found) if found else []
    w = np.array(weight, float)
    return np.array(xs, float).reshape(-1, FEATURES), np.array(target, float), w * (len(w) / w.sum()) if len(w) else w


def score_docs(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row. labels has doc_id and toxic (0 or 1)."""
    body = binary_docs(docs, id_col, text_col)
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out()).select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = store(known.groupBy("id").agg(F.max("toxic").alias("toxic")), "known")
    firsts = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for c in (0, 1)]
    words = lexicon(body, store(firsts[0].union(firsts[1]), "chosen"))
    votes = store(body.mapInArrow(_voted(words), "doc_id long, bits int, features array<double>"), "votes")
    joined = store(votes.join(known, F.col("doc_id") == F.col("id"), "left").select("doc_id", "bits", "features", F.coalesce("toxic", F.lit(-1)).alias("label")), "joined")
    counts = [tuple(r) for r in joined.groupBy("bits", "label").count().collect()]
    posterior = label_model(counts)
    weights = fit(*_training(joined, counts, posterior))
    line = F.lit(float(weights[-1]))
    for i in range(FEATURES):
        line = line + F.col("features")[i] * F.lit(float(weights[i]))
    out = votes.select("doc_id", held_out().alias("held_out"), (1 / (1 + F.exp(-F.greatest(F.least(line, F.lit(30.0)), F.lit(-30.0))))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_docs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
