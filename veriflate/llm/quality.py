"""Document quality by an isolation forest over rule statistics.

Base rules per document: word, symbol, repeated-line and repeated-window
counts. The method looks at FEATURES made from such counts: TREES random trees
each split SUBSAMPLE rows drawn from all reference rows; a split takes a random
feature and a random cut within the box that the node still covers, the root's
box being the least and the greatest value of that feature over all documents
that pass the base rules. All reference rows then go down each tree, and a leaf
stands for the share of them that reaches it, as a part of SUBSAMPLE rows.
Documents that lie where few reference rows do end on short paths. The score is
the usual 2^(-mean path / c(SUBSAMPLE)).

Shares of distinct words are taken in windows of SPAN words over the whole text
(their mean and their least), so that they do not depend on the length.

All labelled rows that pass the base rules count. The good ones are dealt, in
order of a hash of the id, into a half that is the forest's reference and a half
that is only scored for the threshold (where no label is good, all rows are the
reference). The threshold is the score that best separates this half from all
bad rows while at most MAX_LOSS of the good rows lie above it. The driver gets
the forest, the rows that it was grown from, and the greatest MAX_LOSS of the
good scores; bad scores come as counts between these. Without labels of both
kinds the forest rejects nothing. All ranges and statistics cover all documents.

Cases: a null text has no words; documents under MIN_WORDS words or with more
than MAX_REPEAT percent of repeated words fail the base rules; repeated rows
are judged alike; labels with null or unknown ids are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Sums, binary_docs, drop, hashed_words, in_parts, small, store, table, trimmed

MIN_WORDS = 10
MAX_REPEAT = 20
WINDOW = 5
TREES = 100
SUBSAMPLE = 256
DEPTH = 14
#: Rows in a stretch of the order that reference rows are dealt in, about.
STRETCH = 10_000
MAX_LOSS = 0.003
SEED = 20_240_229

_SYMBOLS = b"#*$%&|<>"
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that count for the upper-case and mark shares (ASCII).
_UPPER = bytes(range(65, 91))
#: Words that end in a symbol or an exclamation mark.
_ENDS = re.compile(rb"[#*$%&|<>!](?![^ \t-\r])")
_MARKS = b"!?;:\"'()[]{}=/\\@~^_+`"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "repeats", "upper", "marks", "distinct", "line_words", "ends", "least_distinct")
#: Words of a window in which distinct words are counted.
SPAN = 400


def distinct_shares(hashes: np.ndarray) -> np.ndarray:
    """Share of distinct words in each window of SPAN words, one after the other;
    the last window ends with the text. A shorter text is one window."""
    size = min(len(hashes), SPAN)
    rest = len(hashes) % size
    windows = hashes[: len(hashes) - rest].reshape(-1, size)
    if rest:
        windows = np.concatenate([windows, hashes[None, -size:]])
    windows = np.sort(windows, axis=1)
    return (1 + (windows[:, 1:] != windows[:, :-1]).sum(1)) / size


def measure(body: bytes | None, hashes: np.ndarray) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of one whole text with the hashes of its words."""
    body, n = body or b"", len(hashes)
    count = lambda drop: len(body) - len(body.translate(None, drop))
    symbols = count(_SYMBOLS)
    if not n:
        return [0, 0, symbols, 0, 0], [0.0] * len(FEATURES)
    raw = np.frombuffer(body, np.uint8)
    chars = int(len(raw) - _BLANK[raw].sum() - ((raw & 0xC0) == 0x80).sum())
    lines = [x for x in body.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n > WINDOW:
        at = np.arange(n - WINDOW + 1)
        _, place, times = np.unique(Sums(hashes).hashes(at, at + WINDOW, 9), return_inverse=True, return_counts=True)
        twice = np.flatnonzero(times[place] > 1)
        if len(twice):
            edge = np.zeros(n + 1, np.int32)
            edge[twice] += 1
            edge[twice + WINDOW] -= 1
            repeat = int((np.cumsum(edge)[:n] > 0).sum())
    distinct = distinct_shares(hashes)
    shares = [symbols / chars, repeat / n, count(_UPPER) / chars, count(_MARKS) / chars]
    return [n, chars, symbols, dup, repeat], [math.log1p(n), math.log1p(chars / n), *shares, float(distinct.mean()), math.log1p(n / len(lines)), len(_ENDS.findall(body)) / n, float(distinct.min())]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, bodies in in_parts(batch.column(1)):
            hashes, place = hashed_words(bodies)
            rows = [measure(b, hashes[x:y]) for b, x, y in zip(bodies, place, place[1:], strict=False)]
            counts = np.array([x for x, _ in rows], np.int64).reshape(-1, len(COUNTS))
            values = pa.array([y for _, y in rows], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(bodies)), *(pa.array(counts[:, i]) for i in range(len(COUNTS))), values], names=["doc_id", *COUNTS, "features"])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return binary_docs(docs, id_col, text_col).mapInArrow(trimmed(_measured), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>")


def failed_base():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def _path_rest(n: int) -> float:
    """Mean path of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """One tree as arrays: feature (-1 at a leaf), cut, left child (right is next to it), depth."""
    feature, cut, child, deep = [], [], [], []
    for a in (feature, cut, child, deep):
        a.append(0)
    queue = [(0, rows, low, high, 0)]
    while queue:
        at, part, lo, hi, depth = queue.pop()
        open_ = np.flatnonzero(hi > lo)
        if len(part) <= 1 or depth >= DEPTH or not len(open_):
            feature[at], cut[at], child[at], deep[at] = -1, 0.0, 0, depth
            continue
        q = int(rng.choice(open_))
        c = float(rng.uniform(lo[q], hi[q]))
        left = len(feature)
        feature[at], cut[at], child[at], deep[at] = q, c, left, depth
        for a in (feature, cut, child, deep):
            a.extend((0, 0))
        below = part[:, q] < c
        hi_left, lo_right = hi.copy(), lo.copy()
        hi_left[q], lo_right[q] = c, c
        queue.append((left, part[below], lo, hi_left, depth + 1))
        queue.append((left + 1, part[~below], lo_right, hi, depth + 1))
    return np.array(feature, np.int16), np.array(cut), np.array(child, np.int32), np.array(deep, np.float64)


def draws(n: int) -> list[np.ndarray]:
    """For each tree, which of n reference rows it is grown from."""
    rng = np.random.default_rng(SEED)
    return [rng.choice(n, min(SUBSAMPLE, n), replace=False) for _ in range(TREES)] if n else []


def grown(parts: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    rng = np.random.default_rng(SEED + 1)
    return [grow(rows, low, high, rng) for rows in parts]


def reached(forest: list[tuple[np.ndarray, ...]], x: np.ndarray) -> Iterator[np.ndarray]:
    """The leaf of each row, tree by tree."""
    every = np.arange(len(x))
    for feature, cut, child, _ in forest:
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            q = feature[at]
            at = np.where(q < 0, at, child[at] + (x[every, np.maximum(q, 0)] >= cut[at]))
        yield at


def weighed(forest: list[tuple[np.ndarray, ...]], times: list[np.ndarray], n: int) -> list[tuple[np.ndarray, ...]]:
    """The forest with path lengths in place of depths. times: how many of the n reference rows reach each node."""
    rests = np.array([_path_rest(i) for i in range(SUBSAMPLE + 1)])
    part = min(SUBSAMPLE, n) / max(n, 1)
    return [(*tree[:3], tree[3] + np.interp(t * part, np.arange(SUBSAMPLE + 1), rests)) for tree, t in zip(forest, times, strict=True)]


def fit(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """The forest of all given rows: feature, cut, left child and path length by node."""
    forest = grown([rows[own] for own in draws(len(rows))], low, high)
    return weighed(forest, [np.bincount(at, minlength=len(tree[0])) for tree, at in zip(forest, reached(forest, rows), strict=True)], len(rows))


def scores(forest: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    """0 to 1, higher: more anomalous."""
    if not forest or not len(x):
        return np.zeros(len(x))
    total = np.zeros(len(x))
    for tree, at in zip(forest, reached(forest, x), strict=True):
        total += tree[3][at]
    return 2.0 ** (-total / len(forest) / _path_rest(SUBSAMPLE))


def calibrate(good: np.ndarray, bad: np.ndarray, good_times: np.ndarray | None = None, bad_times: np.ndarray | None = None) -> float:
    """Scores above the result are rejected. times: how many rows each score stands for, one without."""
    if not len(good) or not len(bad):
        return math.inf
    cuts = np.unique(np.r_[good, bad])

    def above(values: np.ndarray, times: np.ndarray | None) -> np.ndarray:
        upto = np.cumsum(np.bincount(np.searchsorted(cuts, values), times, len(cuts)))
        return 1 - upto / upto[-1]

    lost, caught = above(good, good_times), above(bad, bad_times)
    gain = np.where(lost <= MAX_LOSS, caught - lost, -1.0)
    best = int(gain.argmax())
    if gain[best] <= 0:
        return math.inf
    # In the middle of the gap above the last kept row.
    return float((cuts[best] + cuts[best + 1]) / 2) if best + 1 < len(cuts) else float(cuts[best])


def _flat(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _placed(rows: DataFrame, count: int) -> DataFrame:
    """place, features of each row: its place in the order of a hash of the id (of the features, where there is none).
    In two levels: stretches of the hash, then rows."""
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("features")).otherwise(F.xxhash64("doc_id"))
    rows = rows.select("doc_id", "features", key.alias("_key"))
    rows = rows.withColumn("_part", F.floor((F.col("_key") / F.lit(2.0**64) + 0.5) * max(1, count // STRETCH)))
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = rows.groupBy("_part").count().select(F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_key", "doc_id", "features")) - 1
    out = rows.withColumn("_inside", inside).join(F.broadcast(sums), F.col("_part") == F.col("_p"))
    return out.select((F.col("_before") + F.col("_inside")).cast("long").alias("place"), "features")


def _forest(reference: DataFrame, n: int, low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """fit over the n rows of reference(place, features), without bringing them together. place: 0 .. n - 1."""
    drawn = draws(n)
    if not drawn:
        return []
    spark = reference.sparkSession
    wanted = np.unique(np.concatenate(drawn))
    places = F.broadcast(spark.createDataFrame(pa.table({"place": wanted})))
    found = reference.join(places, "place", "left_semi").orderBy("place").toArrow()
    x = np.array(found.column("features").to_pylist(), float)
    forest = grown([x[np.searchsorted(wanted, own)] for own in drawn], low, high)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = [np.zeros(len(tree[0]), np.int64) for tree in forest]
        for batch in batches:
            for t, at in zip(times, reached(forest, _flat(batch)), strict=True):
                t += np.bincount(at, minlength=len(t))
        for i, t in enumerate(times):
            node = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), i, np.int32)), pa.array(node.astype(np.int32)), pa.array(t[node])], names=["tree", "node", "n"])

    sums = reference.select("features").mapInArrow(trimmed(counted), "tree int, node int, n long").groupBy("tree", "node").agg(F.sum("n").alias("n")).toArrow()
    tree, node, n_at = (sums.column(c).to_numpy() for c in ("tree", "node", "n"))
    times = [np.bincount(node[tree == i], n_at[tree == i], len(forest[i][0])) for i in range(len(forest))]
    return weighed(forest, times, n)


def _limit(scored: DataFrame) -> float:
    """calibrate over all rows of scored(quality, score)."""
    n = dict(scored.groupBy("quality").count().collect())
    if not n.get(1) or not n.get(0):
        return math.inf
    # A cut below all of these loses too many good rows, and one between two of them catches no more than the lower one.
    top = [r[0] for r in scored.filter("quality = 1").select("score").orderBy(F.desc("score")).limit(int(MAX_LOSS * n[1]) + 2).collect()]
    good = np.array([-1.0, *reversed(top)])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = batch.column("score")
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(good, score.to_numpy())), score], names=["place", "score"])

    bad = scored.filter("quality = 0").select("score").mapInArrow(between, "place long, score double")
    bad = bad.groupBy("place").agg(F.min("score").alias("score"), F.count("*").alias("n")).toArrow()
    return calibrate(good, bad.column("score").to_numpy(), np.r_[n[1] - len(top), np.ones(len(top), np.int64)], bad.column("n").to_numpy())


def judge(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, COUNTS, base_failed, score, kept for each row of docs. labels has doc_id and quality (1 good, 0 bad)."""
    stats = store(statistics(docs, id_col, text_col), "quality")
    fair = stats.filter(~failed_base())
    columns = [F.col("features")[i] for i in range(len(FEATURES))]
    ends = fair.agg(*(F.min(c) for c in columns), *(F.max(c) for c in columns), F.count("*")).first()
    low, high = np.array([0.0 if e is None else e for e in ends[:-1]]).reshape(2, -1)
    n = {}
    if labels is not None:
        ids = labels.filter("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().distinct()
        known = store(fair.select("doc_id", "features").join(small(ids), "doc_id"), "labelled")
        n = dict(known.groupBy("quality").count().collect())
    good = n.get(1, 0)
    placed = store(_placed(known.filter("quality = 1"), good) if good else _placed(fair, ends[-1]), "placed")
    # One half of the good rows is the forest's reference, the other half sets the threshold.
    reference = placed.filter("place % 2 = 0").withColumn("place", F.shiftright("place", 1)) if good else placed
    forest = _forest(reference, (good + 1) // 2 if good else ends[-1], low, high)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [c for c in batch.schema.names if c != "features"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, own), pa.array(scores(forest, _flat(batch)))], names=[*own, "score"])

    limit = math.inf
    if good and n.get(0):
        rows = placed.filter("place % 2 = 1").select(F.lit(1).alias("quality"), "features").union(known.filter("quality = 0").select("quality", "features"))
        marks = store(rows.mapInArrow(scored, "quality int, score double"), "marks")
        limit = _limit(marks)
        drop(marks)
    drop(placed, *([known] if labels is not None else []))
    out = stats.mapInArrow(scored, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double")
    return out.withColumn("base_failed", failed_base()).withColumn("kept", ~F.col("base_failed") & (F.col("score") <= F.lit(limit)))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *COUNTS, "base_failed", "score", "kept")
