"""Near-duplicate vectors by collision counting on sorted projections.

Every vector is projected on many random lines. On each line the vectors are
sorted, and a window centred at each vector holds those within its reach. A
pair's collisions are counted over all lines, and pairs that collide at least
NEED times are verified by cosine in double precision.

A window alone holds a fixed share of all vectors: one line tells pairs at the
threshold from others by a factor of 4.5 at most, however narrow its window. So
each line is dealt into cells by the signs of further random products: 2^bits
cells, bits growing with the logarithm of the number of vectors, and only
vectors of one cell meet on that line. The number of lines is the least that
gives a pair at the threshold NEED collisions with probability 1 - MISS
(calibrated from the two collision probabilities, both exact for Gaussian
lines). Where that would be more than LINES lines, cells are fewer and larger
instead, so that the recall is the same at every size.

A vector's places on all lines (16 bits each, in units of 1 / UNITS of the
reach) and cells are worked out once and travel with it, so that all tasks
agree on each collision. Vectors of the same direction (bit for bit after
scaling) are one representative with a count. Cells above CHUNK rows are cut
into chunks and played chunk against chunk, TILE by TILE rows at a time, so no
task holds more than two chunks. A pair is counted where it collides first, so
each link counts once; a task returns one row per vector (its links and the
smallest vector that it reaches there), never pairs.

Cases: vectors that are null, empty or zero, or hold null or non-finite
components, link with nothing and are kept; vectors of different lengths link
with nothing; repeated rows are vectors of their own with the same id; rows
with a null id have no component; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, small, store, table
from .graph import components

COSINE = 0.95
CELL = 256
CHUNK = 2048
NEED = 3
MISS = 1e-5
LINES = 256
#: Share of pairs at the threshold that lie in one window, and the window's reach in standard deviations of their distance.
INSIDE, DEVIATIONS = 0.95, 1.96
UNITS = 64
TILE = 512
SEED = 7


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, raws, dims = [], [], []
        for v in batch.column(1):
            x = None
            if v.is_valid and len(v.values) and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                x = x if np.isfinite(x).all() and x.any() else None
            if x is None:
                keys.append(None)
                raws.append(None)
                dims.append(0)
                continue
            scaled = x / np.abs(x).max()
            keys.append(hashlib.blake2b((scaled / np.sqrt(scaled @ scaled)).tobytes(), digest_size=16).digest())
            low = x.astype(np.float32)
            raws.append(low.tobytes() if (low == x).all() else x.tobytes())
            dims.append(len(x))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(raws, pa.binary()), pa.array(dims, pa.int32())], names=["vec_id", "key", "raw", "dim"])


class Lines:
    """The random lines and sign products for vectors of one length."""

    def __init__(self, dim: int, bits: int, lines: int) -> None:
        self.bits, self.lines = bits, lines
        self.line = np.random.default_rng([SEED, dim]).standard_normal((dim, lines))
        self.planes = np.random.default_rng([SEED, dim, bits]).standard_normal((lines * bits, dim)).T

    def places(self, unit: np.ndarray) -> np.ndarray:
        """Places in units, a row for each vector."""
        return np.clip(np.floor((unit @ self.line) * (UNITS / REACH)), -(1 << 14), 1 << 14).astype(np.int16)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros((len(unit), self.lines), np.int64)
        signs = (unit @ self.planes > 0).reshape(len(unit), self.lines, self.bits)
        return signs.astype(np.int64) @ (1 << np.arange(self.bits, dtype=np.int64))


#: Reach of a window: places that are cut to units can be one unit further apart.
REACH = DEVIATIONS * math.sqrt(2 - 2 * COSINE)
NEAR = UNITS + 1


def calibrate(n: int) -> tuple[int, int]:
    """(bits, lines) for n vectors."""
    for bits in range(max(0, math.ceil(math.log2(max(n, 1) / CELL))), -1, -1):
        p = INSIDE * (1 - math.acos(COSINE) / math.pi) ** bits
        for lines in range(NEED, LINES + 1):
            if sum(math.comb(lines, i) * p**i * (1 - p) ** (lines - i) for i in range(NEED)) <= MISS:
                return bits, lines
    raise ValueError("no number of lines reaches the recall")


def _unit(raw: Iterable[bytes], dim: int) -> np.ndarray:
    rows = [np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64).astype(np.float64) for r in raw]
    x = np.array(rows).reshape(len(rows), dim)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position that each position reaches."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new != new[new]).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            break
        root = new
    return root


def cell_links(unit: np.ndarray, count: np.ndarray, side: np.ndarray | None, places: np.ndarray, marks: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """(links, roots) of the vectors of one cell of line at, vectors sorted by
    id; places and marks have a row a line. With sides, only pairs of different
    sides meet."""
    n = len(unit)
    order = np.argsort(places[at], kind="stable")
    places, marks = np.ascontiguousarray(places[:, order]), np.ascontiguousarray(marks[:, order])
    own = places[at]
    last = np.searchsorted(own, own + np.int16(NEAR), "right")
    links, firsts, seconds = np.zeros(n, np.int64), [], []
    for i in range(0, n, TILE):
        rows = slice(i, min(i + TILE, n))
        for j in range(i, int(last[rows.stop - 1]), TILE):
            cols = slice(j, min(j + TILE, n))

            def met(t: int, rows: slice = rows, cols: slice = cols) -> np.ndarray:
                near = np.abs(places[t, rows, None] - places[t, None, cols]) <= NEAR
                return near if t == at else near & (marks[t, rows, None] == marks[t, None, cols])

            hits = met(at).astype(np.uint16)
            if i == j:
                hits[np.tril_indices(len(hits), 0, hits.shape[1])] = 0
            if side is not None:
                hits[side[order[rows], None] == side[None, order[cols]]] = 0
            for t in range(at):  # pairs that meet there are counted there
                hits[met(t)] = 0
            for t in range(at + 1, len(places) if hits.any() else 0):
                hits += met(t) & (hits > 0)
            a, b = np.nonzero(hits >= NEED)
            a, b = order[a + i], order[b + j]
            near = np.einsum("ij,ij->i", unit[a], unit[b]) >= COSINE
            a, b = a[near], b[near]
            np.add.at(links, a, count[b])
            np.add.at(links, b, count[a])
            firsts.append(a)
            seconds.append(b)
    none = np.empty(0, np.int64)
    return links, _roots(n, np.concatenate([none, *firsts]), np.concatenate([none, *seconds]))


def _coder(bits: int, lines: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Lines] = {}
        for batch in batches:
            n, raws, dims = batch.num_rows, batch.column(2).to_pylist(), batch.column(3).to_numpy(zero_copy_only=False)
            cells, places = np.empty((n, lines), np.int64), np.empty((n, lines), np.int16)
            for dim in np.unique(dims).tolist():
                if dim not in made:
                    made[dim] = Lines(dim, bits, lines)
                own = np.flatnonzero(dims == dim)
                unit = _unit([raws[i] for i in own], dim)
                cells[own], places[own] = made[dim].cells(unit), made[dim].places(unit)
            # 16 bits of a cell tell nearly all others apart; a pair that they do not is verified like any other.
            marks = (cells.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16)
            rows = pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), lines).cast(pa.list_(pa.int64()))
            columns = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (places, marks)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), rows, *columns], names=["rep", "count", "raw", "dim", "cells", "places", "marks"])

    return run


def _player(lines: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, at = int(pdf["dim"].iloc[0]), int(pdf["line"].iloc[0])
        pdf = pdf.sort_values("rep")
        side = (pdf["mine"] == pdf["low"]).to_numpy() if pdf["low"].iloc[0] != pdf["high"].iloc[0] else None
        places, marks = (np.frombuffer(b"".join(pdf[c]), t).reshape(-1, lines).T for c, t in (("places", np.int16), ("marks", np.uint16)))
        links, roots = cell_links(_unit(pdf["raw"], dim), pdf["count"].to_numpy(), side, places, marks, at)
        rep = pdf["rep"].to_numpy()
        out = pd.DataFrame({"rep": rep, "links": links, "root": rep[roots]})
        return out[out["links"] > 0]

    return run


def near_vectors(table_: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of table_: vec_id, n_links, component_id, kept."""
    raw = table_.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    vectors = store(raw.mapInArrow(_vectors, "vec_id long, key binary, raw binary, dim int"), "vectors")
    good = vectors.filter("key is not null and vec_id is not null")
    reps = good.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("count"), F.min_by("raw", "vec_id").alias("raw"), F.min("dim").alias("dim"))
    reps = store(reps, "reps")
    bits, lines = calibrate(reps.count())
    coded = store(reps.select("rep", "count", "raw", "dim").mapInArrow(_coder(bits, lines), "rep long, count long, raw binary, dim int, cells array<long>, places binary, marks binary"), "coded")
    payload = ("rep", "count", "raw", "dim", "places", "marks")
    rows = coded.select(*payload, F.posexplode("cells").alias("line", "cell"))
    cells = coded.select("dim", F.posexplode("cells").alias("line", "cell")).groupBy("dim", "line", "cell").count()
    large = store(cells.filter(F.col("count") > CHUNK).select("dim", "line", "cell", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")), "large")
    rows = rows.join(small(large), ["dim", "line", "cell"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("rep", "line"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))
    found = rows.select(*payload, "line", "cell", "mine", "low", "high").groupBy("dim", "line", "cell", "low", "high").applyInPandas(_player(lines), "rep long, links long, root long")
    found = store(found, "links")
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    per = reps.join(sums, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    per = store(per.select("key", (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("n"), F.coalesce("root", "rep").alias("c")), "per")
    drop(coded, large, found)
    out = vectors.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(per, "key", "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
