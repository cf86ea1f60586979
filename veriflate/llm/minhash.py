"""Near-duplicate documents by one-permutation hashing.

Method: each document's set of distinct 5-word shingles is hashed once into
BINS bins; empty bins borrow from a non-empty bin chosen by a hash of (bin,
attempt) (optimal densification, Shrivastava 2017). BANDS bands of ROWS bins
give bucket keys. Within a bucket candidates are star-shaped edges from a hub
to the other members, so a bucket of n documents costs n - 1 pairs, not n^2.
Every candidate is confirmed on the full shingle sets.

A star alone could miss a link between two members of which neither is like
the hub. So each bucket has HUBS stars, and the buckets whose members still
carry more than one component label after that are played out: each member
outside the bucket's largest label meets the members with other labels, if the
sizes and bitmaps allow a link at all. A bitmap holds the parity of the shingles
that hash to each bit, with at least BITS bits a shingle: sets that differ in d
shingles differ in at most d bits, so that the bits bound the intersection from
above without loss, closely enough to rule out nearly all pairs of edited
copies that are not alike enough. After that every pair that shares a bucket is
tested, connected, or ruled out.

At similarity 0.75 a pair shares no bucket with probability
(1 - 0.75^4)^32 = 5e-6; copies of one set are collapsed to one representative
before all this, so they cost one row each.

Cases: null or empty text, or text of white space only, has an empty set
(n_shingles 0) and links with nothing; fewer than five words make one shingle
of the whole sequence; rows that share a doc_id are one node, whatever their
texts, so they share a component and link what either text is like; rows with a null doc_id get no links, a null component and are
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sums, binary_docs, drop, hashed_words, in_parts, mix, small, store, table, trimmed
from .graph import components

SHINGLE = 5
BINS = 128
ROWS = 4
BANDS = BINS // ROWS
#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 75
#: Stars of a bucket: one at its smallest id, the others at members picked by hash.
HUBS = 4
#: Rows on each side of a part of a bucket that is played out.
SIDE = 2048
#: Bits of a bitmap for each shingle, up to the next power of two.
BITS = 8
#: First attempts of densification that are tabulated; later ones are hashed.
_ATTEMPTS = 512


def shingle_sets(bodies: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each whole text."""
    words, place = hashed_words([None if b is None else b.lower() for b in bodies])
    sums, place = Sums(words), place.tolist()
    at = np.arange(max(len(words) - SHINGLE + 1, 0))
    every = sums.hashes(at, at + SHINGLE, 3)
    out = []
    for a, e in zip(place, place[1:], strict=False):
        if e - a >= SHINGLE:
            out.append(np.unique(every[a : e - SHINGLE + 1]))
        else:
            out.append(sums.hashes(np.array([a]), np.array([e]), 3) if e > a else np.empty(0, np.uint64))
    return out


def _probe(attempts: np.ndarray) -> np.ndarray:
    """Bin that (attempt, bin) borrows from."""
    x = attempts[:, None] * np.uint64(BINS) + np.arange(BINS, dtype=np.uint64)[None, :]
    return (mix(x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)) % np.uint64(BINS)).astype(np.int64)


_TABLE = _probe(np.arange(_ATTEMPTS, dtype=np.uint64))


def signature(sorted_set: np.ndarray) -> np.ndarray:
    """One value for each bin; the set must not be empty."""
    shift = np.uint64(64 - (BINS.bit_length() - 1))
    bins = (sorted_set >> shift).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    own = np.zeros(BINS, bool)
    own[bins[first]] = True
    sig = np.zeros(BINS, np.uint64)
    sig[bins[first]] = sorted_set[first]
    todo = np.flatnonzero(~own)
    start = 0
    while len(todo):
        size = 16 if start == 0 else _ATTEMPTS
        probe = _TABLE[start : start + size] if start + size <= _ATTEMPTS else _probe(np.arange(start, start + size, dtype=np.uint64))
        hit = own[probe[:, todo]]
        found = hit.any(0)
        at = hit.argmax(0)
        sig[todo[found]] = sig[probe[at[found], todo[found]]]
        todo = todo[~found]
        start += size
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    for i in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return out.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, bodies in in_parts(batch.column(1)):
            n, high, low, keys = [], [], [], []
            for found in shingle_sets(bodies):
                n.append(len(found))
                if len(found):
                    both = xxhash.xxh3_128_intdigest(found.tobytes())
                    high.append((both >> 64) - (1 << 63))
                    low.append((both & (1 << 64) - 1) - (1 << 63))
                    keys.append(bands(signature(found)))
                else:
                    high.append(None)
                    low.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(bodies)), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n", "high", "low", "bands"],
            )


def bitmap(found: np.ndarray) -> np.ndarray:
    """Parity of the shingles at each bit, as 64-bit numbers."""
    size = 1 << max(6, (BITS * len(found) - 1).bit_length())
    odd = np.bincount((mix(found) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, bodies in in_parts(batch.column(1)):
            found = shingle_sets(bodies)
            longs = [pa.array([f(x) for x in found], pa.list_(pa.int64())) for f in (lambda x: x.view(np.int64), bitmap)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(bodies)), pa.array([len(x) for x in found], pa.int64()), *longs], names=["id", "n", "items", "bits"])


def _confirmed(edges: DataFrame, sets: DataFrame, others: DataFrame) -> DataFrame:
    """others(a, b) and those of edges(a, an, b, bn) whose full sets are similar enough, as a stored table.

    The set of a is dealt out to the edges first, which then meet the sets of b. Few edges are broadcast, and sets are
    then sorted for b alone. The links are shuffled once more, so that they are a few files whatever the number of
    tasks that compared sets."""
    asked = store(edges, "edges")
    one = sets.select(F.col("id").alias("a"), F.col("n").alias("an"), F.col("items").alias("left"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("bn"), F.col("items").alias("right"))
    both = one.join(small(asked), ["a", "an"]).join(two, ["b", "bn"]).select("a", "b", F.size("left").alias("p"), F.size("right").alias("q"), F.size(F.array_intersect("left", "right")).cast("long").alias("i"))
    links = store(both.filter(f"100 * i >= {PERCENT} * (p + q - i)").select("a", "b").union(others).distinct(), "links")
    drop(asked)
    return links


def _ends(x: str, n: str, y: str, m: str) -> list[Column]:
    """The edge between two representatives with their sizes, the smaller id first."""
    swap = F.col(x) > F.col(y)
    pick = lambda p, q: F.when(swap, F.col(q)).otherwise(F.col(p))
    return [pick(x, y).alias("a"), pick(n, m).alias("an"), pick(y, x).alias("b"), pick(m, n).alias("bn")]


def _apart(x: str, y: str) -> Column:
    """Bits in which two bitmaps differ; sizes differ by a factor of two at most, the larger one is folded."""

    def count(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)

    def fold(a: Column) -> Column:
        half = (F.size(a) / 2).cast("int")
        return F.zip_with(F.slice(a, 1, half), F.slice(a, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    a, b = F.col(x), F.col(y)
    return F.when(F.size(a) == F.size(b), count(a, b)).when(F.size(a) > F.size(b), count(fold(a), b)).otherwise(count(a, fold(b)))


def _fits(p: str, q: str):
    """Sizes that can still reach the similarity."""
    return 100 * F.least(p, q) >= PERCENT * F.greatest(p, q)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    body = binary_docs(docs, id_col, text_col)
    marks = store(body.mapInArrow(trimmed(_signatures), "doc_id long, n long, high long, low long, bands array<long>"), "marks")
    # A set that only one row has is its own class; rows of the others may be most of all rows, so that their join
    # stands alone between plain tables, where Spark can split a key.
    classes = marks.filter("n > 0 and doc_id is not null").groupBy("high", "low").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
    classes = store(classes.filter("rows > 1").drop("rows"), "copies")
    rep = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("rep", "doc_id"))
    docs_in = marks.join(small(classes), ["high", "low"], "left").withColumn("rep", rep)
    docs_in = store(docs_in.select("doc_id", "n", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")), "classes")
    drop(marks, classes)
    # An id with several texts is one node: it joins the classes of all of them.
    named = docs_in.filter("rep is not null")
    several = named.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z").select(F.col("doc_id").alias("id"), "a")
    own = named.join(small(several), F.col("doc_id") == F.col("id")).select("a", F.col("rep").alias("b")).filter("a <> b").distinct()
    rows = docs_in.filter("bands is not null").select("rep", "n", F.explode("bands").alias("b"))
    shared = rows.groupBy("b").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("b")
    members = store(rows.join(shared, "b", "left_semi").distinct(), "members")
    need = members.select("rep").distinct()
    sets = store(body.join(small(need), F.col("doc_id") == F.col("rep"), "left_semi").mapInArrow(trimmed(_sets), "id long, n long, items array<long>, bits array<long>"), "sets")
    if not docs_in.filter("bands is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        sets = store(sets.dropDuplicates(["id", "n", "items"]), "sets")

    picks = [F.min_by(F.struct(F.col("rep").alias("hub"), F.col("n").alias("hub_n")), F.xxhash64("rep", F.lit(i))) for i in range(1, HUBS)]
    first = F.min(F.struct(F.col("rep").alias("hub"), F.col("n").alias("hub_n")))
    hubs = members.groupBy("b").agg(F.array_distinct(F.array(first, *picks)).alias("hubs")).select("b", F.explode("hubs").alias("h")).select("b", "h.*")
    edges = members.join(hubs, "b").filter("rep <> hub").filter(_fits("n", "hub_n")).select(*_ends("rep", "n", "hub", "hub_n")).distinct()
    links = _confirmed(edges, sets, own)
    roots = components(links)

    # Buckets with the same members are one bucket from here on.
    same = members.groupBy("b").agg(F.count("*").alias("size"), F.sum(F.xxhash64("rep", "n").cast("decimal(38,0)")).alias("sum")).filter("size > 2").groupBy("size", "sum").agg(F.min("b").alias("b")).select("b")
    named = members.join(same, "b", "left_semi").join(roots, F.col("rep") == F.col("node"), "left").select("b", "rep", "n", F.coalesce("root", "rep").alias("label"))
    sizes = named.groupBy("b", "label").agg(F.count("*").alias("size"))
    sides = [F.ceil(x / SIDE).cast("int").alias(c) for x, c in ((F.sum("size"), "sides"), (F.sum("size") - F.max("size"), "others"))]
    major = sizes.groupBy("b").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("size", "label")).alias("major"), *sides).filter("labels > 1").drop("labels")
    live = store(named.join(major, "b"), "live")
    drop(members)
    live_bits = store(live.join(sets.select("id", F.col("n").alias("set_n"), "bits"), (F.col("rep") == F.col("id")) & (F.col("n") == F.col("set_n"))).drop("id", "set_n"), "bits")
    drop(live)
    # A bucket is played in parts of SIDE times SIDE rows.
    cut = lambda of, by: F.pmod(F.xxhash64(of, F.lit(1)), F.col(by)).cast("int")
    every = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
    inner = live_bits.select("b", "rep", "n", "bits", "label", cut("rep", "sides").alias("i"), every("others").alias("j"))
    outer = live_bits.filter("label <> major").select("b", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("bits").alias("bits2"), F.col("label").alias("label2"), cut("rep", "others").alias("j"), every("sides").alias("i"))
    most = (F.col("n") + F.col("n2") - _apart("bits", "bits2")) / 2
    could = (F.col("label") != F.col("label2")) & _fits("n", "n2") & (100 * most >= PERCENT * (F.col("n") + F.col("n2") - most))
    edges = inner.join(outer, ["b", "i", "j"]).filter(could).select(*_ends("rep", "n", "rep2", "n2")).distinct()
    final = _confirmed(edges, sets, links)
    drop(links, live_bits)
    roots = components(final)
    drop(final)
    drop(sets)
    out = docs_in.select("doc_id", "n", "rep").join(small(roots), F.col("rep") == F.col("node"), "left")
    component = F.coalesce("root", "rep", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
