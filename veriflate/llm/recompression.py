"""Removal of repeated passages, found by recompression.

A window is WINDOW consecutive words of one document. A word goes if a window
that covers it has a word sequence that also starts in a document with a
smaller id; windows are judged on the input.

Recompression turns words into ever longer symbols, round by round. A symbol's
name is a hash of what it is made of, so that equal stretches get equal names
in all documents without a dictionary to agree on:

- LOW rounds name pairs: every symbol has a label from its name, and neighbours
  labelled (0, 1) become one symbol. Whether two symbols merge depends on them
  alone, so all symbols of a window that lie at least MARGIN words inside are
  the same wherever its words occur. Runs stay rows of equal symbols here, for a
  run that a window cuts would get another name in it.
- HIGH rounds go on from there and name runs (equal neighbours) and pairs in
  turn, until symbols span about twenty words.

Spark rounds then find out which symbols are shared:

1. Each window selects its interior low symbol with the least name. Selected
   symbols, with the MARGIN words on both sides, and high symbols, with the
   WINDOW - 1 words behind them, are sent to buckets by their names. A bucket
   answers for each name whether other documents have it, and whether one with
   a smaller id has. All windows that start in a high symbol which a smaller
   document shares are verified at once: long repeats never show up as windows.
2. What is left of a long repeat are its ends, and its first holder. A window
   whose selected symbols are shared, and that no high symbol verified, is
   sent by the hash of its words, and the smallest document of each is found.
3. Documents drop the words that verified or repeated windows cover.

Texts travel in blocks (about BLOCK bytes; a longer text is one of its own) of
groups (about GROUP bytes). A group sends each name once, however many of its
documents have it, packed in one binary row a bucket; a bucket answers in bits,
in the order in which it was asked. So a name that most documents share
costs one entry a group, and no answer holds a text. A task
holds one group's hashes or one bucket (about BUCKET names). Names of windows
and high symbols have 64 bits; those of low symbols are only a filter.

Cases: a null text has no words; documents with fewer words than a window lose
none; rows with a null doc_id neither lose words nor take any; rows that share
a doc_id are parts of one document; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sums, binary_docs, drop, hashed_words, mix, store_split, table, trimmed, trimmed_group

WINDOW = 13
LOW = 2
HIGH = 8
MARGIN = 2
#: Bytes of text that are parsed at a time, and that ask together.
BLOCK, GROUP = 1_000_000, 8_000_000
#: Names in a bucket, about; and names for each byte of text, about.
BUCKET, PER_BYTE = 500_000, 0.05
#: Windows that start in a high symbol which is worth a name.
WORTH = 4
#: Words of the longest low symbol; words at which a symbol of that length, seen by a window, can begin.
LONGEST = 1 << LOW
WIDE = WINDOW - 2 * MARGIN - LONGEST + 1
_NONE = np.uint64(2**64 - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _labels(names: np.ndarray, r: int) -> np.ndarray:
    return (mix(names + np.uint64(77_777 * r + 1)) >> np.uint64(33)) & np.uint64(1)


def name_pairs(names: np.ndarray, start: np.ndarray, first: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """One round of pairs; first marks words that begin a document (nothing merges across them)."""
    label = _labels(names, r)
    pair = (label[:-1] == 0) & (label[1:] == 1) & ~first[start[1:]]
    at = np.flatnonzero(pair)
    merged = names.copy()
    merged[at] = mix(names[at] * _STEP + names[at + 1])
    keep = np.ones(len(names), bool)
    keep[at + 1] = False
    return merged[keep], start[keep]


def name_runs(names: np.ndarray, start: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of equal symbols becomes one, named by what it repeats and how often."""
    head = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | first[start[1:]]])
    times = np.diff(np.r_[head, len(names)])
    out = names[head]
    runs = np.flatnonzero(times > 1)
    out[runs] = mix(out[runs] * _STEP + times[runs].astype(np.uint64) + np.uint64(1))
    return out, start[head]


def _least(x: np.ndarray) -> np.ndarray:
    """Least of each WIDE values that follow one another."""
    out, width = x, 1
    while 2 * width <= WIDE:
        out, width = np.minimum(out[:-width], out[width:]), 2 * width
    rest = WIDE - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Block:
    """Hashes and symbols of some documents one after the other."""

    def __init__(self, texts: list[bytes]) -> None:
        self.hash, place = hashed_words(texts)
        self.begin, self.end = place[:-1], place[1:]
        self.size = n = len(self.hash)
        self.doc = np.repeat(np.arange(len(texts)), self.end - self.begin)
        #: Words at which a window starts.
        self.starts = np.arange(n) + WINDOW <= self.end[self.doc]
        self.sums = Sums(self.hash)

    def windows(self, at: np.ndarray) -> np.ndarray:
        return self.sums.hashes(at, at + WINDOW, 5)

    def symbols(self) -> None:
        """low_begin, low_end, low_name of the selected low symbols with their margins; high_begin, high_end, high_name
        of the high symbols with what is behind them."""
        n = self.size
        empty = np.empty(0, np.int64)
        if n < WINDOW:
            self.low_begin = self.low_end = self.high_begin = self.high_end = empty
            self.low_name = self.high_name = self.low_value = empty.astype(np.uint64)
            return
        first = np.zeros(n, bool)
        first[self.begin[self.end > self.begin]] = True
        names, start = self.hash, np.arange(n)
        for r in range(LOW):
            names, start = name_pairs(names, start, first, r)
        self._select(names, start)
        for r in range(LOW, LOW + HIGH):
            names, start = name_runs(names, start, first)
            names, start = name_pairs(names, start, first, r)
        # Windows that start in a symbol begin before this word.
        upto = np.minimum(np.r_[start[1:], n], self.end[self.doc[start]] - WINDOW + 1)
        worth = upto - start >= WORTH
        self.high_begin, self.high_end = start[worth], upto[worth]
        self.high_name = self.sums.hashes(self.high_begin, self.high_end + WINDOW - 1, 6)

    def _seen(self, start: np.ndarray, size: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The least value, for each word at which a window may start, of the symbols that the window sees: those that
        begin MARGIN words inside and end MARGIN words before its end."""
        by_start = np.full(self.size + LONGEST, _NONE)
        by_start[start] = value
        least = _least(by_start[MARGIN : MARGIN + self.count + WIDE - 1])
        for k in range(LONGEST - 1, 0, -1):
            by_start[start[size > k]] = _NONE
            np.minimum(least, by_start[WINDOW - MARGIN - k :][: self.count], out=least)
        return least

    def _select(self, names: np.ndarray, start: np.ndarray) -> None:
        n = self.size
        self.count = n - WINDOW + 1
        size, value = np.diff(np.r_[start, n]), mix(names)
        self.least = least = self._seen(start, size, value)
        # A symbol is selected if a window that sees it has no lesser one: the least values, turned over.
        over = np.full(n + WINDOW, _NONE)
        over[WINDOW : WINDOW + self.count] = np.where(self.starts[: self.count], ~least, _NONE)
        most = _least(over[WINDOW - MARGIN - WIDE + 1 : WINDOW - MARGIN + n])[start]
        for k in range(LONGEST - 1, 0, -1):
            own = np.flatnonzero(size <= k)
            most[own] = np.minimum(most[own], over[start[own] + MARGIN + k])
        chosen = (~most == value) & (most != _NONE)
        self.low_value = value[chosen]
        self.low_begin = start[chosen] - MARGIN
        self.low_end = start[chosen] + size[chosen] + MARGIN
        self.low_name = self.sums.hashes(self.low_begin, self.low_end, 7) >> np.uint64(1)

    def without(self, lone: np.ndarray) -> np.ndarray:
        """Words at which a window starts that selects none of the marked low symbols."""
        begin, end = self.low_begin[lone], self.low_end[lone]
        out = self.starts.copy()
        out[: self.count] &= self._seen(begin + MARGIN, end - begin - 2 * MARGIN, self.low_value[lone]) != self.least
        return out


class Asked:
    """The distinct names of a group, with the smallest document of each, in the order in which buckets get them."""

    def __init__(self, names: list[np.ndarray], docs: list[np.ndarray], buckets: int) -> None:
        name, doc = np.concatenate(names or [np.empty(0, np.uint64)]), np.concatenate(docs or [np.empty(0, np.int64)])
        order = np.argsort(name)
        name, doc = name[order], doc[order]
        first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]]) if len(name) else np.empty(0, np.int64)
        self.name = name[first]
        self.low = np.minimum.reduceat(doc, first) if len(first) else first
        many = (np.maximum.reduceat(doc, first) if len(first) else first) != self.low
        bucket = (mix(self.name) % np.uint64(buckets)).astype(np.int64)
        self.order = np.lexsort((self.low, bucket))
        self.many = many[self.order]
        used, begin = np.unique(bucket[self.order], return_index=True)
        self.parts = list(zip(used.tolist(), begin.tolist(), [*begin.tolist()[1:], len(bucket)], strict=True))

    def rows(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, packed names)."""
        names, low = self.name[self.order], self.low[self.order]
        for bucket, a, b in self.parts:
            doc = low[a:b]
            head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            docs = pa.compress(np.diff(np.r_[0, doc[head]]).tobytes() + np.diff(np.r_[head, b - a]).astype(np.int32).tobytes(), codec="zstd", asbytes=True)
            yield bucket, np.array([b - a, len(head)], np.int64).tobytes() + names[a:b].tobytes() + np.packbits(self.many[a:b]).tobytes() + docs

    def read(self, answers: dict[int, bytes]) -> None:
        """shared and smaller: whether other documents have a name, and whether one with a smaller id than low has."""
        self.shared, self.smaller = np.zeros(len(self.name), bool), np.zeros(len(self.name), bool)
        for bucket, a, b in self.parts:
            bits = np.unpackbits(np.frombuffer(answers[bucket], np.uint8).reshape(2, -1), axis=1, count=b - a).astype(bool)
            self.shared[self.order[a:b]], self.smaller[self.order[a:b]] = bits

    def earlier(self, names: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Whether a document with a smaller id has the name, for each name and document."""
        at = np.searchsorted(self.name, names)
        return self.smaller[at] | (docs > self.low[at])


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, k = np.frombuffer(data, np.int64, 2).tolist()
    names = np.frombuffer(data, np.uint64, n, 16)
    bits = -(-n // 8)
    many = np.unpackbits(np.frombuffer(data, np.uint8, bits, 16 + 8 * n), count=n).astype(bool)
    docs = pa.decompress(data[16 + 8 * n + bits :], 12 * k, codec="zstd", asbytes=True)
    return names, np.repeat(np.cumsum(np.frombuffer(docs, np.int64, k)), np.frombuffer(docs, np.int32, k, 8 * k)), many


def _answered(group: pa.Table) -> pa.Table:
    """One bucket: two bits for each name of each group."""
    parts = [_unpacked(d.as_py()) for d in group.column("data")]
    name, doc, many = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(name)
    name = name[order]
    first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
    times = np.diff(np.r_[first, len(name)])
    doc = doc[order]
    low = np.minimum.reduceat(doc, first)
    both = (np.maximum.reduceat(doc, first) > low) | np.logical_or.reduceat(many[order], first)
    shared, smaller = np.empty(len(name), bool), np.empty(len(name), bool)
    shared[order], smaller[order] = np.repeat(both, times), np.repeat(low, times) < doc
    out, at = [], 0
    for part in parts:
        here = slice(at, at + len(part[0]))
        at = here.stop
        out.append(np.packbits(np.array([shared[here], smaller[here]]), axis=1).tobytes())
    return pa.table({"part": group.column("part"), "bucket": group.column("bucket"), "data": pa.array(out, pa.binary())})


#: kind 0: a block of texts; kind 1: names for a bucket; kind 2: a document of the result.
_ROWS = "kind int, part long, bucket int, ids array<long>, sizes array<long>, data binary, marks binary, doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary(), "string": pa.string()}
_SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in _ROWS.split(", ")])


def _rows(kind: int, n: int, **columns) -> pa.RecordBatch:
    columns["kind"] = [kind] * n
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _asks(part: int, asked: Asked) -> Iterator[pa.RecordBatch]:
    for bucket, data in asked.rows():
        yield _rows(1, 1, part=[part], bucket=[bucket], data=[data])


def _packed(part: int, ids: list, texts: list[bytes], marks: bytes | None = None) -> pa.RecordBatch:
    data = pa.Codec("zstd", compression_level=3).compress(b"".join(texts), asbytes=True)
    return _rows(0, 1, part=[part], ids=[ids], sizes=[[len(t) for t in texts]], data=[data], marks=[marks])


def _texts(row: dict) -> list[bytes]:
    end = np.cumsum(row["sizes"]).tolist()
    data = pa.decompress(row["data"], end[-1], codec="zstd", asbytes=True)
    return [data[a:b] for a, b in zip([0, *end], end, strict=False)]


def _done(ids: list, texts: list[bytes], gone: list[np.ndarray], keep: bool) -> pa.RecordBatch:
    """Rows of the result; gone marks each document's words that go. With keep, the words that stay are in it."""
    kept, removed = [], [int(g.sum()) for g in gone]
    for text, g, n in zip(texts, gone, removed, strict=True):
        words = text.split()
        kept.append(b" ".join(compress(words, (~g).tolist()) if n else words))
    return _rows(
        2, len(ids), doc_id=ids, n_words=[len(g) for g in gone], n_removed=removed,
        kept_sha256=[hashlib.sha256(k).hexdigest() for k in kept], kept=kept if keep else [None] * len(kept),
    )


def _covered(starts: np.ndarray) -> np.ndarray:
    """Words that windows at the marked starts cover, starts being one for each word."""
    edge = np.zeros(len(starts) + WINDOW, np.int32)
    edge[: len(starts)] += starts
    edge[WINDOW:] -= starts
    return np.cumsum(edge[: len(starts)]) > 0


def _docs_of(ids: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids as numbers, and which of them are null."""
    null = np.array([i is None for i in ids], bool)
    return np.array([0 if i is None else i for i in ids], np.int64), null


class Named:
    """A block with what it asks about: its low and high symbols, and each one's document."""

    def __init__(self, ids: list, texts: list[bytes]) -> None:
        self.ids, self.null = _docs_of(ids)
        self.block = block = Block(texts)
        block.symbols()
        if self.null.any() and block.size >= WINDOW:
            own = ~self.null[block.doc]
            block.starts &= own
            for kind in ("low", "high"):
                keep = own[getattr(block, kind + "_begin")]
                for part in ("_begin", "_end", "_name", *(("_value",) if kind == "low" else ())):
                    setattr(block, kind + part, getattr(block, kind + part)[keep])
        self.names = np.r_[block.low_name, block.high_name]
        self.docs = self.ids[block.doc[np.r_[block.low_begin, block.high_begin]]]

    def windows(self, asked: Asked) -> tuple[np.ndarray, np.ndarray]:
        """By word: whether a window there is verified to be repeated, and whether it has to be asked about."""
        block = self.block
        if block.size < WINDOW:
            none = np.zeros(block.size, bool)
            return none, none
        live = block.without(~asked.shared[np.searchsorted(asked.name, block.low_name)])
        sure = asked.earlier(block.high_name, self.docs[len(block.low_name) :])
        edge = np.zeros(block.size + 1, np.int32)
        edge[block.high_begin[sure]] += 1
        edge[block.high_end[sure]] -= 1
        verified = np.cumsum(edge)[:-1] > 0
        return verified, live & ~verified


def _named(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 40
        ids, texts, size, total, names, docs = [], [], 0, 0, [], []

        def block() -> pa.RecordBatch:
            named = Named(ids, texts)
            names.append(named.names)
            docs.append(named.docs)
            return _packed(part, ids, texts)

        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = body.as_py() or b""
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= BLOCK:
                    yield block()
                    ids, texts, size, total = [], [], 0, total + size
                if total >= GROUP:
                    yield from _asks(part, Asked(names, docs, buckets))
                    names, docs, total, part = [], [], 0, part + 1
        if ids:
            yield block()
        if names:
            yield from _asks(part, Asked(names, docs, buckets))

    return run


def _by_bucket(answers: pa.Table) -> dict[int, bytes]:
    return dict(zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True))


def _windows(buckets: int, keep: bool) -> Callable:
    """Answers about symbols -> documents that are done, and the windows that the others ask about."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out, names, docs = [], [], []
        rows = blocks.to_pylist()
        named = [Named(r["ids"], _texts(r)) for r in rows]
        asked = Asked([x.names for x in named], [x.docs for x in named], buckets)
        asked.read(_by_bucket(answers))
        part = rows[0]["part"]
        for row, own in zip(rows, named, strict=True):
            texts, block = _texts(row), own.block
            verified, open_ = own.windows(asked)
            # Documents that ask, and those that are done.
            ask = np.zeros(len(texts), bool)
            ask[block.doc[open_]] = True
            gone = _covered(verified)
            at = np.flatnonzero(open_)
            names.append(block.windows(at))
            docs.append(own.ids[block.doc[at]])
            cut = [gone[a:b] for a, b in zip(block.begin, block.end, strict=True)]
            rest = np.flatnonzero(~ask)
            if len(rest):
                out.append(_done([row["ids"][i] for i in rest], [texts[i] for i in rest], [cut[i] for i in rest], keep))
            some = np.flatnonzero(ask)
            if len(some):
                words = ask[block.doc]
                marks = np.packbits(np.array([verified[words], open_[words]])).tobytes()
                out.append(_packed(part, [row["ids"][i] for i in some], [texts[i] for i in some], pa.compress(marks, codec="zstd", asbytes=True)))
        if sum(map(len, names)):
            out.extend(_asks(part, Asked(names, docs, buckets)))
        return pa.Table.from_batches(out, _SCHEMA)

    return run


def _removed(buckets: int, keep: bool) -> Callable:
    """Answers about windows -> the documents that asked."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        held = []
        for row in blocks.to_pylist():
            block = Block(_texts(row))
            n = block.size
            marks = np.frombuffer(pa.decompress(row["marks"], -(-2 * n // 8), codec="zstd", asbytes=True), np.uint8)
            verified, open_ = np.unpackbits(marks, count=2 * n).astype(bool).reshape(2, n)
            at = np.flatnonzero(open_)
            held.append((row, block.begin, block.end, verified, at, block.windows(at), _docs_of(row["ids"])[0][block.doc[at]]))
        asked = Asked([h[5] for h in held], [h[6] for h in held], buckets)
        asked.read(_by_bucket(answers))
        out = []
        for row, begin, end, lost, at, names, docs in held:
            lost[at] = asked.earlier(names, docs)
            gone = _covered(lost)
            out.append(_done(row["ids"], _texts(row), [gone[a:b] for a, b in zip(begin, end, strict=True)], keep))
        return pa.Table.from_batches(out, _SCHEMA)

    return run


def _answers(asks: DataFrame) -> DataFrame:
    return asks.groupBy("bucket").applyInArrow(_answered, "part long, bucket int, data binary")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (with texts) kept, the words that stay joined by one space."""
    body = binary_docs(docs, id_col, text_col)
    size = body.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = max(32, int(size * PER_BYTE / BUCKET))
    blocks, asks, _ = store_split(body.mapInArrow(trimmed(_named(buckets)), _ROWS), "names", "kind", 3)
    texts_of = lambda df: df.select("part", "ids", "sizes", "data", "marks").groupBy("part")
    names_of = lambda df: df.select("part", "bucket", "data")
    replies = _answers(names_of(asks)).groupBy("part")
    again, windows, done = store_split(texts_of(blocks).cogroup(replies).applyInArrow(trimmed_group(_windows(buckets, texts)), _ROWS), "windows", "kind", 3)
    drop(blocks, asks)
    replies = _answers(names_of(windows)).groupBy("part")
    rest = texts_of(again).cogroup(replies).applyInArrow(trimmed_group(_removed(buckets, texts)), _ROWS)
    cols = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    if texts:
        cols.append(F.col("kept").cast("string").alias("kept"))
    return done.select(*cols).union(rest.select(*cols))


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), texts=False)
