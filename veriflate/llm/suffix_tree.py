"""Language-model scoring with a probabilistic suffix tree.

A text is its lower-cased words, each with a space, and an end mark. The tree's
contexts are up to DEPTH bytes of what was written before. A context is
retained if it occurs at least LEAST times in training and its next-symbol
distribution differs from that of its longest retained suffix by at least GAIN
nats in all (count times divergence). A context's distribution is smoothed with
its suffix's by Witten and Bell's rule, the root's with a uniform one.

The frequent part of the tree (contexts with at least SHARE of all training
positions) is turned into an automaton (prefixes of contexts are states with
their suffix's distribution), so that the longest suffix state of every
position is known after one table step; texts are cut into pieces that overlap
by DEPTH bytes and stepped side by side. Where the DEPTH bytes before a
position are not that frequent, the position's own probability is looked up.
It is found for every DEPTH + 1 bytes that occur in any document, from the same
counts by the same rules, in groups by the last two bytes of the context. The CODES most frequent
of these are broadcast; documents are put in blocks, and each block asks
once for each of the others.

A word's probability is the even mixture of the tree's (its bytes and the
space) and the smoothed word frequency that also makes the base score.

Counts cover all training documents. SHARE bounds the contexts of the automaton
by DEPTH / SHARE and its table by that times the alphabet, so it may be
broadcast; like CODES it decides only where a probability is looked up, not
what is scored. HOT bounds the words that are broadcast by 1 / HOT. All other contexts and the
occurrences of all other words are joined in shuffles: nothing is dropped.

Cases: a null or empty text is the end mark alone; rows with a null doc_id are
training rows; repeated rows count and score as often as they come; without
training rows all counts are 0 and the tree is uniform; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_docs, drop, hashed_words, mix, store, table, trimmed, trimmed_group

#: At most 6, so that DEPTH + 1 bytes are a positive number of 64 bits.
DEPTH = 6
#: Training positions that a retained context has at least.
LEAST = 20
SHARE = 2e-5
GAIN = 20.0
HOT = 1e-7
SMOOTH = 0.1
MIX = 0.5
#: Probabilities that are broadcast at most.
CODES = 3_000_000
#: Slots, as powers of two, of the tables of frequent contexts and of broadcast probabilities.
SLOTS, CODE_SLOTS = 19, 22
#: Bytes of text that a worker parses at a time, and that one piece steps through.
BLOCK, PIECE = 800_000, 256
#: Positions whose probabilities are looked for at a time.
STEP = 100_000
#: Blocks that ask together.
TOGETHER = 12
#: Partial counts that a worker holds before it writes them out.
HELD = 900_000
#: Counts that are sent on together.
SENT = 200_000
_END = b"\n"


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of some documents: lower-cased words, joined by one space."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            texts.append(b" ".join((body.as_py() or b"").lower().split()))
            ids.append(doc_id)
            size += len(texts[-1])
            if size >= BLOCK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


class Stream:
    """Documents one after the other, each after DEPTH end marks."""

    def __init__(self, texts: list[bytes]) -> None:
        pad = _END * DEPTH
        parts = [pad + t + b" " + _END if t else pad + _END for t in texts]
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        size = np.array([len(x) for x in parts], np.int64)
        #: Behind each space a token begins, and behind the end marks that lead a document.
        self.token = np.flatnonzero(self.bytes == 32) + 1
        first = np.cumsum(size) - size + DEPTH
        place = np.searchsorted(self.token, first)
        self.token = np.insert(self.token, place, first)
        self.first = place + np.arange(len(texts))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(np.r_[self.first, len(self.token)]))

    def predicted(self) -> np.ndarray:
        """Whether each byte belongs to a token."""
        real = np.ones(len(self.bytes), bool)
        start = self.token[self.first]
        for i in range(1, DEPTH + 1):
            real[start - i] = False
        return real


def codes(stream: Stream, begin: int = 0, end: int | None = None) -> np.ndarray:
    """The last DEPTH + 1 bytes at each position, or at those from begin to end, as a number."""
    first = max(begin - DEPTH, 0)
    raw = stream.bytes[first:end]
    code = np.zeros(len(raw), np.uint64)
    own = code[DEPTH:]
    for i in range(DEPTH + 1):
        own <<= np.uint64(8)
        own |= raw[i : i + len(own)]
    return code[begin - first :]


def _slots(keys: np.ndarray, bits: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    out = keys * np.uint64(factor)
    out >>= np.uint64(64 - bits)
    return out.view(np.int64)


def frequent_table(contexts: np.ndarray) -> np.ndarray:
    """Contexts of DEPTH bytes in slots. One that loses its slot to another is looked up, with the same result."""
    out = np.full(1 << SLOTS, np.iinfo(np.uint64).max, np.uint64)
    out[_slots(contexts, SLOTS)] = contexts
    return out


_SECOND = 0xD6E8FEB86659FD93


def code_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys, rarest first, in one of two slots each. One that loses both is asked for, with the same result."""
    free = np.iinfo(np.uint64).max
    held, out = np.full(1 << CODE_SLOTS, free, np.uint64), np.zeros(1 << CODE_SLOTS, np.float32)
    spot = _slots(keys, CODE_SLOTS)
    held[spot], out[spot] = keys, values
    lost = held[spot] != keys
    keys, values = keys[lost], values[lost]
    spot = _slots(keys, CODE_SLOTS, _SECOND)
    empty = held[spot] == free
    keys, values, spot = keys[empty], values[empty], spot[empty]
    # Where several go to one slot, the key and the value must be of the same one.
    spot, last = np.unique(spot[::-1], return_index=True)
    held[spot], out[spot] = keys[::-1][last], values[::-1][last]
    return held, out


def looked_up(code: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The value of each code, NaN for one that the table lacks."""
    held, values = table
    spot = _slots(code, CODE_SLOTS)
    out = np.where(held[spot] == code, values[spot], np.float32(np.nan))
    miss = np.flatnonzero(np.isnan(out))
    spot = _slots(code[miss], CODE_SLOTS, _SECOND)
    out[miss] = np.where(held[spot] == code[miss], values[spot], np.float32(np.nan))
    return out


def rare(stream: Stream, frequent: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The predicted positions whose DEPTH bytes are not frequent, STEP positions at a time: places, codes, and the
    values that are broadcast (NaN: none)."""
    real = stream.predicted()
    for a in range(0, len(real), STEP):
        code = codes(stream, a, a + STEP)
        context = code >> np.uint64(8)
        own = np.flatnonzero(real[a : a + STEP] & (frequent[_slots(context, SLOTS)] != context))
        yield a + own, code[own], looked_up(code[own], often)


#: The end of a text as a token; no word has this hash on purpose.
_END_HASH = mix(np.array([10], np.uint64))[0]


def token_hashes(texts: list[bytes]) -> np.ndarray:
    """The words and the end of each text."""
    words, place = hashed_words(texts)
    return np.insert(words, place[1:], _END_HASH)


class _Sums:
    """Counts by 64-bit key, merged now and then."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, times: int = 1) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(n * int(times))
        self.size += len(k)
        if self.size > 2 * HELD:
            self.merge()

    def merge(self) -> None:
        if len(self.keys) > 1:
            keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            self.keys, self.counts = [keys[first]], [np.add.reduceat(counts, first)]
            self.size = len(first)

    def flush(self, kind: int) -> Iterator[pa.RecordBatch]:
        self.merge()
        for keys, counts in zip(self.keys, self.counts, strict=True):
            for i in range(0, len(keys), SENT):
                k, n = keys[i : i + SENT], counts[i : i + SENT]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])
        self.keys, self.counts, self.size = [], [], 0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: word hashes, kind 1: DEPTH + 1 bytes as a number; a held-out document's bytes come with a count of 0."""
    sums = (_Sums(), _Sums())
    for ids, texts in _blocks(batches):
        train = [i is None or zlib.crc32(b"%d" % i) % 10 != 0 for i in ids]
        for own in (True, False):
            docs = [x for x, t in zip(texts, train, strict=True) if t == own]
            if docs:
                if own:
                    sums[0].add(token_hashes(docs))
                stream = Stream(docs)
                sums[1].add(codes(stream)[stream.predicted()], own)
        for kind, s in enumerate(sums):
            if s.size > HELD:
                s.merge()
                if s.size > HELD:
                    yield from s.flush(kind)
    for kind, s in enumerate(sums):
        yield from s.flush(kind)


class Tree:
    """Automaton: next state and log10 probability by state and symbol."""

    def __init__(self, rows: list[np.ndarray], counts: list[np.ndarray]) -> None:
        """rows[j]: contexts of j bytes and the next byte as numbers, sorted; of contexts with enough positions only."""
        flat = np.full(256, 1 / 256)
        dists: list[dict[int, np.ndarray]] = []
        ends = [(1 << 8 * j) - 1 for j in range(DEPTH + 1)]

        def longest(context: int, upto: int, of: list[dict]) -> tuple[int, int]:
            return next(((j, context & ends[j]) for j in range(upto, -1, -1) if (context & ends[j]) in of[j]), (-1, 0))

        for j in range(DEPTH + 1):
            own: dict[int, np.ndarray] = {}
            context, symbol = rows[j] >> 8, (rows[j] & 255).astype(np.int64)
            first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(context) else np.empty(0, np.int64)
            for a, b in zip(first, np.r_[first[1:], len(context)][: len(first)], strict=True):
                at, c = int(context[a]), counts[j][a:b].astype(float)
                i, short = longest(at, j - 1, dists)
                parent = flat if i < 0 else dists[i][short]
                n, kinds, seen = c.sum(), b - a, symbol[a:b]
                if j and n * ((c / n) @ np.log(c / n / parent[seen])) < GAIN:
                    continue
                p = parent * (kinds / (n + kinds))
                p[seen] += c / (n + kinds)
                own[at] = p
            dists.append(own)
        if not dists[0]:
            dists[0][0] = flat
        # Prefixes of contexts are states too, else a step could lose sight of a longer one.
        states = [set(d) for d in dists]
        for j in range(DEPTH, 1, -1):
            states[j - 1].update(s >> 8 for s in states[j])
        index: list[dict[int, int]] = []
        names = []
        for j, s in enumerate(states):
            index.append({at: len(names) + i for i, at in enumerate(sorted(s))})
            names.extend((j, at) for at in sorted(s))
        self.log = np.empty((len(names), 256), np.float32)
        self.next = np.empty((len(names), 256), np.int32)
        for k, (j, at) in enumerate(names):
            i, short = longest(at, j, dists)
            self.log[k] = np.log10(dists[i][short])
        deeper: list[dict[int, list[int]]] = [{} for _ in index]
        for j in range(1, DEPTH + 1):
            for at in index[j]:
                deeper[j - 1].setdefault(at >> 8, []).append(at)
        # By length: a state steps as its longest suffix state does, or to a longer context.
        for k, (j, at) in enumerate(names):
            if j:
                i, short = longest(at, j - 1, index)
                self.next[k] = self.next[index[i][short]]
            else:
                self.next[k] = k
            for deep in deeper[j].get(at, ()):
                self.next[k, deep & 255] = index[j + 1][deep]
        self.states = len(names)
        used = np.unique(np.r_[np.concatenate([r & 255 for r in rows]).astype(np.int64), [10, 32]])
        #: Bytes that never occur in training share one column.
        self.symbol = np.full(256, len(used), np.int64)
        self.symbol[used] = np.arange(len(used))
        other = next(x for x in range(256) if x not in set(used.tolist())) if len(used) < 256 else 0
        columns = np.r_[used, other]
        self.width = len(columns)
        self.log, self.next = np.ascontiguousarray(self.log[:, columns]).ravel(), (np.ascontiguousarray(self.next[:, columns]) * self.width).ravel().astype(np.int32)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.symbol, self.log, self.next

    def logs(self, raw: np.ndarray) -> np.ndarray:
        return logs(self.tables(), raw)


def logs(tables: tuple[np.ndarray, np.ndarray, np.ndarray], raw: np.ndarray) -> np.ndarray:
    """log10 probability of each byte given those before it."""
    symbol, log, step = tables
    n = len(raw)
    pieces = -(-n // PIECE)
    symbols = np.full(pieces * PIECE + DEPTH, symbol[10], np.int64)
    symbols[DEPTH : DEPTH + n] = symbol[raw]
    out = np.empty((PIECE, pieces), np.float32)
    state = np.zeros(pieces, np.int32)
    starts = np.arange(pieces) * PIECE
    for i in range(DEPTH + PIECE):
        at = state + symbols[starts + i]
        if i >= DEPTH:
            out[i - DEPTH] = log[at]
        state = step[at]
    return out.T.ravel()[:n]


_BLOCKS = "block long, row long, ids array<bigint>, size long, text binary, code long"


def _blocked(frequent, often) -> Callable:
    """Rows of _BLOCKS: documents of one block (a line each, words by single spaces, compressed), and the codes that
    TOGETHER blocks ask for."""
    names = [c.split()[0] for c in _BLOCKS.split(", ")]

    def asks(block: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        code = np.unique(np.concatenate(held)).view(np.int64) if held else ()
        k = len(code)
        if k:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(code)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = block = TaskContext.get().partitionId() << 40
        held = []
        for ids, docs in _blocks(batches):
            n = len(docs)
            text = b"\n".join(docs)
            packed = pa.compress(text, codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([row]), pa.array([ids], pa.list_(pa.int64())), pa.array([len(text)]), pa.array([packed], pa.binary()), pa.nulls(1, pa.int64())], names=names)
            row += n
            held.append(np.unique(np.concatenate([code[np.isnan(value)] for _, code, value in rare(Stream(docs), frequent.value, often.value)])))
            if len(held) == TOGETHER:
                yield from asks(block, held)
                held, block = [], row
        yield from asks(block, held)

    return run


def _scored(tree, words, frequent, often, total: int, kinds: int) -> Callable:
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        tables, (hot, hot_n) = tree.value, words.value
        below = np.log10(total + SMOOTH * (kinds + 1))
        asked, known_values = answers.column("code").to_numpy().view(np.uint64), answers.column("value").to_numpy()
        order = np.argsort(asked)
        asked, known_values = asked[order], known_values[order]
        out = []
        for row, ids, length, packed in zip(*(block.column(c).to_pylist() for c in ("row", "ids", "size", "text")), strict=True):
            docs = pa.decompress(packed, length, codec="zstd", asbytes=True).split(b"\n")
            rows = row + np.arange(len(ids))
            stream = Stream(docs)
            byte = logs(tables, stream.bytes).astype(np.float64)
            for own, code, value in rare(stream, frequent.value, often.value):
                miss = np.flatnonzero(np.isnan(value))
                if len(miss):
                    wanted = code[miss]
                    spot = np.searchsorted(asked, wanted)
                    if len(asked) == 0 or not np.array_equal(asked[np.minimum(spot, len(asked) - 1)], wanted):
                        raise ValueError("a block lacks a probability that it asked for")
                    value[miss] = known_values[spot]
                byte[own] = value
            # Behind a document's last token come the next one's marks: they add nothing.
            byte[~stream.predicted()] = 0.0
            part = np.add.reduceat(byte, stream.token)
            own, place = np.unique(token_hashes(docs), return_inverse=True)
            if len(hot):
                spot = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
                n = np.where(hot[spot] == own, hot_n[spot], -1)
            else:
                n = np.full(len(own), -1)
            n = n[place]
            known = n > 0
            base = np.where(known, np.log10(np.maximum(n, 0) + SMOOTH) - below, 0.0)
            score = np.where(known, np.log10(MIX * 10**base + (1 - MIX) * 10**part), 0.0)
            size = len(docs)
            tokens = np.bincount(stream.doc, minlength=size)
            sums = [np.bincount(stream.doc, x, size) for x in (known, base, score)]
            out.append(_batch(pa.array(ids, pa.int64()), rows, tokens, sums[0].astype(np.int64), sums[1], sums[2], None, None))
            cold = np.flatnonzero(~known)
            if len(cold):
                out.append(_batch(None, rows[stream.doc[cold]], None, None, None, None, own[place[cold]].view(np.int64), part[cold]))
        return pa.Table.from_batches(out, _SCHEMA)

    return run


_COLUMNS = {"doc_id": pa.int64(), "row": pa.int64(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "word": pa.int64(), "part": pa.float32()}


_SCHEMA = pa.schema(list(_COLUMNS.items()))


def _batch(*columns) -> pa.RecordBatch:
    n = len(columns[1])
    arrays = [pa.nulls(n, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c).cast(t) for c, t in zip(columns, _COLUMNS.values(), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=list(_COLUMNS))


def _level(code: np.ndarray, n: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the codes of one length as Tree gives them, and how often their contexts occur. code is sorted
    and has all codes of its contexts; parent is the probability behind the context without its first byte."""
    if not len(code):
        return parent, n
    first = np.flatnonzero(np.r_[True, (code[1:] >> 8) != (code[:-1] >> 8)])
    sums = lambda x: np.add.reduceat(x, first)
    size, kinds = sums(n), sums((n > 0).astype(np.int64))
    nats = sums(n * np.log(np.maximum(n, 1) / parent)) - size * np.log(np.maximum(size, 1))
    times = np.diff(np.r_[first, len(code)])
    size, kinds, retained = (np.repeat(x, times) for x in (size, kinds, (size >= LEAST) & (nats >= GAIN)))
    return np.where(retained, (n + kinds * parent) / np.maximum(size + kinds, 1), parent), size


def _chained(short: np.ndarray, least: float) -> Callable:
    """Rows with j = -1: each code's count and log10 probability. Other rows: the codes of j bytes and the next one
    whose contexts occur least times. short has the probability for one byte and the next one."""

    def run(group: pa.Table) -> pa.Table:
        code, n = group.column("code").to_numpy(), group.column("n").to_numpy()
        out, before, p = [], None, short
        for j in range(2, DEPTH + 1):
            own, place = np.unique(code & ((1 << 8 * (j + 1)) - 1), return_inverse=True)
            times = np.bincount(place, n, len(own)).astype(np.int64)
            shorter = own & ((1 << 8 * j) - 1)
            p, size = _level(own, times, p[shorter if before is None else np.searchsorted(before, shorter)])
            before = own
            often = np.flatnonzero((size >= least) & (times > 0))
            out.append((np.full(len(often), j), own[often], times[often], np.zeros(len(often))))
        out.append((np.full(len(before), -1), before, times, np.log10(p)))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.table({k: pa.array(x.astype(t)) for k, x, t in zip(("j", "code", "n", "value"), columns, (np.int32, np.int64, np.int64, np.float32), strict=True)})

    return run


def _probabilities(counts: DataFrame, total: int, kinds: int) -> tuple[DataFrame, list[np.ndarray], list[np.ndarray]]:
    """Rows of _chained for all counted bytes, and the rows and counts of Tree, which SHARE bounds."""
    grams = counts.filter("kind = 1").select(F.col("key").alias("code"), "n")
    least = max(SHARE * total, LEAST)
    pairs = grams.groupBy(F.col("code").bitwiseAND(0xFFFF).alias("code")).agg(F.sum("n").alias("n")).orderBy("code").toArrow()
    pair, times = pairs.column("code").to_numpy(), pairs.column("n").to_numpy().astype(np.int64)
    symbols = np.bincount(pair & 255, times, 256).astype(np.int64)
    seen = int((symbols > 0).sum())
    root = (symbols + seen / 256) / (total + seen) if total >= LEAST else np.full(256, 1 / 256)
    p, size = _level(pair, times, root[pair & 255])
    short = np.zeros(1 << 16)
    short[pair] = p
    often, used = (size >= least) & (times > 0), np.flatnonzero(symbols) if total >= least else np.empty(0, np.int64)
    rows, ns = [used, pair[often]], [symbols[used], times[often]]
    # All longer contexts of a code end with the two bytes before its last.
    groups = grams.groupBy(F.pmod(F.xxhash64(F.shiftright("code", 8).bitwiseAND(0xFFFF)), F.lit(max(32, kinds // 100_000))).alias("part"))
    found = store(groups.applyInArrow(trimmed_group(_chained(short, least)), "j int, code long, n long, value float"), "values")
    frequent = found.filter("j >= 0").select("j", "code", "n").toArrow()
    j, code, n = (frequent.column(c).to_numpy() for c in ("j", "code", "n"))
    for i in range(2, DEPTH + 1):
        own = np.flatnonzero(j == i)
        own = own[np.argsort(code[own], kind="stable")]
        rows.append(code[own])
        ns.append(n[own])
    return found, rows, ns


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
    spark = docs.sparkSession
    body = binary_docs(docs, id_col, text_col)
    counts = body.mapInArrow(trimmed(_counted), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = store(counts, "counts")
    sums = {r["kind"]: (r["n"], r["kinds"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}
    total, kinds = sums.get(0, (0, 0))
    positions, distinct = sums.get(1, (0, 0))
    found, rows, times = _probabilities(counts, positions, distinct)
    tree = Tree(rows, times)
    share_of = spark.sparkContext.broadcast
    frequent = share_of(frequent_table(np.unique(rows[DEPTH] >> 8).astype(np.uint64)))
    values = found.filter("j = -1")
    rank = F.when(F.col("n") > 0, F.floor(4 * F.log2("n"))).otherwise(-1)
    ranks = sorted(((r["rank"], r["count"]) for r in values.groupBy(rank.alias("rank")).count().collect()), reverse=True)
    room = np.cumsum([c for _, c in ranks]) <= CODES
    most = values.filter(rank.isin([r for (r, _), fits in zip(ranks, room, strict=True) if fits])).select("code", "n", "value").toArrow()
    order = np.argsort(most.column("n").to_numpy(), kind="stable")
    table = share_of(code_table(most.column("code").to_numpy()[order].view(np.uint64), most.column("value").to_numpy()[order]))
    blocks = store(body.mapInArrow(trimmed(_blocked(frequent, table)), _BLOCKS), "blocks")
    asks = blocks.filter("code is not null").select("block", "code")
    answers = asks.join(values.select("code", "value"), "code").select(F.col("block").alias("to"), "code", "value")
    often = counts.filter((F.col("kind") == 0) & (F.col("n") >= HOT * total)).select("key", "n").toArrow()
    hot, hot_n = often.column("key").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.argsort(hot)
    share = (hot[order], hot_n[order])
    texts = blocks.filter("row is not null").select("block", "row", "ids", "size", "text")
    types = ", ".join(f"{c} {'float' if t == pa.float32() else 'double' if t == pa.float64() else 'long'}" for c, t in _COLUMNS.items())
    tables, words = share_of(tree.tables()), share_of(share)
    run = _scored(tables, words, frequent, table, total, kinds)
    parts = store(texts.groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(trimmed_group(run), types), "parts")
    drop(found, blocks)
    for broadcast in (frequent, table, tables, words):
        broadcast.destroy()
    rest = counts.filter((F.col("kind") == 0) & (F.col("n") < HOT * total)).select(F.col("key").alias("word"), "n")
    cold = parts.filter("word is not null").select("row", "word", "part").join(rest, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    base = F.log10((F.col("n") + SMOOTH) / (total + SMOOTH * (kinds + 1)))
    mixed = F.log10(MIX * F.pow(F.lit(10.0), base) + (1 - MIX) * F.pow(F.lit(10.0), F.col("part")))
    cold = cold.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("_known"), F.sum(base).alias("_base"), F.sum(mixed).alias("_score"))
    out = parts.filter("word is null").drop("word", "part").join(cold, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", plus("n_known", "_known"), F.lit(total).cast("long").alias("train_tokens"), plus("base", "_base").alias("base_score"), plus("score", "_score").alias("score"))


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
