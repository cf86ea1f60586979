"""Packing token sequences with bounded-space online best fit.

A document is its token ids and an end id. Each partition keeps at most OPEN
windows of LENGTH tokens. Whole windows of a long document go out at once; the
rest is placed into the open window that it fills best. If it fits nowhere and
no window may be opened, the fullest window is topped up with the rest's head
and emitted, and the remainder is placed again. So padding is left only in the
windows that are open at the end; those of GROUP partitions are merged, their
pieces placed by decreasing length. A task holds one Arrow batch and OPEN
windows; a worker process holds one encoder and at most MEMO_BYTES of encoded
words, however many tasks it runs.

Text is encoded in units: a run of white space and the word after it. The
tokenizer's pattern never joins a character and white space after it, so that
encoding units gives the same ids as encoding the text. Units are merged with
the same vocabulary file by a quicker library where the file allows it; texts
with a special token's string are encoded as a whole by the tokenizer, which is
loaded when the first such text comes.

Cases: null and empty texts are the end id alone; null and repeated doc_ids are
ordinary rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import islice
from struct import Struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_worker, store, table, trimmed

LENGTH = 1024
OPEN = 16
GROUP = 8
END = 0
VOCABULARY = "byte_bpe_50k.json"
#: Bytes of encoded units that a worker remembers, each counted with UNIT_BYTES
#: for its objects; units over MEMO_CHARS are not remembered.
MEMO_BYTES, UNIT_BYTES, MEMO_CHARS = 48 << 20, 190, 48
#: Unicode White_Space.
_WS = "\t-\r \x85\xa0  -     　"
_UNIT = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones
    stand for themselves, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _fast_units(spec: dict) -> Callable[[str], list[int]] | None:
    """A quicker encoder of units with the file's own vocabulary, if its merges
    are ranked by their ids; it gives the ids that the tokenizer gives."""
    import tiktoken
    from public_tokenizers import PATTERN

    model = spec["model"]
    letters = _byte_letters()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if i < 256 + len(merges)}
    encoding = tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    # The core under the class, where there is one, spares a call a unit.
    return getattr(encoding, "_core_bpe", encoding).encode_ordinary


class Encoder:
    """Texts to little-endian 32-bit ids."""

    def __init__(self, path: str | None = None) -> None:
        import public_tokenizers

        self.path = path or public_tokenizers.path(VOCABULARY)
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        self.unit = _fast_units(spec) or self.whole
        self.tokenizer = None
        self.memo: dict[str, bytes] = {}
        self.held = 0
        #: Bytes of so many ids.
        self.pack = [Struct(f"<{n}I").pack for n in range(32)]

    def whole(self, text: str) -> list[int]:
        if self.tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole(text), "<u4").tobytes()
        units = _UNIT.findall(text)
        memo, unit, pack = self.memo, self.unit, self.pack
        long, held = [], self.held
        for u in set(units).difference(memo):
            i = unit(u)
            memo[u] = ids = pack[len(i)](*i) if len(i) < len(pack) else np.array(i, "<u4").tobytes()
            if len(u) > MEMO_CHARS:
                long.append(u)
            else:
                held += UNIT_BYTES + len(u) + len(ids)
        self.held = held
        out = b"".join(map(memo.__getitem__, units))
        for u in long:
            del memo[u]
        if self.held > MEMO_BYTES:
            # The older half goes.
            for u in list(islice(memo, len(memo) // 2)):
                self.held -= UNIT_BYTES + len(u) + len(memo.pop(u))
        return out


class Packer:
    """Windows as (used, pieces); a piece is (doc_id, start, length, crc, doc_tokens)."""

    def __init__(self) -> None:
        self.open: list[list] = []
        self.full: list[list[tuple]] = []

    def add(self, doc_id, ids: bytes) -> None:
        total = len(ids) // 4

        def piece(start: int, size: int) -> tuple:
            return (doc_id, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), total)

        at = 0
        while total - at >= LENGTH:
            self.full.append([piece(at, LENGTH)])
            at += LENGTH
        while at < total:
            rest = total - at
            fits = [w for w in self.open if LENGTH - w[0] >= rest]
            if fits:
                window, size = max(fits, key=lambda w: w[0]), rest
            elif len(self.open) < OPEN:
                window, size = [0, []], rest
                self.open.append(window)
            else:
                window = max(self.open, key=lambda w: w[0])
                size = LENGTH - window[0]
            window[1].append(piece(at, size))
            window[0] += size
            at += size
            if window[0] == LENGTH:
                self.open.remove(window)
                self.full.append(window[1])


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, window long, offset long, open boolean"
_NAMES = [c.split()[0] for c in _PIECES.split(", ")]


def _rows(windows: list[list[tuple]], part: int, first: int, is_open: bool) -> list[tuple]:
    out = []
    for i, pieces in enumerate(windows, first):
        offset = 0
        for p in pieces:
            out.append((*p, part, i, offset, is_open))
            offset += p[2]
    return out


def _packed(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.bool_() if n == "open" else pa.int64()) for n in _NAMES])
        part, packer, done = TaskContext.get().partitionId(), Packer(), 0
        encoder = per_worker(f"encoder {path}", lambda: Encoder(path))
        end = END.to_bytes(4, "little")

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, (encoder.encode(s) if (s := text.as_py()) else b"") + end)
            if packer.full:
                yield batch_of(_rows(packer.full, part, done, False))
                done += len(packer.full)
                packer.full = []
        if packer.open:
            yield batch_of(_rows([w[1] for w in packer.open], part, done, True))

    return trimmed(run)


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """The open windows of one group: pieces by decreasing length, best fit."""
    pdf = pdf.sort_values(["length", "part", "window", "offset"], ascending=[False, True, True, True], kind="stable")
    room: list[int] = []  # by window
    by_room: dict[int, list[int]] = {}
    window, offset = [], []
    for size in pdf["length"]:
        at = next((r for r in range(size, LENGTH + 1) if by_room.get(r)), None)
        if at is None:
            w, at = len(room), LENGTH
            room.append(LENGTH)
        else:
            w = by_room[at].pop()
        window.append(w)
        offset.append(LENGTH - at)
        room[w] = at - size
        by_room.setdefault(at - size, []).append(w)
    return pdf.assign(window=window, offset=offset, part=pdf["part"].min())[_NAMES]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. path names the tokenizer's file on every executor."""
    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_packed(path), _PIECES)
    pieces = store(pieces, "pieces")
    merged = pieces.filter("open").groupBy(F.floor(F.col("part") / GROUP).alias("g")).applyInPandas(_merged, _PIECES)
    both = pieces.filter("not open").withColumn("kind", F.lit(0)).union(merged.withColumn("kind", F.lit(1)))
    sequence = F.col("part") * (1 << 41) + F.col("window") * 2 + F.col("kind")
    return both.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.cast("long").alias("sequence_id"), "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
