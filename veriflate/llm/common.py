"""Shared pieces of the training-data operators: reading tables, durable
intermediate tables, word hashing and forest-shaped reductions."""

from __future__ import annotations

import ctypes
import inspect
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join with at most this many narrow rows (ids or id pairs, under
#: 64 bytes each) may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000

_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where
    the session has one, else a folder of this process (tests, local mode)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="veriflate-")
    return f"file://{_LOCAL['dir']}"


def _new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the application ends, if it was not dropped before."""
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}-{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends
    here, and a lost executor costs only the tasks that it ran."""
    spark = df.sparkSession
    path = _new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def store_split(df: DataFrame, name: str, column: str, kinds: int) -> list[DataFrame]:
    """Like store, as one table for each value 0 .. kinds - 1 of an int column; each can be dropped by itself."""
    spark = df.sparkSession
    path = _new_path(spark, name)
    df.write.partitionBy(column).parquet(path)
    out = []
    for k in range(kinds):
        part = spark.read.schema(df.schema).parquet(path).filter(F.col(column) == k).drop(column)
        part._llm_path = f"{path}/{column}={k}"
        out.append(part)
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables made by store() that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._llm_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it was counted to be within the bound."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def binary_docs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the UTF-8 bytes of the text (null stays null)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"))


def per_worker(name: str, make: Callable[[], Any]) -> Any:
    """make()'s result, made once in a worker process. Functions that travel by value
    have no module of their own there, so that it is kept in a module made for this."""
    held = sys.modules.setdefault("_veriflate_worker", types.ModuleType("_veriflate_worker")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def _trim() -> None:
    """Give freed memory back to the system; Spark keeps a worker for later tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for a task, with freed memory given back when it ends."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        _trim()

    return wrapped


def trimmed_group(run: Callable) -> Callable:
    """run for one group (or two cogrouped ones), with freed memory given back behind it."""

    def one(group):
        out = run(group)
        _trim()
        return out

    def two(left, right):
        out = run(left, right)
        _trim()
        return out

    return two if len(inspect.signature(run).parameters) == 2 else one


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a fixed number of entries (about 16 MB)."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(words: list[bytes], memo: WordHashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of the public splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Order-sensitive 64-bit hash of each k consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(salt + k), np.uint64)
    for i in range(k):
        out = out * _STEP + h[i : i + n]
        out ^= out >> np.uint64(29)
    return mix(out)


#: Odd, and its inverse modulo 2^64.
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


class Sums:
    """64-bit hashes of stretches of numbers, each by two lookups: a polynomial
    in an odd number, taken back to the stretch's start by the inverse."""

    def __init__(self, h: np.ndarray) -> None:
        n = len(h)
        self.sum = np.zeros(n + 1, np.uint64)
        power, self.back = _powers(n)
        np.cumsum(h * power, out=self.sum[1:])

    def hashes(self, begin: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
        size = (end - begin).astype(np.uint64)
        return mix((self.sum[end] - self.sum[begin]) * self.back[begin] ^ mix(size * np.uint64(64) + np.uint64(salt)))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _STEP and of _BACK from 0 on (at least n, and n + 1); short ones are kept in the worker."""

    def make(size: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, x)])) for x in (_STEP, _BACK))

    power, back = per_worker("powers", lambda: make(KEPT)) if n <= KEPT else make(n)
    return power[:n], back[: n + 1]


#: Powers that a worker keeps (16 bytes each).
KEPT = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: A number for each byte, so that texts of few different bytes are spread over all 64 bits.
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of bytes that are not white space) of
    all texts, one after the other, and the place of each text's first one, with
    the number of words behind them. No word becomes an object; stretches of
    about KEPT bytes are hashed at a time."""
    size = np.array([0 if t is None else len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"\n".join(t or b"" for t in texts), np.uint8)
    word = ~_BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]])))
    begin, end = edge[::2], edge[1::2]
    out, at = np.empty(len(begin), np.uint64), 0
    while at < len(begin):
        upto = max(at + 1, int(np.searchsorted(end, begin[at] + KEPT, "right")))
        first = begin[at]
        sums = Sums(_LETTERS[raw[first : end[upto - 1]]])
        out[at:upto] = sums.hashes(begin[at:upto] - first, end[at:upto] - first, 11)
        at = upto
    offset = np.concatenate([[0], np.cumsum(size + 1)])
    return out, np.searchsorted(begin, offset)


#: Bytes of text that are hashed at a time.
PART = 1_000_000


def in_parts(bodies: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    """First row and texts of parts of about PART bytes (a longer text is one of its own)."""
    first, size, part = 0, 0, []
    for i, b in enumerate(bodies):
        part.append(b.as_py())
        size += len(part[-1] or b"")
        if size > PART:
            yield first, part
            first, size, part = i + 1, 0, []
    if part:
        yield first, part
