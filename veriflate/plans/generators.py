"""Deterministic test data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the generator s = A * s + C modulo 2^32; bytes are its top eight bits.
A, C, START = 1664525, 1013904223, 0x12345678
_LEVELS, _MESSAGES = ("INFO", "DEBUG", "WARN", "ERROR"), ("chunk ready", "queue depth", "slow read", "retry")


def log_lines(spark: SparkSession, count: int) -> DataFrame:
    """line_no, value: log lines made from the line number."""
    i = F.col("id")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    value = F.format_string("2026-08-07T12:%02d:%02dZ %s sample=%d lane=%d reads=%d bytes=%d %s", (i / 60).cast("long") % 60, i % 60, pick(_LEVELS), i % 97, i % 8 + 1, i * 13 % 100_000, i * 7919 % 1_000_003, pick(_MESSAGES))
    return spark.range(count).select(i.alias("line_no"), value.alias("value"))


def fastq_lines(spark: SparkSession, count: int, bases: int = 150) -> DataFrame:
    """line_no, value: count records of four lines."""
    i = F.col("id")
    letters = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(bases)), lambda k: F.substr(F.lit("ACGT"), ((i * 7 + k * k) % 4 + 1).cast("int"), F.lit(1))), "")
    four = F.array(F.format_string("@READ_%d lane=%d", i, i % 4 + 1), letters, F.lit("+"), F.lit("I" * bases))
    return spark.range(count).select(i, F.posexplode(four).alias("k", "value")).select((i * 4 + F.col("k")).alias("line_no"), "value")


def jump(state: int, steps: int) -> int:
    """The generator's state after steps steps, by doubling."""
    a, c = A, C
    while steps:
        if steps & 1:
            state = (a * state + c) & 0xFFFFFFFF
        a, c, steps = a * a & 0xFFFFFFFF, (a + 1) * c & 0xFFFFFFFF, steps >> 1
    return state


def random_bytes(count: int, first: int = 0) -> bytes:
    """count bytes from step first on: runs of states double, each being the run before it moved on by its length."""
    out = np.empty(max(count, 1), np.uint64)
    out[0] = jump(START, first + 1)
    size, a, c = 1, A, C
    while size < count:
        more = min(size, count - size)
        out[size : size + more] = (out[:more] * np.uint64(a) + np.uint64(c)) & np.uint64(0xFFFFFFFF)
        a, c, size = a * a & 0xFFFFFFFF, (a + 1) * c & 0xFFFFFFFF, size + more
    return (out[:count] >> np.uint64(24)).astype(np.uint8).tobytes()


def record_set(spark: SparkSession, kind: str, size: int) -> DataFrame:
    """line_no, value: lines of log_lines or fastq_lines (kind log or fastq) up to the record that reaches size bytes."""
    if kind not in ("log", "fastq"):
        raise ValueError(f"unknown kind of records: {kind}")
    # No record is shorter than this.
    most = -(-size // 64) + 1
    lines, each = (log_lines(spark, most), 1) if kind == "log" else (fastq_lines(spark, most), 4)
    from ..operators.streams import running

    record = F.floor(F.col("line_no") / each)
    long = lines.select("line_no", "value", F.lit(0).alias("_all"), (F.octet_length("value") + 1).alias("_long"))
    ends = running(long, "_all", "line_no", F.col("_long"))
    before = ends.withColumn("_record", record).groupBy("_record").agg(F.min("_sum").alias("_before")).filter(F.col("_before") < size).select("_record")
    return lines.withColumn("_record", record).join(before, "_record", "left_semi").select("line_no", "value")


def record_crc(lines: DataFrame) -> DataFrame:
    """bytes, crc32 of a record set's lines in order, each with its newline: checksums of parts, folded in order."""
    from ..sources.framing import crc32_combine

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        crc = n = 0
        first = None
        for batch in batches:
            if batch.num_rows:
                first = batch.column(0)[0].as_py() if first is None else first
                data = b"".join(v.encode() + b"\n" for v in batch.column(1).to_pylist())
                crc, n = zlib.crc32(data, crc), n + len(data)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([crc], pa.int64()), pa.array([n], pa.int64())], names=["at", "crc32", "length"])

    def whole(pdf):
        import pandas as pd

        crc = total = 0
        for c, n in pdf.sort_values("at")[["crc32", "length"]].itertuples(index=False):
            crc, total = crc32_combine(crc, int(c), int(n)), total + int(n)
        return pd.DataFrame({"bytes": [total], "crc32": [crc]})

    ranged = lines.select("line_no", "value").repartitionByRange("line_no").sortWithinPartitions("line_no")
    return ranged.mapInArrow(part, "at long, crc32 long, length long").groupBy().applyInPandas(whole, "bytes long, crc32 long")


def random_blocks(spark: SparkSession, count: int, block: int = 65536) -> DataFrame:
    """offset, data: count pseudo-random bytes in blocks, each made by a jump to its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [i * block for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([random_bytes(min(block, count - a), a) for a in at], pa.binary())], names=["offset", "data"])

    return spark.range(-(-count // block)).mapInArrow(run, "offset long, data binary")
