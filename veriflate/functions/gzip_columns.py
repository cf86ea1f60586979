"""Gzip over BINARY columns, Arrow batch by Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DecodeConfig, WriteConfig
from ..errors import GzipError
from ..sources.bytes_at import MemorySource
from ..sources.deflate_writer import bgzf as _bgzf
from ..sources.deflate_writer import compress
from ..sources.inflate import Member, decode, decode_all
from ..sources.planning import SEQUENTIAL, Range
from ..sources.scan import MEMBER, _frame, range_members


def gzip(data: Column, config: WriteConfig | None = None) -> Column:
    """data as one gzip member; null stays null."""
    c = config or WriteConfig()

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: None if x is None else compress(bytes(x), c))

    return run(data.cast("binary"))


def bgzf(data: Column, payload: int, config: WriteConfig | None = None) -> Column:
    """data as BGZF blocks of payload bytes and the empty last block."""
    c = config or WriteConfig()

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: None if x is None else _bgzf(bytes(x), c, payload))

    return run(data.cast("binary"))


def gunzip(data: Column, config: DecodeConfig | None = None) -> Column:
    """The verified decoded bytes; a damaged stream fails the task."""
    c = config or DecodeConfig()

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: None if x is None else decode_all(bytes(x), c)[0])

    return run(data.cast("binary"))


VERIFIED = "members long, decoded_bytes long, status string, error_kind string, error_offset long, error_member long"


def gzip_verify(data: Column, config: DecodeConfig | None = None) -> Column:
    """A struct of VERIFIED: what the stream holds, or how it fails; nothing is kept of the payload."""
    c = config or DecodeConfig()

    @F.pandas_udf(VERIFIED)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            rows = []
            for x in s:
                if x is None:
                    rows.append((None,) * 6)
                    continue
                n = size = 0
                bad = (None, None, None)
                try:
                    for part in decode(MemorySource(x), c):
                        if isinstance(part, Member):
                            n += 1
                        else:
                            size += len(part)
                except GzipError as e:
                    bad = (e.kind, e.offset, e.member)
                rows.append((n, size, "OK" if bad[0] is None else "ERROR", *bad))
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in VERIFIED.split(", ")])
            yield frame.astype({k: "Int64" for k in ("members", "decoded_bytes", "error_offset", "error_member")})

    return run(data.cast("binary"))


def gzip_members(df: DataFrame, key: str, data: str, config: DecodeConfig | None = None) -> DataFrame:
    """Rows of sources.scan.MEMBER for the stream in column data; path is the key as a string."""
    c, width = config or DecodeConfig(), len(MEMBER.split(","))

    def run(batches):
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not body.is_valid:
                    continue
                data = MemorySource(body.as_py())
                rows = [row[:width] for row in range_members(data, name, Range(SEQUENTIAL, 0, data.size), c)]
                yield _frame(rows, MEMBER)

    return df.select(F.col(key).cast("string").alias("path"), F.col(data).cast("binary").alias("data")).mapInArrow(run, MEMBER)


def write_concatenated(df: DataFrame, group: str, order: str, data: str, folder: str, config: WriteConfig | None = None, ready: bool = False) -> DataFrame:
    """Write the members of each group's rows, one after the other in order, as
    files folder/group/part.gz, and return group, path when it runs. A large
    group has several files (ranges of order, in the order of their parts); a
    task holds one batch of rows, so groups may have any size. With ready, data
    holds whole members already."""
    made = df.select(F.col(group).alias("_g"), F.col(order).alias("_o"), F.col(data).alias("_d"))
    made = made.repartitionByRange("_g", "_o").sortWithinPartitions("_g", "_o").select("_g", (F.col("_d") if ready else gzip(F.col("_d"), config)).alias("_d"))

    def put(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        system, at = fs.FileSystem.from_uri(folder)
        part, name, out = TaskContext.get().partitionId(), None, None
        for batch in batches:
            done = []
            for value, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out is None or value != name:
                    if out is not None:
                        out.close()
                    name = value
                    system.create_dir(f"{at}/{name}")
                    out = system.open_output_stream(f"{at}/{name}/{part:06d}.gz", compression=None)
                    done.append((name, f"{at}/{name}/{part:06d}.gz"))
                if body.is_valid:
                    out.write(body.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in done], pa.string()), pa.array([f for _, f in done], pa.string())], names=[group, "path"])
        if out is not None:
            out.close()

    return made.withColumn("_g", F.col("_g").cast("string")).mapInArrow(put, f"`{group}` string, path string")
