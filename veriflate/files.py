"""Whole files on the driver: an iterator, a reader, and file to file."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

from .config import DecodeConfig, WriteConfig
from .errors import CANCELLED, OUTPUT_IO, GzipError
from .sources.bytes_at import MemorySource, PathSource, StreamSource
from .sources.deflate_writer import GzipWriter, WriteReport
from .sources.inflate import Member, decode


@dataclass
class DecodeReport:
    compressed_bytes: int = 0
    decompressed_bytes: int = 0
    member_count: int = 0
    paths_used: list[str] = field(default_factory=lambda: ["sequential"])
    crc_verified: bool = False


class Reader:
    """Forward-only reading of a path, of bytes, or of a file object that is read
    forward only and stays open; finish() verifies all that was not read. There
    is no seeking and no writing."""

    def __init__(self, source: str | bytes | BinaryIO, config: DecodeConfig | None = None) -> None:
        self._source = MemorySource(source) if isinstance(source, bytes) else PathSource(source) if isinstance(source, str) else StreamSource(source)
        self._steps = decode(self._source, config or DecodeConfig())
        self._held, self._cancelled, self._report = b"", False, DecodeReport()

    def __iter__(self) -> Iterator[bytes]:
        while part := self.read(1 << 20):
            yield part

    def _fill(self) -> bool:
        if self._cancelled:
            raise GzipError(CANCELLED, "reading was cancelled")
        for x in self._steps:
            if isinstance(x, Member):
                self._report.member_count = x.index + 1
                self._report.compressed_bytes = x.end
            else:
                self._held += x
                return True
        self._report.crc_verified = True
        return False

    def peek(self) -> memoryview:
        """What comes next, empty at the end."""
        if not self._held:
            self._fill()
        return memoryview(self._held)

    def consume(self, n: int) -> None:
        if not 0 <= n <= len(self._held):
            raise ValueError("more than peek() showed")
        self._report.decompressed_bytes += n
        self._held = self._held[n:]

    def read(self, n: int = -1) -> bytes:
        while (n < 0 or len(self._held) < n) and self._fill():
            pass
        out = self._held if n < 0 else self._held[:n]
        self.consume(len(out))
        return out

    def finish(self) -> DecodeReport:
        while self._held or self._fill():
            self.consume(len(self._held))
        return self._report

    def stats(self) -> DecodeReport:
        return self._report

    def cancel(self) -> None:
        self._cancelled = True
        self.close()

    def close(self) -> None:
        self._source.close()


def decode_to(source: str | bytes | BinaryIO, out: BinaryIO, config: DecodeConfig | None = None) -> DecodeReport:
    reader = Reader(source, config)
    try:
        for part in reader:
            out.write(part)
        return reader.finish()
    except OSError as e:
        raise GzipError(OUTPUT_IO, str(e)) from e
    finally:
        reader.close()


def _distinct(source: str, target: str) -> None:
    if os.path.exists(target) and os.path.exists(source) and os.path.samefile(source, target):
        raise GzipError(OUTPUT_IO, "input and output are the same file")


def decompress_file(source: str, target: str, config: DecodeConfig | None = None) -> DecodeReport:
    _distinct(source, target)
    reader = Reader(source, config)  # before the output is made
    reader.close()
    with open(target, "wb") as out:
        return decode_to(source, out, config)


def compress_stream(source: BinaryIO, out: BinaryIO, config: WriteConfig | None = None) -> WriteReport:
    writer = GzipWriter(out.write, config)
    while part := source.read(1 << 20):
        writer.write(part)
    return writer.finish()
