"""Gzip and BGZF writing with exact headers, and a report."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

from ..config import WriteConfig
from ..errors import OUTPUT_IO, GzipError
from .framing import BGZF_END, BGZF_PAYLOAD, header, trailer


@dataclass(frozen=True)
class WriteReport:
    compressed_bytes: int
    uncompressed_bytes: int
    crc32: int
    isize: int


class GzipWriter:
    """One member, written through put(bytes). finish() may be called again and
    returns the same report; a failed writer refuses everything but close()."""

    def __init__(self, put: Callable[[bytes], object], config: WriteConfig | None = None) -> None:
        if put is None:
            raise GzipError(OUTPUT_IO, "no output")
        self.config = config or WriteConfig()
        self._put, self._failed, self._report = put, False, None
        self._engine = zlib.compressobj(self.config.level, zlib.DEFLATED, -15, 8, self.config.strategy)
        self._crc = self._in = self._out = 0
        self._held: list[bytes] = []
        self._size = 0
        self._send(header())

    def _send(self, data: bytes, force: bool = False) -> None:
        if data:
            self._held.append(data)
            self._size += len(data)
        if self._held and (force or self._size >= self.config.buffer_size):
            block = b"".join(self._held)
            try:
                self._put(block)
            except OSError as e:
                self._failed = True
                raise GzipError(OUTPUT_IO, f"cannot write: {e}") from e
            self._out += len(block)
            self._held, self._size = [], 0

    def _check(self) -> None:
        if self._failed:
            raise GzipError(OUTPUT_IO, "the writer failed before")
        if self._report is not None:
            raise GzipError(OUTPUT_IO, "the writer is finished")

    def write(self, data: bytes | str) -> int:
        self._check()
        data = data.encode() if isinstance(data, str) else data
        self._crc = zlib.crc32(data, self._crc)
        self._in += len(data)
        self._send(self._engine.compress(data))
        return len(data)

    def write_line(self, text: str) -> int:
        return self.write(text + "\n")

    def flush(self) -> None:
        """All bytes so far become readable."""
        self._check()
        self._send(self._engine.flush(zlib.Z_SYNC_FLUSH), True)

    def finish(self) -> WriteReport:
        if self._report is None:
            self._check()
            self._send(self._engine.flush() + trailer(self._crc, self._in), True)
            self._report = WriteReport(self._out, self._in, self._crc, self._in & 0xFFFFFFFF)
        return self._report

    def close(self) -> None:
        if not self._failed and self._report is None:
            self.finish()


def compress(data: bytes, config: WriteConfig | None = None) -> bytes:
    """One member."""
    parts: list[bytes] = []
    writer = GzipWriter(parts.append, config)
    writer.write(data)
    writer.finish()
    return b"".join(parts)


def bgzf_block(data: bytes, config: WriteConfig | None = None) -> bytes:
    c = config or WriteConfig()
    for level in (c.level, 0):
        engine = zlib.compressobj(level, zlib.DEFLATED, -15, 8, c.strategy)
        body = engine.compress(data) + engine.flush()
        if len(body) + 26 <= 1 << 16:
            return header(len(body) + 26) + body + trailer(zlib.crc32(data), len(data))
    raise GzipError(OUTPUT_IO, "a block is too large")


def bgzf(data: bytes, config: WriteConfig | None = None, payload: int = BGZF_PAYLOAD) -> bytes:
    """Blocks of payload bytes, then the empty block that ends a file."""
    blocks = [bgzf_block(data[i : i + payload], config) for i in range(0, len(data), payload)]
    return b"".join([*blocks, BGZF_END])
