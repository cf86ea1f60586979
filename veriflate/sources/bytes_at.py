"""Positional reads of a path or of bytes; sizes are taken once, when opened."""

from __future__ import annotations

import os

from ..errors import INPUT_IO, TRUNCATED_INPUT, GzipError


HADOOP_NAMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


class MemorySource:
    def __init__(self, data: bytes) -> None:
        self.data, self.size = bytes(data), len(data)

    def read_at(self, offset: int, length: int) -> bytes:
        return self.data[offset : offset + length]

    def close(self) -> None:
        pass


class PathSource:
    """A local path by pread, or a URI by the file systems that Arrow knows."""

    def __init__(self, path: str) -> None:
        self.path, self._fd, self._file = path, -1, None
        local = path[7:] if path.startswith("file://") else path[5:] if path.startswith("file:/") else path
        try:
            if "://" in local:
                from pyarrow import fs

                # Hadoop lists object stores under names of its own.
                scheme, _, rest = path.partition("://")
                system, name = fs.FileSystem.from_uri(f"{HADOOP_NAMES.get(scheme, scheme)}://{rest}")
                self._file = system.open_input_file(name)
                self.size = self._file.size()
            else:
                self._fd = os.open(local, os.O_RDONLY)
                self.size = os.fstat(self._fd).st_size
        except OSError as e:
            raise GzipError(INPUT_IO, f"cannot open {path}: {e}") from e

    def read_at(self, offset: int, length: int) -> bytes:
        length = max(0, min(length, self.size - offset))
        try:
            if self._file is not None:
                return self._file.read_at(length, offset)
            parts = []
            while length:
                part = os.pread(self._fd, length, offset)
                if not part:
                    break
                parts.append(part)
                offset += len(part)
                length -= len(part)
            return b"".join(parts)
        except OSError as e:
            raise GzipError(INPUT_IO, f"cannot read {self.path}: {e}", offset) from e

    def close(self) -> None:
        if self._fd >= 0:
            os.close(self._fd)
            self._fd = -1
        if self._file is not None:
            self._file.close()
            self._file = None


class StreamSource:
    """A file object that can only be read forward: what was read last stays at
    hand, enough for a decoder that reads page by page. It is not closed, and
    nothing behind what the decoder asked for is read but the rest of a page."""

    KEEP = 4 << 20

    def __init__(self, stream) -> None:
        self._stream, self._held, self._first, self._ended = stream, b"", 0, False

    @property
    def _end(self) -> int:
        return self._first + len(self._held)

    def _more(self, n: int) -> None:
        while n > 0 and not self._ended:
            try:
                part = self._stream.read(n)
            except OSError as e:
                raise GzipError(INPUT_IO, f"cannot read the stream: {e}", self._end) from e
            self._ended = not part
            self._held += part or b""
            n -= len(part or b"")

    @property
    def size(self) -> int:
        """Bytes known to exist: one more than was read, until the end was seen."""
        if not self._ended:
            self._more(1)
        return self._end

    def read_at(self, offset: int, length: int) -> bytes:
        if offset < self._first:
            raise GzipError(INPUT_IO, "a stream cannot be read again", offset)
        self._more(offset + length - self._end)
        out = self._held[offset - self._first : offset - self._first + length]
        if len(self._held) > 2 * self.KEEP:
            drop = len(self._held) - self.KEEP
            self._held, self._first = self._held[drop:], self._first + drop
        return out

    def close(self) -> None:
        pass
