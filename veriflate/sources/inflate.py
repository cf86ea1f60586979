"""Verified decoding with bounded memory: one page in, one chunk out."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from ..config import DecodeConfig
from ..errors import CHECKSUM_MISMATCH, INVALID_DEFLATE, OUTPUT_LIMIT, SIZE_MISMATCH, TRUNCATED_INPUT, GzipError
from .bytes_at import MemorySource
from .framing import Header, parse_header, parse_trailer


#: The first page read of a source, and the first step of a page that zlib gets for a member.
_FIRST, _STEP = 1 << 14, 1 << 11


class _Held:
    """A source whose last page stays at hand, so that small members are not read once more each. Pages
    grow up to the given size: what is asked for a few members costs no whole page."""

    def __init__(self, source, page: int) -> None:
        self.source, self.page, self.next = source, page, min(page, _FIRST)
        self.held, self.first = b"", 0

    def read_at(self, offset: int, length: int) -> bytes:
        at = offset - self.first
        if 0 <= at and at + length <= len(self.held):
            return self.held[at : at + length]
        return self.source.read_at(offset, length)

    def some(self, offset: int, length: int) -> bytes:
        """At most length bytes, none only behind the end."""
        at = offset - self.first
        if not 0 <= at < len(self.held):
            self.held, self.first, at = self.source.read_at(offset, self.next), offset, 0
            self.next = min(2 * self.next, self.page)
        return self.held[at : at + length]


@dataclass(frozen=True)
class Member:
    index: int
    start: int
    header: Header
    end: int
    decoded_start: int
    length: int
    crc32: int
    isize: int


def read_header(source, offset: int, config: DecodeConfig, member: int = 0) -> Header:
    """The header at offset, reading no more than it needs (in steps)."""
    step = 64
    while True:
        data = source.read_at(offset, min(step, config.max_header_size))
        try:
            found = parse_header(data, config.max_header_size)
        except GzipError as e:
            raise GzipError(e.kind, e.message, offset, member) from None
        if found is not None:
            return found
        if len(data) < min(step, config.max_header_size):
            raise GzipError(TRUNCATED_INPUT, "file ends within a header", offset + len(data), member)
        step *= 8


def decode(source, config: DecodeConfig, start: int = 0, end: int | None = None, first: int = 0, decoded: int = 0, single: bool = False, max_member: int | None = None, blocks: bool = False) -> Iterator[bytes | Member]:
    """Chunks of each member and then its Member, from the verified member
    start `start` up to `end` (the file's end): what follows a member must be
    the end or another valid header. With single, one member only; with blocks,
    up to the first member that does not state its block's size. Raises
    GzipError; chunks that came before it are not verified as a member."""
    at, index, limit = start, first, config.output_limit
    held = _Held(source, config.page_size)
    if at >= (source.size if end is None else end) and not first and not single:
        raise GzipError(TRUNCATED_INPUT, "empty input", at, index)
    # A stream's size grows as it is read.
    while at < (source.size if end is None else end) or single:
        head = read_header(held, at, config, index)
        if blocks and head.block_size is None:
            return
        place, crc, length = at + head.size, 0, 0
        engine = zlib.decompressobj(-15)
        pending, step = b"", _STEP
        made: list[bytes] = []
        size = 0
        while not engine.eof:
            if not pending:
                pending, step = held.some(place, step), min(2 * step, config.page_size)
                if not pending:
                    if made:
                        yield b"".join(made)
                    raise GzipError(TRUNCATED_INPUT, "file ends within a member", place, index)
            room = config.chunk_size - size
            if limit is not None:
                room = min(room, limit - decoded - length + 1)
            try:
                out = engine.decompress(pending, max(room, 1))
            except zlib.error as e:
                if made:
                    yield b"".join(made)
                raise GzipError(INVALID_DEFLATE, str(e), place, index) from None
            rest = engine.unused_data if engine.eof else engine.unconsumed_tail
            place += len(pending) - len(rest)
            pending = b"" if engine.eof else rest
            if max_member is not None and length + len(out) > max_member:
                raise GzipError(OUTPUT_LIMIT, "member is larger than a speculative decode may be", place, index)
            if limit is not None and decoded + length + len(out) > limit:
                made.append(out[: limit - decoded - length])
                if any(made):
                    yield b"".join(made)
                raise GzipError(OUTPUT_LIMIT, f"more than {limit} bytes", place, index)
            if out:
                crc = zlib.crc32(out, crc)
                length += len(out)
                made.append(out)
                size += len(out)
            if size >= config.chunk_size or (engine.eof and made):
                yield b"".join(made) if len(made) > 1 else made[0]
                made, size = [], 0
        tail = held.read_at(place, 8)
        try:
            want_crc, want_size = parse_trailer(tail)
        except GzipError as e:
            raise GzipError(e.kind, e.message, place + len(tail), index) from None
        if crc != want_crc:
            raise GzipError(CHECKSUM_MISMATCH, "CRC32 differs", place, index)
        if length & 0xFFFFFFFF != want_size:
            raise GzipError(SIZE_MISMATCH, "size differs", place + 4, index)
        yield Member(index, at, head, place + 8, decoded, length, crc, want_size)
        at, index, decoded = place + 8, index + 1, decoded + length
        if single:
            return


def decode_all(data: bytes, config: DecodeConfig = DecodeConfig()) -> tuple[bytes, list[Member]]:  # noqa: B008
    """The decoded bytes and the members of a complete stream."""
    parts, members = [], []
    for x in decode(MemorySource(data), config):
        (members if isinstance(x, Member) else parts).append(x)
    return b"".join(parts), members


