"""Gzip framing (RFC 1952): headers, trailers, BGZF links, CRC combination."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from ..errors import INVALID_HEADER, TRUNCATED_INPUT, GzipError

MAGIC = b"\x1f\x8b"
_TEXT, _HCRC, _EXTRA, _NAME, _COMMENT, _RESERVED = 1, 2, 4, 8, 16, 0xE0
#: The empty BGZF block that ends a file.
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BGZF_PAYLOAD = 0xFF00


@dataclass(frozen=True)
class Header:
    size: int
    text: bool
    #: Compressed size of the whole member, if a BC subfield states it.
    block_size: int | None


def _bad(message: str) -> GzipError:
    return GzipError(INVALID_HEADER, message)


def _extra(field: bytes) -> int | None:
    """The BC subfield's member size; subfields must fill the field exactly."""
    at, found = 0, None
    while at < len(field):
        if len(field) - at < 4:
            raise _bad("truncated subfield header")
        size = int.from_bytes(field[at + 2 : at + 4], "little")
        if at + 4 + size > len(field):
            raise _bad("subfield exceeds the extra field")
        if field[at : at + 2] == b"BC" and size == 2:
            found = int.from_bytes(field[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return found


def parse_header(data: bytes | memoryview, limit: int = 1 << 20) -> Header | None:
    """The header at the start of data; None if data ends within a header that
    is valid so far; GzipError if it can't be one."""
    data = bytes(data[:limit])
    for i, want in enumerate(MAGIC + b"\x08"):
        if len(data) <= i:
            return None
        if data[i] != want:
            raise _bad(("bad magic byte 1", "bad magic byte 2", "unsupported compression method")[i])
    if len(data) > 3 and data[3] & _RESERVED:
        raise _bad("reserved flags set")
    short = lambda: _too_long(data, limit)
    if len(data) < 10:
        return short()
    flags, at, block = data[3], 10, None
    if flags & _EXTRA:
        if len(data) < at + 2:
            return short()
        size = int.from_bytes(data[at : at + 2], "little")
        if len(data) < at + 2 + size:
            return short()
        block = _extra(data[at + 2 : at + 2 + size])
        at += 2 + size
    for flag in (_NAME, _COMMENT):
        if flags & flag:
            end = data.find(b"\0", at)
            if end < 0:
                return short()
            at = end + 1
    if flags & _HCRC:
        if len(data) < at + 2:
            return short()
        if int.from_bytes(data[at : at + 2], "little") != zlib.crc32(data[:at]) & 0xFFFF:
            raise _bad("header checksum mismatch")
        at += 2
    return Header(at, bool(flags & _TEXT), block)


def _too_long(data: bytes, limit: int) -> None:
    if len(data) >= limit:
        raise _bad("header too long")


def parse_trailer(data: bytes) -> tuple[int, int]:
    """(CRC32, size modulo 2^32)."""
    if len(data) < 8:
        raise GzipError(TRUNCATED_INPUT, "file ends within a trailer")
    return struct.unpack("<II", data[:8])


def header(block_size: int | None = None) -> bytes:
    """No flags, no time, unknown system; with block_size a BGZF header."""
    if block_size is None:
        return MAGIC + b"\x08\0\0\0\0\0\0\xff"
    return MAGIC + b"\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHH", 6, b"BC", 2, block_size - 1)


def trailer(crc: int, size: int) -> bytes:
    return struct.pack("<II", crc, size & 0xFFFFFFFF)


def bgzf_link(head: bytes, offset: int, size: int, limit: int = 1 << 20) -> tuple[int, int] | None:
    """(header size, next offset) of the BGZF block whose first bytes are head,
    if its stated size holds at least its header and trailer and lies in the file."""
    try:
        found = parse_header(head, limit)
    except GzipError:
        return None
    if found is None or found.block_size is None:
        return None
    if found.block_size < found.size + 8 or offset + found.block_size > size:
        return None
    return found.size, offset + found.block_size


def _square(matrix: list[int]) -> list[int]:
    return [_times(matrix, m) for m in matrix]


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for i in range(vector.bit_length()):
        if vector >> i & 1:
            out ^= matrix[i]
    return out


def _powers() -> list[list[int]]:
    step = [0xEDB88320] + [1 << i for i in range(31)]  # by one zero bit
    out = [_square(_square(_square(step)))]  # by one byte
    while len(out) < 63:
        out.append(_square(out[-1]))
    return out


#: The matrices that move a checksum over 2^0, 2^1, ... zero bytes.
_SHIFTS = _powers()


def crc32_combine(first: int, second: int, second_length: int) -> int:
    """CRC32 of two pieces in order: the first one's is moved over the length of
    the second by powers of the polynomial's shift matrix."""
    if second_length <= 0:
        return first
    for power in range(second_length.bit_length()):
        if second_length >> power & 1:
            first = _times(_SHIFTS[power], first)
    return first ^ second


def crc32_folded(crcs: np.ndarray, lengths: np.ndarray) -> tuple[int, int]:
    """CRC32 and length of pieces in order: each checksum is moved over the bytes behind its piece, all at once."""
    crcs = np.where(lengths > 0, crcs, 0).astype(np.uint32)
    total = int(lengths.sum())
    behind = total - np.cumsum(lengths)
    for power in range(int(behind.max(initial=0)).bit_length()):
        i = np.flatnonzero(behind >> power & 1)
        moved = np.zeros(len(i), np.uint32)
        for k, column in enumerate(_SHIFTS[power]):
            moved ^= (crcs[i] >> k & 1) * np.uint32(column)
        crcs[i] = moved
    return int(np.bitwise_xor.reduce(crcs)), total
