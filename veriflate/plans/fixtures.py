"""Gzip streams of known shapes, built bit by bit or by zlib, and manifests of them."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.deflate import FIXED, STORED, reverse_bits
from ..sources.framing import BGZF_END, MAGIC, bgzf_link, header, trailer


class BitWriter:
    """Bits, least significant first."""

    def __init__(self) -> None:
        self.value = self.count = 0
        self.done = bytearray()

    def put(self, value: int, count: int) -> None:
        self.value |= value << self.count
        self.count += count
        while self.count >= 8:
            self.done.append(self.value & 255)
            self.value >>= 8
            self.count -= 8

    def align(self) -> None:
        if self.count:
            self.put(0, 8 - self.count)

    def bytes(self) -> bytes:
        self.align()
        return bytes(self.done)


def member(raw: bytes, crc: int, size: int, extra: bytes | None = None) -> bytes:
    """A member around a raw DEFLATE stream; with extra, an extra field with one subfield that holds it."""
    if extra is None:
        return header() + raw + trailer(crc, size)
    field = struct.pack("<2sH", b"VF", len(extra)) + extra
    return MAGIC + b"\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(field)) + field + raw + trailer(crc, size)


def of(data: bytes, raw: bytes, extra: bytes | None = None) -> bytes:
    return member(raw, zlib.crc32(data), len(data), extra)


def deflated(data: bytes, level: int = 6, strategy: int = 0) -> bytes:
    engine = zlib.compressobj(level, zlib.DEFLATED, -15, 8, strategy)
    return engine.compress(data) + engine.flush()


def repeated(record: bytes, times: int) -> bytes:
    """A member of one record over and over, compressed a piece at a time."""
    engine, crc, parts = zlib.compressobj(6, zlib.DEFLATED, -15), 0, []
    step = max(1, (1 << 16) // max(len(record), 1))
    for i in range(0, times, step):
        piece = record * min(step, times - i)
        crc = zlib.crc32(piece, crc)
        parts.append(engine.compress(piece))
    parts.append(engine.flush())
    return member(b"".join(parts), crc, len(record) * times)


def stored_blocks(data: bytes, size: int = 0xFFFF) -> bytes:
    """Raw stored blocks of at most size bytes."""
    out = BitWriter()
    cuts = range(0, max(len(data), 1), size)
    for i in cuts:
        part = data[i : i + size]
        out.put(int(i + size >= len(data)) | STORED << 1, 3)
        out.align()
        out.done += struct.pack("<HH", len(part), len(part) ^ 0xFFFF) + part
    return out.bytes()


def fixed_literals(data: bytes) -> bytes:
    """One raw block of the fixed code, literals alone."""
    codes = np.array([reverse_bits(0x30 + b, 8) if b < 144 else reverse_bits(0x190 + b - 144, 9) for b in range(256)], np.uint16)
    head, parts, places = 1 | FIXED << 1, [], np.arange(9, dtype=np.uint16)
    parts.append(np.array([head >> i & 1 for i in range(3)], np.uint8))
    for i in range(0, len(data), 1 << 16):
        found = np.frombuffer(data, np.uint8)[i : i + (1 << 16)]
        bits = (codes[found][:, None] >> places & 1).astype(np.uint8)
        parts.append(bits[places < np.where(found < 144, 8, 9)[:, None]])
    return np.packbits(np.concatenate([*parts, np.zeros(7, np.uint8)]), bitorder="little").tobytes()


def many_blocks(data: bytes, size: int, level: int = 6) -> bytes:
    """Raw blocks of size bytes that do not look back beyond their own beginning."""
    engine, parts = zlib.compressobj(level, zlib.DEFLATED, -15), []
    for i in range(0, len(data), size):
        parts += [engine.compress(data[i : i + size]), engine.flush(zlib.Z_FULL_FLUSH)]
    return b"".join([*parts, engine.flush()])


SHAPES = ("zlib", "stored", "fixed", "blocks", "huffman")


def shaped(data: bytes, shape: str) -> bytes:
    """data as one member of a shape."""
    raws = {"zlib": deflated, "stored": lambda d: stored_blocks(d, 1000), "fixed": fixed_literals, "blocks": lambda d: many_blocks(d, 1000), "huffman": lambda d: deflated(d, 6, zlib.Z_HUFFMAN_ONLY)}
    return of(data, raws[shape](data))


def misstated(data: bytes) -> bytes:
    """A BGZF stream whose second block states the size of two; what is too short stays as it is."""
    sizes, at = [], 0
    while at < len(data) and len(sizes) < 4:
        following = bgzf_link(data[at : at + 64], at, len(data))[1]
        sizes.append(following - at)
        at = following
    if len(sizes) < 4 or sizes[1] + sizes[2] > 1 << 16:
        return data
    return data[: sizes[0] + 16] + struct.pack("<H", sizes[1] + sizes[2] - 1) + data[sizes[0] + 18 :]


def has_end(data: bytes) -> bool:
    return data.endswith(BGZF_END)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, file, bytes, decoded, crc32 from lines of name=value pairs, one a
    fixture; empty lines and lines that begin with # are no fixtures."""
    return manifest_rows(spark.read.text(path))


def manifest_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    value = F.trim(F.col(column))
    pairs = F.str_to_map(value, F.lit(" +"), F.lit("="))
    cell = lambda k: F.element_at("_pairs", F.lit(k))
    rows = lines.filter((value != "") & ~F.startswith(value, F.lit("#"))).select(pairs.alias("_pairs"))
    return rows.select(cell("name").alias("name"), cell("file").alias("file"), cell("bytes").cast("long").alias("bytes"), cell("decoded").cast("long").alias("decoded"), F.conv(cell("crc32"), 16, 10).cast("long").alias("crc32"))


def lookup(found: DataFrame, name: Column | str) -> DataFrame:
    """The fixture of that name."""
    return found.filter(F.col("name") == name)
