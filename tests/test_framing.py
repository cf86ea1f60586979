import gzip
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veriflate.config import DecodeConfig, WriteConfig
from veriflate.errors import ConfigError, GzipError
from veriflate.sources.bytes_at import MemorySource
from veriflate.sources.deflate_writer import GzipWriter, bgzf, bgzf_block, compress
from veriflate.sources.framing import BGZF_END, bgzf_link, crc32_combine, crc32_folded, header, parse_header
from veriflate.sources.inflate import Member, decode, decode_all
from veriflate.sources.planning import BGZF, MEMBERS, SEQUENTIAL, candidates, plan
from veriflate.sources.datasource import block_parts
from veriflate.sources.scan import chain

TEXT = b"a line of text, again and again\n" * 90


def full_header(flags=0x1F, extra=b"XY\x01\0zBC\x02\0\x34\x12"):
    out = b"\x1f\x8b\x08" + bytes([flags]) + b"\0\0\0\0\0\xff"
    if flags & 4:
        out += struct.pack("<H", len(extra)) + extra
    if flags & 8:
        out += b"name\0"
    if flags & 16:
        out += b"a comment\0"
    if flags & 2:
        out += struct.pack("<H", zlib.crc32(out) & 0xFFFF)
    return out


def kind_of(data, **options):
    try:
        decode_all(data, DecodeConfig(**options))
    except GzipError as e:
        return e.kind
    return None


def test_headers():
    assert parse_header(header()).size == 10
    full = full_header()
    found = parse_header(full + b"rest")
    assert (found.size, found.text, found.block_size) == (len(full), True, 0x1235)
    for n in range(len(full)):
        assert parse_header(full[:n]) is None
    for bad in (b"\x1e", b"\x1f\x8a", b"\x1f\x8b\x07", b"\x1f\x8b\x08\x20", full_header(4, b"BC\x09\0ab"), full_header(4, b"abc")):
        with pytest.raises(GzipError):
            parse_header(bad)
    damaged = bytearray(full)
    damaged[5] ^= 1
    with pytest.raises(GzipError, match="checksum"):
        parse_header(bytes(damaged))
    with pytest.raises(GzipError, match="too long"):
        parse_header(b"\x1f\x8b\x08\x08" + b"\0" * 6 + b"x" * 2000, 1024)


def test_combined_checksums_at_every_split():
    data = bytes(range(256)) * 2
    for i in range(0, len(data) + 1, 3):
        assert crc32_combine(zlib.crc32(data[:i]), zlib.crc32(data[i:]), len(data) - i) == zlib.crc32(data)


def test_members_reset_and_concatenate():
    stream = compress(TEXT) + gzip.compress(b"") + compress(b"tail", WriteConfig(level=0))
    out, members = decode_all(stream)
    assert out == TEXT + b"tail" == gzip.decompress(stream)
    assert [(m.index, m.decoded_start, m.length) for m in members] == [(0, 0, len(TEXT)), (1, len(TEXT), 0), (2, len(TEXT), 4)]
    assert members[0].end == members[1].start and members[-1].end == len(stream)


def test_damage_has_its_kind():
    good = compress(TEXT)
    flip = lambda i: good[:i] + bytes([good[i] ^ 1]) + good[i + 1 :]
    assert kind_of(b"") == "truncated_input"
    assert {kind_of(flip(len(good) - 8 + i)) for i in range(4)} == {"checksum_mismatch"}
    assert {kind_of(flip(len(good) - 4 + i)) for i in range(4)} == {"size_mismatch"}
    assert {kind_of(good[:i]) for i in range(1, len(good))} == {"truncated_input"}
    assert kind_of(good + b"junk") == kind_of(good + b"\0") == kind_of(b"PK" + good) == "invalid_header"
    assert kind_of(good + good[:5]) == "truncated_input"
    for i in range(len(good) * 8):
        bad = bytearray(good)
        bad[i // 8] ^= 1 << i % 8
        try:
            out, _ = decode_all(bytes(bad))
        except GzipError:
            continue
        assert out == TEXT


def test_limit_is_exact():
    good = compress(TEXT)
    assert kind_of(good, output_limit=len(TEXT)) is None
    got = b""
    with pytest.raises(GzipError) as e:
        for x in decode(MemorySource(good), DecodeConfig(output_limit=1000)):
            got += x
    assert e.value.kind == "output_limit" and got == TEXT[:1000]


@pytest.mark.parametrize("page", [4096, 8192])
def test_small_pages_and_chunks(page):
    data = b"".join(i.to_bytes(4, "big") for i in range(60_000))
    steps = list(decode(MemorySource(compress(data)), DecodeConfig(page_size=page, chunk_size=4096)))
    assert b"".join(x for x in steps if not isinstance(x, Member)) == data
    assert max(len(x) for x in steps if not isinstance(x, Member)) <= 4096


def test_writer():
    parts = []
    w = GzipWriter(parts.append, WriteConfig(level=9, buffer_size=16))
    w.write("héllo")
    w.write_line("")
    w.flush()
    assert zlib.decompressobj(31).decompress(b"".join(parts)) == "héllo\n".encode()
    report = w.finish()
    assert w.finish() is report
    assert gzip.decompress(b"".join(parts)) == "héllo\n".encode()
    assert (report.compressed_bytes, report.uncompressed_bytes, report.isize) == (len(b"".join(parts)), 7, 7)
    with pytest.raises(GzipError):
        w.write(b"x")

    def broken(_):
        raise OSError("full")

    w = GzipWriter(broken, WriteConfig(buffer_size=1 << 20))
    with pytest.raises(GzipError, match="output_io"):
        w.flush()
    w.close()
    with pytest.raises(GzipError):
        GzipWriter(None)


def test_options_are_checked():
    for bad in (dict(chunk_size=1), dict(grid_size=1), dict(page_size=1), dict(output_limit=0), dict(max_header_size=1), dict(threads=-1), dict(max_speculative_output=4096)):
        with pytest.raises(ConfigError):
            DecodeConfig(**bad)
    for bad in (dict(level=10), dict(strategy=5), dict(buffer_size=0)):
        with pytest.raises(ConfigError):
            WriteConfig(**bad)


def test_plans():
    blocks = bgzf(TEXT * 20, payload=1000)
    ranges = plan(MemorySource(blocks), DecodeConfig(task_bytes=500))
    assert {r.kind for r in ranges} == {BGZF} and len(ranges) > 3
    assert [r.start for r in ranges[1:]] == [r.end for r in ranges[:-1]] and ranges[-1].end == len(blocks)
    assert blocks.endswith(BGZF_END) and bgzf_link(BGZF_END, 0, 28) == (18, 28) and bgzf_link(BGZF_END, 0, 27) is None
    broken = blocks[:-28] + compress(b"plain")
    # Stated sizes are for the data source alone; where they end, so does the last part with known ends.
    parts = block_parts("x", MemorySource(broken), DecodeConfig(task_bytes=500))
    assert parts[-1].last == -1 and all(p.last > 0 for p in parts[:-1]) and parts[-1].range.start == len(blocks) - 28
    assert [p.range.start for p in parts[1:]] == [p.range.end for p in parts[:-1]] and parts[-1].range.end == len(broken)
    assert [r.kind for r in plan(MemorySource(blocks), DecodeConfig(threads=1))] == [SEQUENTIAL]
    members = b"".join(compress(bytes(str(i), "ascii") * 500, WriteConfig(level=0)) for i in range(9))
    assert {r.kind for r in plan(MemorySource(members), DecodeConfig(grid_size=1024))} == {MEMBERS}
    tiny = compress(b"x") * 50
    assert [r.kind for r in plan(MemorySource(tiny), DecodeConfig(grid_size=1024))] == [SEQUENTIAL]


def test_candidates_inside_a_payload_are_not_on_the_chain():
    inner = compress(b"inner")
    data = compress(inner * 3, WriteConfig(level=0)) + compress(b"after")
    source, config = MemorySource(data), DecodeConfig()
    found = candidates(source, 0, len(data), config)
    assert len(found) == 5
    rows = [next((m.start, m.end, m.length) for m in decode(source, config, at, single=True) if isinstance(m, Member)) for at in found]
    on, end = chain(rows, len(data))
    assert [rows[i][2] for i in on] == [3 * len(inner), 5] and end == len(data)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=5), st.integers(0, 9), st.booleans())
def test_round_trip(parts, level, blocked):
    config = WriteConfig(level=level)
    stream = b"".join(bgzf(p, config, 777) if blocked else compress(p, config) for p in parts)
    assert decode_all(stream)[0] == b"".join(parts) == gzip.decompress(stream)
    assert all(len(bgzf_block(p)) < 1 << 16 for p in parts)


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=400))
def test_any_bytes_end_in_an_error_or_in_verified_output(data):
    try:
        out, _ = decode_all(data)
    except GzipError as e:
        assert e.kind in ("truncated_input", "invalid_header", "invalid_deflate", "checksum_mismatch", "size_mismatch")
    else:
        assert gzip.decompress(data) == out


class Counted(MemorySource):
    """Counts the bytes that are asked for."""

    read = 0

    def read_at(self, offset, length):
        out = super().read_at(offset, length)
        self.read += len(out)
        return out


def test_small_members_are_read_about_once():
    bodies = [b"%d " % i * (i % 300) for i in range(3000)]
    data = b"".join(map(compress, bodies))
    source = Counted(data)
    found = list(decode(source, DecodeConfig()))
    assert b"".join(x for x in found if isinstance(x, bytes)) == b"".join(bodies)
    assert sum(isinstance(x, Member) for x in found) == len(bodies)
    assert source.read < 3 * len(data)
    # One member from the middle costs no whole page.
    one = Counted(data * 20)
    list(decode(one, DecodeConfig(), 0, single=True))
    assert one.read < 1 << 15


@pytest.mark.parametrize("cut", [0, 1, 8, 500, 40_000])
def test_chunks_are_whole_and_what_came_before_an_end_is_handed_out(cut):
    data = random.Random(5).randbytes(300_000)
    packed = compress(data)
    config, got = DecodeConfig(chunk_size=4096), []
    try:
        for x in decode(MemorySource(packed[: len(packed) - cut]), config):
            if isinstance(x, bytes):
                got.append(x)
        assert not cut
    except GzipError as e:
        assert cut and e.kind == "truncated_input"
    assert all(len(x) == 4096 for x in got[:-1]) and data.startswith(b"".join(got)) and sum(map(len, got)) >= len(data) - cut - 100


def test_checksums_of_many_pieces_fold():
    rng = random.Random(6)
    pieces = [rng.randbytes(rng.choice([0, 0, 1, 7, 3000])) for _ in range(500)]
    crcs, lengths = (np.array(list(map(f, pieces)), np.int64) for f in (zlib.crc32, len))
    assert crc32_folded(crcs, lengths) == (zlib.crc32(b"".join(pieces)), sum(map(len, pieces)))
    assert crc32_folded(crcs[:0], lengths[:0]) == (0, 0)
