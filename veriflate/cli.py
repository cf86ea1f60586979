"""python -m veriflate.cli [options] FILE: decompress, compress or verify."""

from __future__ import annotations

import argparse
import os
import re
import sys
import time

from .config import DecodeConfig, WriteConfig
from .errors import INPUT_IO, OUTPUT_IO, ConfigError, GzipError
from .files import DecodeReport, Reader, _distinct, compress_stream, decode_to
from .functions.scalars import SIZE_UNITS
from .sources.deflate_writer import WriteReport

VERSION = "0.1.0"


def parse_size(text: str) -> int:
    m = re.fullmatch(r"\s*([0-9]+)\s*([a-z]*)\s*", text.lower())
    if not m or m[2] not in SIZE_UNITS:
        raise ConfigError(f"bad size: {text}")
    return int(m[1]) * 1024 ** SIZE_UNITS[m[2]]


class _Usage(Exception):
    pass


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise _Usage(message)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="veriflate", description="Verified gzip reading and writing.", epilog="Exit codes: 0 done, 1 damaged input, 2 usage, 3 input or output failed, 4 internal.")
    p.add_argument("-d", "--decompress", action="store_true", help="decompress (the default)")
    p.add_argument("-c", dest="short", action="store_true", help="compress; with -d, write to standard output")
    p.add_argument("--compress", action="store_true", help="compress; read standard input without FILE")
    p.add_argument("--stdout", action="store_true", help="write to standard output")
    p.add_argument("-o", "--output", help="write to this path")
    p.add_argument("-t", "--threads", type=int, default=0, help="upper bound of partitions a file (0: automatic)")
    p.add_argument("--memory", help="memory ceiling, such as 256MiB")
    p.add_argument("--output-limit", help="refuse to decode more than this")
    p.add_argument("--marker-path", action="store_true", help="accepted; single members are read in order")
    p.add_argument("--verify", action="store_true", help="verify only")
    p.add_argument("--stats", action="store_true", help="report to standard error")
    p.add_argument("--quiet", action="store_true", help="no messages but errors")
    p.add_argument("-f", "--force", action="store_true", help="overwrite, and write binary data to a terminal")
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("file", nargs="?")
    return p


def _stats(report: DecodeReport | WriteReport, seconds: float) -> None:
    for k, v in vars(report).items():
        print(f"{k}: {'+'.join(v) or 'none' if isinstance(v, list) else v}", file=sys.stderr)
    size = report.decompressed_bytes if isinstance(report, DecodeReport) else report.uncompressed_bytes
    print(f"seconds: {seconds:.6f}\nMiB/s: {size / 2**20 / seconds if seconds > 0 else 0:.3f}", file=sys.stderr)


def run(argv: list[str]) -> int:
    o = parser().parse_args(argv)
    if o.decompress and o.compress:
        raise _Usage("-d and --compress exclude each other")
    packing = o.compress or (o.short and not o.decompress)
    to_stdout = o.stdout or (o.short and (o.decompress or not o.output))
    if packing and o.verify:
        raise _Usage("--verify is for decompression")
    if packing and o.stdout and o.output:
        raise _Usage("--stdout and -o exclude each other")
    if not packing and not o.file:
        raise _Usage("a file is needed")
    config = DecodeConfig(threads=o.threads, memory_limit=parse_size(o.memory) if o.memory else 0, output_limit=parse_size(o.output_limit) if o.output_limit else None)
    began = time.perf_counter()
    if o.verify:
        reader = Reader(o.file, config)
        report: DecodeReport | WriteReport = reader.finish()
        reader.close()
        if o.stats:
            _stats(report, time.perf_counter() - began)
        return 0
    target = None if to_stdout else o.output
    if target is None and not to_stdout:
        target = re.sub(r"\.b?gz$", "", o.file) if not packing and re.search(r"\.b?gz$", o.file) else None
        if target is None:
            raise _Usage("the name has no .gz or .bgz; give -o or --stdout")
    if target is not None:
        if o.file and o.file != "-":
            _distinct(o.file, target)
        if os.path.exists(target) and not o.force:
            raise GzipError(OUTPUT_IO, f"{target} exists; -f overwrites it")
    elif packing and sys.stdout.isatty() and not o.force:
        raise _Usage("binary data is not written to a terminal without -f")
    if packing:
        stdin = not o.file or o.file == "-"
        try:
            source = sys.stdin.buffer if stdin else open(o.file, "rb")
        except OSError as e:
            raise GzipError(INPUT_IO, str(e)) from e
        out = open(target, "wb") if target else sys.stdout.buffer
        try:
            report = compress_stream(source, out, WriteConfig())
        finally:
            out.flush()
            for f in (source, out):
                if f not in (sys.stdin.buffer, sys.stdout.buffer):
                    f.close()
    else:
        Reader(o.file, config).close()
        out = open(target, "wb") if target else sys.stdout.buffer
        try:
            report = decode_to(o.file, out, config)
        finally:
            out.flush()
            if target:
                out.close()
    if o.stats:
        _stats(report, time.perf_counter() - began)
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(sys.argv[1:] if argv is None else argv)
    except (_Usage, ConfigError) as e:
        print(f"veriflate: {e}", file=sys.stderr)
        return 2
    except GzipError as e:
        print(f"veriflate: {e}", file=sys.stderr)
        return e.exit_code
    except OSError as e:
        print(f"veriflate: {e}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
