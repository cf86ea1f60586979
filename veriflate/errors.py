"""Error kinds of gzip reading and writing."""

from __future__ import annotations

INPUT_IO = "input_io"
OUTPUT_IO = "output_io"
INVALID_HEADER = "invalid_header"
INVALID_DEFLATE = "invalid_deflate"
TRUNCATED_INPUT = "truncated_input"
CHECKSUM_MISMATCH = "checksum_mismatch"
SIZE_MISMATCH = "size_mismatch"
OUTPUT_LIMIT = "output_limit"
CANCELLED = "cancelled"
INTERNAL = "internal"
KINDS = (INPUT_IO, OUTPUT_IO, INVALID_HEADER, INVALID_DEFLATE, TRUNCATED_INPUT, CHECKSUM_MISMATCH, SIZE_MISMATCH, OUTPUT_LIMIT, CANCELLED, INTERNAL)

#: Exit codes of the command line.
EXIT_CODES = {INPUT_IO: 3, OUTPUT_IO: 3, CANCELLED: 4, INTERNAL: 4}


class ConfigError(ValueError):
    """An option is out of its range."""


class GzipError(Exception):
    """Input or output failed in one of KINDS, at a compressed offset, in a member."""

    def __init__(self, kind: str, message: str, offset: int = 0, member: int = 0) -> None:
        super().__init__(kind, message, offset, member)
        self.kind, self.message, self.offset, self.member = kind, message, offset, member

    def __str__(self) -> str:
        return f"{self.kind}: {self.message} (compressed offset {self.offset}, member {self.member})"

    @property
    def exit_code(self) -> int:
        return EXIT_CODES.get(self.kind, 1)
