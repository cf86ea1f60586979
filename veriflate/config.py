"""Options of readers and writers, with their ranges."""

from __future__ import annotations

from dataclasses import dataclass

from .errors import ConfigError

KIB, MIB = 1 << 10, 1 << 20


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


@dataclass(frozen=True)
class DecodeConfig:
    """threads 1 forces one partition a file; 0 lets planning decide; more bound the tasks of a file.
    in_flight_chunks and memory_limit are accepted for callers that size executors by them: a task hands each chunk on before
    it decodes the next, and holds one page and one chunk whatever they say."""

    threads: int = 0
    chunk_size: int = 4 * MIB
    grid_size: int = 1 * MIB
    page_size: int = 1 * MIB
    max_speculative_output: int = 16 * MIB
    output_limit: int | None = None
    memory_limit: int = 0
    max_header_size: int = 1 * MIB
    in_flight_chunks: int = 0
    #: Decode single members in parallel as well (sources.marker).
    marker_path: bool = False
    #: Read on in sequence, from the last verified end, where the chain of members breaks; without, that is an error row.
    allow_sequential_fallback: bool = True
    #: Compressed bytes that one task reads of a blocked file.
    task_bytes: int = 32 * MIB

    def __post_init__(self) -> None:
        _need(self.threads >= 0, "threads must not be negative")
        _need(self.chunk_size >= 4 * KIB, "chunk_size must be at least 4 KiB")
        _need(self.grid_size >= KIB, "grid_size must be at least 1 KiB")
        _need(self.page_size >= 4 * KIB, "page_size must be at least 4 KiB")
        _need(self.max_speculative_output >= self.chunk_size, "max_speculative_output must hold a chunk")
        _need(self.output_limit is None or self.output_limit > 0, "output_limit must be positive")
        _need(self.memory_limit >= 0, "memory_limit must not be negative")
        _need(KIB <= self.max_header_size <= 64 * MIB, "max_header_size must lie between 1 KiB and 64 MiB")
        _need(self.in_flight_chunks >= 0, "in_flight_chunks must not be negative")
        _need(self.task_bytes > 0, "task_bytes must be positive")


@dataclass(frozen=True)
class WriteConfig:
    level: int = 6
    buffer_size: int = 1 * MIB
    strategy: int = 0

    def __post_init__(self) -> None:
        _need(0 <= self.level <= 9, "level must lie between 0 and 9")
        _need(self.buffer_size > 0, "buffer_size must be positive")
        _need(0 <= self.strategy <= 4, "strategy must lie between 0 and 4")
