"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EXIT_CODES

#: Workload classes, and the modes of benchmark rows with their aliases.
MODE_API, MODE_NULL, MODE_FILE, MODE_PIPE = "api-read-crc", "cli-stdout-null", "cli-file-output", "cli-pipe-wc"
MODE_ALIASES = {
    MODE_API: ("api", "api-read", "api-read-crc", "library"),
    MODE_NULL: ("cli-null", "cli-stdout", "cli-stdout-null", "stdout-null"),
    MODE_FILE: ("cli-file", "cli-output", "cli-file-output", "file-output"),
    MODE_PIPE: ("pipe-wc", "cli-pipe-wc", "wc"),
}
SIZE_UNITS = {"": 0, "b": 0, "k": 1, "kb": 1, "kib": 1, "m": 2, "mb": 2, "mib": 2, "g": 3, "gb": 3, "gib": 3, "t": 4, "tb": 4, "tib": 4}


def _any(*tests: Column) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def parse_size(text: Column) -> Column:
    """Bytes of sizes such as 512K, 4MiB or 1G; every unit is a power of 1024. Bad texts raise."""
    low = F.lower(F.trim(text))
    number, unit = F.regexp_extract(low, r"^([0-9]+) *([a-z]*)$", 1), F.regexp_extract(low, r"^([0-9]+) *([a-z]*)$", 2)
    out = F.raise_error(F.concat(F.lit("bad size: "), text)).cast("long")
    for name, power in SIZE_UNITS.items():
        out = F.when((number != "") & (unit == name), F.expr("CAST(1 AS BIGINT)") * 1024**power * F.nullif(number, F.lit("")).cast("long")).otherwise(out)
    return F.when(text.isNull(), F.lit(None).cast("long")).otherwise(out)


def output_path(path: Column) -> Column:
    """path without .gz or .bgz; other names raise."""
    return F.when(F.regexp_like(path, F.lit(r"\.b?gz$")), F.regexp_replace(path, r"\.b?gz$", "")).otherwise(F.raise_error(F.concat(F.lit("no .gz or .bgz name: "), path)).cast("string"))


def path_names(paths: Column) -> Column:
    return F.when(F.size(paths) == 0, "none").otherwise(F.array_join(paths, "+"))


def throughput(size: Column, seconds: Column) -> Column:
    """MiB/s; 0 where no time passed."""
    return F.when(seconds <= 0, F.lit(0.0)).otherwise(size / F.lit(1048576.0) / seconds)


def decimals(x: Column, places: int = 6) -> Column:
    return F.format_string(f"%.{places}f", x)


def ratio_text(x: Column) -> Column:
    return F.when(x > 0, decimals(x, 4)).otherwise("")


def mean_text(total: Column, count: Column, places: int = 6) -> Column:
    """A mean with fixed decimals, empty where nothing was counted."""
    return F.when(F.coalesce(count, F.lit(0)) > 0, decimals(total / count, places)).otherwise("")


def quoted(text: Column) -> Column:
    """A CSV cell in quotes, quotes in it doubled."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def parse_number(text: Column, kind: str = "double", missing=0, name: str = "") -> Column:
    """A number; missing where empty; bad texts raise an error that names the column."""
    found = F.nullif(F.trim(text), F.lit(""))
    number = found.try_cast(kind)
    bad = F.raise_error(F.concat(F.lit(f"bad number in {name or 'a column'}: "), text)).cast(kind)
    return F.when(found.isNull(), F.lit(missing).cast(kind)).when(number.isNull(), bad).otherwise(number)


def parse_bool(text: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no", ""), False).otherwise(F.raise_error(F.concat(F.lit("bad boolean: "), low)).cast("boolean"))


def parse_list(text: Column) -> Column:
    """Comma-separated parts, trimmed, empty ones dropped, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))


def parse_counts(text: Column) -> Column:
    """Comma-separated positive whole numbers, each once; anything else raises."""
    bad = F.raise_error(F.concat(F.lit("not a list of positive numbers: "), text)).cast("array<long>")
    found = F.transform(parse_list(text), lambda x: x.try_cast("long"))
    return F.when(F.exists(found, lambda x: x.isNull() | (x < 1)) | (F.size(found) == 0), bad).otherwise(found)


def worker_target(most: Column, work: Column) -> Column:
    """Tasks to begin with: twice the root of the most there may be, no more than there is work for, at least one."""
    return F.greatest(F.least(most, F.ceil(2 * F.sqrt(most)).cast("long"), work), F.lit(1).cast("long"))


def two_digits(n: Column) -> Column:
    return F.format_string("%02d", n)


def compression_ratio(compressed: Column, size: Column) -> Column:
    return F.when(size == 0, F.lit(0.0)).otherwise(compressed / size)


def isize(n: Column) -> Column:
    return n.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def is_external(variant: Column) -> Column:
    return (variant == "gunzip") | F.startswith(variant, F.lit("pigz-"))


def default_mode(variant: Column, own: str) -> Column:
    """Mode of a benchmark row that states none; own is the engine's variant prefix."""
    starts = lambda *p: _any(*(F.startswith(variant, F.lit(x)) for x in p))
    return F.when(is_external(variant) | starts(f"{own}-cli-null"), MODE_NULL).when(starts(f"{own}-cli-file"), MODE_FILE).when(starts(f"{own}-pipe-wc", f"{own}-cli-pipe-wc"), MODE_PIPE).otherwise(MODE_API)


def canonical_mode(text: Column) -> Column:
    low = F.lower(F.trim(text))
    out = F.raise_error(F.concat(F.lit("unknown mode: "), text)).cast("string")
    for mode, names in MODE_ALIASES.items():
        out = F.when(low.isin(*names), mode).otherwise(out)
    return out


def workload(path: Column) -> Column:
    """Class of a file by its name alone."""
    # The literals are fixed values of the classes; the first class that fits counts.
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    ends = lambda *x: _any(*(F.endswith(name, F.lit(e)) for e in x))
    has = lambda c, *x: _any(*(F.contains(c, F.lit(e)) for e in x))
    zipped = ends(".gz", ".bgz")
    fastq = ends(".fastq.gz", ".fq.gz", ".fastq.bgz", ".fq.bgz") | (has(name, "fastq") & zipped)
    blocked = has(low, "bgzf") | ends(".bgz")
    joined = has(low, "concat", "multimember", "multi-member", "members")
    return (
        F.when(fastq & blocked, "fastq-bgzf").when(fastq & joined, "fastq-concat-gzip").when(fastq, "fastq-gzip")
        .when(blocked, "bgzf-gzip").when(joined, "concat-gzip").when(has(low, "stored"), "stored-gzip").when(has(low, "random"), "random-gzip")
        .when(has(low, "log", "text", "json", "tsv"), "text-gzip").when(zipped, "gzip").otherwise("unknown")
    )


def exit_code(kind: Column) -> Column:
    """Exit code of the command line for an error kind; 0 without an error."""
    out = F.lit(1)
    for name, code in EXIT_CODES.items():
        out = F.when(kind == name, code).otherwise(out)
    return F.when(kind.isNull(), 0).otherwise(out)
