"""Order-dependent operators on member and line tables.

Running sums have two levels: rows are dealt into ranges of (group, order), and
a range starts with the sums of the ranges before it. So a group that holds
most rows never sits in one task; only one row a range and group is gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def running(df: DataFrame, group: str, order: str, length: Column) -> DataFrame:
    """df with _rows and _sum: the rows, and the sum of length, before each row of its group."""
    ranged = df.withColumn("_length", F.coalesce(length.cast("long"), F.lit(0).cast("long"))).repartitionByRange(group, order)
    ranged = stored(ranged.withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"), F.sum("_length").alias("_s"))
    w = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_g", "_r", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(a) for c, a in (("_n", "_rows0"), ("_s", "_sum0"))))
    w = Window.partitionBy(group, "_range").orderBy(order)
    inside = ranged.withColumn("_rows", F.row_number().over(w) - 1)
    inside = inside.withColumn("_sum", F.coalesce(F.sum("_length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    both = inside.join(sums, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return both.withColumns({"_rows": F.col("_rows") + F.col("_rows0"), "_sum": F.col("_sum") + F.col("_sum0")})


def offsets(df: DataFrame, group: str, order: str, length: Column) -> DataFrame:
    """df with member_index and decoded_start within the group, in order."""
    return running(df, group, order, length).select(*df.columns, F.col("_rows").cast("long").alias("member_index"), F.col("_sum").cast("long").alias("decoded_start"))


def within_limit(df: DataFrame, group: str, order: str, length: Column, limit: int) -> DataFrame:
    """The leading rows of each group whose lengths sum to at most limit."""
    return running(df, group, order, length).filter(F.col("_sum") + F.col("_length") <= limit).select(*df.columns)


def records(lines: DataFrame, group: str = "path", size: int = 4, names: tuple[str, ...] = ("id", "seq", "plus", "qual")) -> DataFrame:
    """group, record_no and names from each size lines; a trailing part is dropped."""
    number = F.floor(F.col("line_no") / size).cast("long").alias("record_no")
    cell = lambda i: F.max(F.when(F.col("line_no") % size == i, F.col("value"))).alias(names[i])
    return lines.groupBy(group, number).agg(F.count("*").alias("_n"), *map(cell, range(size))).filter(F.col("_n") == size).drop("_n")


def record_totals(found: DataFrame) -> DataFrame:
    """records, bases of records()."""
    return found.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases"))


def line_totals(lines: DataFrame, group: str) -> DataFrame:
    """group, lines, bytes (each line with its newline)."""
    return lines.groupBy(group).agg(F.count("*").alias("lines"), F.sum(F.octet_length("value") + 1).alias("bytes"))


def ordered(df: DataFrame, group: str, ordinal: str) -> DataFrame:
    """One row per (group, ordinal), in order within partitions: late duplicates are dropped."""
    return df.dropDuplicates([group, ordinal]).repartition(group).sortWithinPartitions(group, ordinal)
