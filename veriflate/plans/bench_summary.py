"""Benchmark summaries: typed CSV scans, grouped statistics, and ratios to
baselines of the same data. The groups are few (datasets x variants), so the
baseline joins are window functions over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import MODE_API, canonical_mode, default_mode, decimals, parse_bool, parse_number, quoted

RAW = ("dataset", "variant", "iteration", "threads", "wall_s", "exit_code")
_TEXT = {"dataset", "workload", "mode", "variant", "paths"}
_DOUBLE = {"wall_s", "cpu_s", "user_s", "system_s", "mib_s", "compression_ratio"}
_OPTIONAL = {"cpu_s", "user_s", "system_s", "mib_s"}
DECODE = ("dataset", "workload", "mode", "compressed_bytes", "variant", "iteration", "threads", "marker_enabled", "paths", "decoded_bytes", "members", "wall_s", "cpu_s", "user_s", "system_s", "mib_s", "peak_workers", "peak_buffered_bytes", "crc32", "exit_code")
WRITER = ("dataset", "input_bytes", "input_crc32", "variant", "level", "iteration", "wall_s", "cpu_s", "mib_s", "compressed_bytes", "compression_ratio", "exit_code")


def load(spark: SparkSession, path: str, columns: tuple[str, ...] = DECODE, own: str = "own") -> DataFrame:
    """Typed rows with row_no; absent columns get defaults, short rows are filled."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"').csv(path)
    missing = [c for c in ("dataset", "variant", "wall_s") if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")

    def typed(c: str) -> Column:
        if c not in raw.columns:
            if c == "mode":
                return default_mode(F.col("variant"), own).alias(c)
            return F.lit("unknown" if c == "workload" else "" if c in _TEXT else False if c == "marker_enabled" else None if c in _OPTIONAL else 0).alias(c)
        if c == "mode":
            return F.when(F.trim("mode") == "", default_mode(F.col("variant"), own)).otherwise(canonical_mode(F.col("mode"))).alias(c)
        if c in _TEXT:
            return F.coalesce(F.col(c), F.lit("")).alias(c)
        if c == "marker_enabled":
            return parse_bool(F.col(c)).alias(c)
        if c in _OPTIONAL:
            return F.nullif(F.trim(c), F.lit("")).cast("double").alias(c)
        return parse_number(F.col(c), "double" if c in _DOUBLE else "long", name=c).alias(c)

    return raw.select(F.monotonically_increasing_id().alias("row_no"), *map(typed, columns))


def _deviation(c: str) -> Column:
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def grouped(rows: DataFrame) -> DataFrame:
    """Statistics by dataset, workload, mode and variant; resource metrics count in the API mode alone, failed runs count as runs."""
    api = lambda c: F.avg(F.when(F.col("mode") == MODE_API, F.col(c))).alias(f"mean_{c}")
    first = lambda c: F.min_by(c, "row_no").alias(c)
    paths = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "paths"))), lambda s: s["paths"])), "|")
    top = [F.max(c).alias(c) for c in ("compressed_bytes", "decoded_bytes", "members", "peak_workers", "peak_buffered_bytes")]
    return rows.groupBy("dataset", "workload", "mode", "variant").agg(
        *top, F.count("*").alias("runs"), F.count_if(F.col("exit_code") != 0).alias("failed_runs"), first("threads"), first("marker_enabled"), paths.alias("paths"),
        F.avg("wall_s").alias("mean_wall_s"), _deviation("wall_s").alias("sd_wall_s"), F.min("wall_s").alias("min_wall_s"), F.max("wall_s").alias("max_wall_s"),
        *map(api, ("cpu_s", "user_s", "system_s", "mib_s")),
    )


def summary(rows: DataFrame, own: str = "own", base: str = "gunzip", rival: str = "pigz-") -> DataFrame:
    """grouped() with wall-time ratios to base, to rivals (one thread, the same
    threads, the best) and to the engine's own best and marker-free runs.
    Where a baseline has several rows, the last in sort order counts."""
    g = grouped(rows)
    wall = F.col("mean_wall_s")
    rivals, mine = F.startswith("variant", F.lit(rival)), F.startswith("variant", F.lit(own)) & ~F.col("marker_enabled")
    key = F.struct("workload", "dataset", "mode", "variant")

    def last(test: Column, *by: str) -> Column:
        return F.max_by(F.when(test, wall), F.when(test, key)).over(Window.partitionBy(*by))

    def best(test: Column, *by: str) -> Column:
        return F.min(F.when(test, wall)).over(Window.partitionBy(*by))

    g = g.withColumns({
        "speedup_vs_gunzip": last(F.col("variant") == base, "dataset") / wall,
        "speedup_vs_pigz_t1": last(rivals & (F.col("threads") == 1), "dataset") / wall,
        "speedup_vs_same_thread_pigz": last(rivals, "dataset", "threads") / wall,
        "speedup_vs_best_pigz": best(rivals, "dataset") / wall,
        "speedup_vs_best_default": best(mine, "dataset", "mode") / wall,
        "marker_wall_ratio_vs_default": F.when(F.col("marker_enabled"), wall / last(mine, "dataset", "mode", "threads")),
    })
    return g.orderBy("workload", "dataset", "mode", "variant")


def writer_summary(rows: DataFrame, base: str = "gzip", rival: str = "pigz-p1") -> DataFrame:
    """Writer runs by dataset, variant and level; failed runs count, but their figures do not."""
    good = lambda c: F.when(F.col("exit_code") == 0, F.col(c))
    g = rows.groupBy("dataset", "variant", "level").agg(
        F.max("input_bytes").alias("input_bytes"), F.count("*").alias("runs"), F.count_if(F.col("exit_code") != 0).alias("failed_runs"),
        F.avg(good("wall_s")).alias("mean_wall_s"), F.when(F.count(good("wall_s")) > 0, F.coalesce(F.stddev_samp(good("wall_s")), F.lit(0.0))).alias("sd_wall_s"),
        F.avg(good("mib_s")).alias("mean_mib_s"), F.avg(good("compression_ratio")).alias("mean_compression_ratio"),
    )
    w = Window.partitionBy("dataset", "level")
    to = lambda v: F.max(F.when(F.col("variant") == v, F.col("mean_wall_s"))).over(w) / F.col("mean_wall_s")
    return g.withColumn("speedup_vs_gzip", to(base)).withColumn("speedup_vs_pigz_p1", to(rival)).orderBy("dataset", "level", "variant")


def csv_value(rows: DataFrame, columns: tuple[str, ...] = DECODE, places: int = 6) -> Column:
    """rows as CSV lines in the given columns' order: texts in quotes, numbers
    with a fraction in fixed decimals, missing numbers empty."""
    kinds = dict(rows.dtypes)

    def cell(c: str) -> Column:
        if kinds[c] == "string":
            return quoted(F.col(c))
        text = decimals(F.col(c), places) if kinds[c] in ("double", "float") else F.col(c).cast("string")
        return F.when(F.col(c).isNull(), "").otherwise(text)

    return F.concat_ws(",", *map(cell, columns))


def write_csv(rows: DataFrame, path: str, columns: tuple[str, ...] = DECODE) -> None:
    """Text files of csv_value(), each file with the header that load() reads."""
    out = rows.select(csv_value(rows, columns).alias("value"))
    heading = ",".join(columns)

    def headed(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            if first and batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([heading], batch.schema.field(0).type)], schema=batch.schema)
                first = False
            yield batch

    out.mapInArrow(headed, "value string").write.text(path)
