"""Registered queries of the scalar functions, benchmark tables, generators and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DecodeConfig, WriteConfig
from .errors import EXIT_CODES, KINDS, ConfigError
from .functions import scalars as S
from .functions.gzip_columns import gzip
from .plans import bench_summary, fixtures, generators
from .queries import _BYTES, _documents, _runs, _table, query
from .sources.scratch import folder


def _pick(values: tuple, by: str) -> Column:
    """The values in turn, by a number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col(by), F.lit(len(values))) + 1).cast("int"))


def _case(values: tuple, by: str) -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values)) + " END"


def _events(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", *(c.alias(n) for n, c in columns.items()))


_ALIASES = tuple((f" {name.upper()} ", mode) for mode, names in S.MODE_ALIASES.items() for name in names)


@query(f"SELECT event_id, {_case(tuple(m for _, m in _ALIASES), 'event_id')} AS mode FROM events")
def p08_mode_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, mode=S.canonical_mode(_pick(tuple(a for a, _ in _ALIASES), "event_id")))


@query("SELECT event_id, 'dir.gz/' || event_id AS path FROM events")
def f02_strip_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, path=S.output_path(F.concat(F.lit("dir.gz/"), F.col("event_id").cast("string"), _pick((".gz", ".bgz"), "event_id"))))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'bgzf' ELSE 'bgzf+sequential' END AS paths FROM events")
def f03_path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.slice(F.array(F.lit("bgzf"), F.lit("sequential")), F.lit(1), F.pmod("event_id", F.lit(3)).cast("int"))
    return _events(spark, sf_dir, paths=S.path_names(names))


@query("SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 0.0 ELSE CAST(event_id AS DOUBLE) / 1048576.0 / CAST(user_id % 4 AS DOUBLE) END AS mib_s FROM events")
def f04_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, mib_s=S.throughput(F.col("event_id").cast("double"), (F.col("user_id") % 4).cast("double")))


@query("SELECT event_id, printf('%.6f', value) AS six, printf('%.2f', value) AS two FROM events")
def f05_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, six=S.decimals(F.col("value")), two=S.decimals(F.col("value"), 2))


@query("""SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') > 0
  THEN printf('%.6f', CAST(coalesce(sum(event_id % 8) FILTER (event_type = 'error'), 0) AS DOUBLE) / CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) * 1.0) ELSE '' END AS mean FROM events GROUP BY user_id""")
def f06_mean_or_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("event_type") == "error"
    sums = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.when(error, F.col("event_id") % 8)).cast("double").alias("total"), F.count_if(error).alias("n"))
    return sums.select("user_id", S.mean_text(F.col("total"), F.col("n")).alias("mean"))


@query("SELECT event_id, CASE WHEN event_id % 5 > 1 THEN printf('%.4f', CAST(event_id % 5 - 1 AS DOUBLE) / 4) ELSE '' END AS ratio FROM events")
def f07_ratio_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, ratio=S.ratio_text((F.col("event_id") % 5 - 1).cast("double") / 4))


@query("""SELECT event_id, '"' || replace(props, '"', '""') || '"' AS cell FROM events""")
def f08_csv_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, cell=S.quoted(F.col("props")))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN -1 ELSE event_id END AS number, CASE event_id % 3 WHEN 0 THEN 0.0 ELSE value END AS real FROM events")
def f09_parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.concat(F.lit(" "), F.col(c).cast("string"), F.lit(" ")))
    return _events(spark, sf_dir, number=S.parse_number(text("event_id"), "long", -1, "event_id"), real=S.parse_number(text("value"), name="value"))


_BOOLEANS = (("TRUE", "true"), (" yes", "true"), ("1", "true"), ("No ", "false"), ("0", "false"), ("", "false"), ("false", "false"))


@query("SELECT event_id, " + _case(tuple(v for _, v in _BOOLEANS), "event_id") + " = 'true' AS flag FROM events")
def f10_parse_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, flag=S.parse_bool(_pick(tuple(t for t, _ in _BOOLEANS), "event_id")))


@query("SELECT event_id, event_id % 7 + 1 || '|9' AS counts, 'api|' || event_type AS names FROM events WHERE event_id % 7 <> 8")
def f11_parse_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("event_id") % 7 + 1).cast("string")
    counts = S.parse_counts(F.concat(number, F.lit(", 9 ,,"), number))
    names = S.parse_list(F.concat(F.lit("api, "), F.col("event_type"), F.lit(" ,api")))
    return _events(spark, sf_dir, counts=F.array_join(F.transform(counts, lambda x: x.cast("string")), "|"), names=F.array_join(names, "|"))


@query(f"SELECT doc_id, CASE WHEN {_BYTES} = 0 THEN 0.0 ELSE 1.0 END AS ratio, true AS smaller FROM documents")
def f13_compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ratio of equal sizes is 1, of an empty input 0; stored members are larger than their input by what frames them."""
    docs = _documents(spark, sf_dir)
    n, packed = F.octet_length("body"), F.octet_length(gzip(F.col("body"), WriteConfig(level=0)))
    return docs.select("doc_id", S.compression_ratio(n, n).cast("double").alias("ratio"), ((n == 0) | (S.compression_ratio(packed, n) > 1)).alias("smaller"))


@query("SELECT event_id, (event_id * 1000000007) % 4294967296 AS isize FROM events")
def f14_isize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, isize=S.isize(F.col("event_id") * 1000000007))


@query("SELECT event_id, CAST(greatest(1, least(user_id % 64, ceil(2 * sqrt(user_id % 64)), event_id % 9)) AS BIGINT) AS workers FROM events")
def f18_worker_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, workers=S.worker_target(F.col("user_id") % 64, F.col("event_id") % 9))


@query("SELECT event_id, printf('%02d', event_id % 120) AS text FROM events")
def f20_two_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, text=S.two_digits(F.col("event_id") % 120))


@query(f"SELECT event_id, CAST({_case(tuple(EXIT_CODES.get(k, 1) for k in KINDS), 'event_id')} AS BIGINT) AS code FROM events")
def f22_exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, code=S.exit_code(_pick(KINDS, "event_id")).cast("long"))


_OPTIONS = (
    ("threads", -1, False), ("threads", 0, True), ("chunk_size", 4095, False), ("chunk_size", 4096, True), ("grid_size", 1023, False), ("grid_size", 1024, True), ("page_size", 100, False),
    ("max_speculative_output", 1, False), ("output_limit", 0, False), ("output_limit", 1, True), ("memory_limit", -1, False), ("max_header_size", 1023, False), ("max_header_size", 1 << 27, False), ("task_bytes", 0, False),
    ("in_flight_chunks", -1, False), ("in_flight_chunks", 4, True), ("level", 10, False), ("level", 9, True), ("strategy", 5, False), ("buffer_size", 0, False), ("buffer_size", 1, True),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', CAST({v} AS BIGINT), {str(ok).lower()})" for n, v, ok in _OPTIONS) + ") AS t(name, value, accepted)")
def p12_option_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def accepted(name: str, value: int) -> bool:
        try:
            (WriteConfig if name in ("level", "strategy", "buffer_size") else DecodeConfig)(**{name: value})
        except ConfigError:
            return False
        return True

    return spark.createDataFrame([(n, v, accepted(n, v)) for n, v, _ in _OPTIONS], "name string, value long, accepted boolean")


#: The generator's lines in SQL; i is the line's number.
_LOG = """printf('2026-08-07T12:%02d:%02dZ %s sample=%d lane=%d reads=%d bytes=%d %s', (i // 60) % 60, i % 60, CASE i % 4 WHEN 0 THEN 'INFO' WHEN 1 THEN 'DEBUG' WHEN 2 THEN 'WARN' ELSE 'ERROR' END,
  i % 97, i % 8 + 1, i * 13 % 100000, i * 7919 % 1000003, CASE i % 4 WHEN 0 THEN 'chunk ready' WHEN 1 THEN 'queue depth' WHEN 2 THEN 'slow read' ELSE 'retry' END)"""


@query(f"SELECT i AS line_no, {_LOG} AS value FROM range(5000) AS t(i)")
def s26_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.log_lines(spark, 5000)


@query("""WITH RECURSIVE s(i, x) AS (SELECT CAST(0 AS BIGINT), (1664525 * CAST(305419896 AS BIGINT) + 1013904223) % 4294967296 UNION ALL SELECT i + 1, (1664525 * x + 1013904223) % 4294967296 FROM s WHERE i < 2999)
SELECT i AS place, x >> 24 AS byte FROM s""")
def s27_random_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = generators.random_blocks(spark, 3000, 1000)
    cells = F.posexplode(F.split(F.regexp_replace(F.hex("data"), "(..)(?=.)", "$1,"), ","))
    return blocks.select("offset", cells.alias("k", "h")).select((F.col("offset") + F.col("k")).alias("place"), F.conv("h", 16, 10).cast("long").alias("byte"))


@query(f"""WITH l AS (SELECT i, length({_LOG}) + 1 AS n FROM range(4000) AS t(i)), s AS (SELECT n, sum(n) OVER (ORDER BY i) - n AS before FROM l)
SELECT CAST(sum(n) AS BIGINT) AS bytes, true AS equal FROM s WHERE before < 100000""")
def s28_record_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records up to a size, with a checksum that runs over parts in order."""
    lines = generators.record_set(spark, "log", 100_000)
    whole = lines.groupBy().agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"])).alias("text"))
    sums = generators.record_crc(lines).withColumn("_one", F.lit(1))
    both = sums.join(whole.withColumn("_one", F.lit(1)), "_one")
    return both.select("bytes", (F.col("crc32") == F.crc32(F.concat(F.col("text"), F.lit("\n")).cast("binary"))).alias("equal"))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark)
    docs = _documents(spark, sf_dir).select("doc_id", F.octet_length("body").alias("n"))
    i = F.col("doc_id").cast("string")
    line = F.concat(F.lit("name=doc"), i, F.lit(" file=doc"), i, F.lit(".gz  bytes="), F.col("n").cast("string"), F.lit(" decoded="), F.col("n").cast("string"), F.lit(" crc32="), F.lower(F.hex("doc_id")))
    lines = docs.select(F.explode(F.array(F.lit("# a remark"), line, F.lit(""))).alias("value"))
    lines.write.text(path)
    return fixtures.manifest(spark, path)


@query(f"SELECT 'doc' || doc_id AS name, 'doc' || doc_id || '.gz' AS file, {_BYTES} AS bytes, {_BYTES} AS decoded, doc_id AS crc32 FROM documents")
def s24_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _manifest(spark, sf_dir)


@query(f"SELECT 'doc' || doc_id AS name, {_BYTES} AS decoded FROM documents WHERE doc_id = 7")
def j10_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.lookup(_manifest(spark, sf_dir), "doc7").select("name", "decoded")


def _full_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).withColumns({"iteration": F.col("row_no"), "crc32": F.lit(0).cast("long"), "dataset": F.concat("dataset", F.lit(' "x", y'))})


def _back(spark: SparkSession, rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    path = folder(spark)
    bench_summary.write_csv(rows, path, columns)
    return bench_summary.load(spark, path, columns)


@query("""SELECT event_id AS iteration, event_type || ' "x", y' AS dataset, value AS wall_s, event_id AS compressed_bytes, CAST(event_id % 7 = 0 AS BIGINT) AS exit_code, false AS marker_enabled FROM events""")
def s22_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark rows as CSV and back, typed."""
    found = _back(spark, _full_runs(spark, sf_dir), bench_summary.DECODE)
    return found.select("iteration", "dataset", "wall_s", "compressed_bytes", "exit_code", "marker_enabled")


@query("""SELECT event_id AS iteration, event_type AS dataset, CAST(user_id % 3 AS BIGINT) AS level, value AS wall_s, round(value / 4, 6) AS compression_ratio FROM events""")
def s23_writer_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _back(spark, _writer_runs(spark, sf_dir), bench_summary.WRITER)
    return found.select("iteration", "dataset", "level", "wall_s", F.round("compression_ratio", 6).alias("compression_ratio"))


def _writer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    long = lambda c: c.cast("long")
    return e.select(
        F.col("event_type").alias("dataset"), long(F.lit(1)).alias("input_bytes"), long(F.lit(0)).alias("input_crc32"), _pick(("gzip", "pigz-p1", "own"), "user_id").alias("variant"),
        long(F.col("user_id") % 3).alias("level"), F.col("event_id").alias("iteration"), F.col("value").alias("wall_s"), F.col("value").alias("cpu_s"), F.col("value").alias("mib_s"),
        long(F.lit(1)).alias("compressed_bytes"), (F.col("value") / 4).alias("compression_ratio"), long(F.col("event_id") % 7 == 0).alias("exit_code"),
    )


@query("""SELECT event_id, '"' || event_type || '",' || printf('%.6f', value) || ',' || CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE '' END AS value FROM events""")
def k17_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("user"))
    return rows.select("event_id", bench_summary.csv_value(rows, ("event_type", "value", "user")).alias("value"))


@query("""WITH r AS (SELECT event_type AS dataset, event_id, user_id, value, CASE user_id % 3 WHEN 0 THEN 'gzip' WHEN 1 THEN 'pigz-p1' ELSE 'own' END AS variant, CAST(user_id % 3 AS BIGINT) AS level FROM events WHERE event_id % 7 <> 0),
g AS (SELECT dataset, variant, avg(value) AS m FROM r GROUP BY 1, 2)
SELECT dataset, variant, round(max(m) FILTER (variant = 'pigz-p1') OVER w / m, 6) AS speedup_vs_pigz_p1, round(max(m) FILTER (variant = 'gzip') OVER w / m, 6) AS speedup_vs_gzip FROM g WINDOW w AS (PARTITION BY dataset)""")
def j09_writer_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bench_summary.writer_summary(_writer_runs(spark, sf_dir).withColumn("level", F.lit(6)))
    return out.select("dataset", "variant", *(F.round(c, 6).alias(c) for c in ("speedup_vs_pigz_p1", "speedup_vs_gzip")))


@query("""WITH g AS (SELECT event_type AS dataset, user_id % 3 AS level, CASE user_id % 3 WHEN 0 THEN 'gzip' WHEN 1 THEN 'pigz-p1' ELSE 'own' END AS variant, count(*) AS runs FROM events GROUP BY ALL)
SELECT dataset, level, variant, runs FROM g ORDER BY dataset, level, variant LIMIT 7""")
def l02_writer_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench_summary.writer_summary(_writer_runs(spark, sf_dir)).select("dataset", "level", "variant", "runs").orderBy("dataset", "level", "variant").limit(7)


_MARKED = ("own-t4", "own-t8", "own-marker-t4", "own-marker-t8")


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    variant = _pick(_MARKED, "user_id")
    threads = F.when(F.endswith(variant, F.lit("t4")), 4).otherwise(8).cast("long")
    paths = F.when(F.col("event_id") % 3 == 0, "b").when(F.col("event_id") % 3 == 1, "a").otherwise("b+c")
    return _runs(spark, sf_dir).withColumns({"user_id": F.col("decoded_bytes"), "event_id": F.col("row_no")}).withColumns({"variant": variant, "threads": threads, "marker_enabled": F.contains(variant, F.lit("marker")), "mode": F.lit(S.MODE_API), "paths": paths})


@query(f"""WITH r AS (SELECT event_type AS dataset, {_case(_MARKED, 'user_id')} AS variant, value FROM events), g AS (SELECT dataset, variant, variant LIKE '%marker%' AS marked, right(variant, 2) AS t, avg(value) AS m FROM r GROUP BY ALL)
SELECT dataset, variant, round(CASE WHEN marked THEN m / max(m) FILTER (NOT marked) OVER (PARTITION BY dataset, t) END, 6) AS marker_wall_ratio_vs_default FROM g""")
def j08_marker_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench_summary.summary(_marked(spark, sf_dir)).select("dataset", "variant", F.round("marker_wall_ratio_vs_default", 6).alias("marker_wall_ratio_vs_default"))


@query(f"""WITH r AS (SELECT event_id, event_type AS dataset, {_case(_MARKED, 'user_id')} AS variant, CASE event_id % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'a' ELSE 'b+c' END AS paths FROM events),
f AS (SELECT dataset, variant, paths, min(event_id) AS first FROM r GROUP BY ALL)
SELECT dataset, variant, string_agg(paths, '|' ORDER BY first) AS paths FROM f GROUP BY dataset, variant""")
def a14_distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench_summary.grouped(_marked(spark, sf_dir)).select("dataset", "variant", "paths")


@query("SELECT event_type AS dataset, CAST(arg_min(user_id, event_id) AS BIGINT) AS threads FROM events GROUP BY event_type")
def a13_first_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _marked(spark, sf_dir).withColumns({"threads": F.col("decoded_bytes"), "variant": F.lit("own")})
    return bench_summary.grouped(rows).select("dataset", "threads")


@query("SELECT dataset, CAST(max(user_id) AS BIGINT) AS decoded_bytes, CAST(max(event_id) AS BIGINT) AS peak_buffered_bytes, CAST(max(user_id % 5) AS BIGINT) AS peak_workers FROM (SELECT *, event_type AS dataset FROM events) GROUP BY dataset")
def a06_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _marked(spark, sf_dir).withColumns({"variant": F.lit("own"), "peak_buffered_bytes": F.col("row_no"), "peak_workers": F.col("decoded_bytes") % 5})
    return bench_summary.grouped(rows).select("dataset", "decoded_bytes", "peak_buffered_bytes", "peak_workers")
