"""The registered queries over the driver's tables, and their DuckDB SQL.

Each one sends real data through the writer and the verified reader and
compares what comes out with SQL over the original table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DecodeConfig, WriteConfig
from .functions import scalars as S
from .functions.gzip_columns import bgzf, gunzip, gzip, gzip_members, gzip_verify, write_concatenated
from .operators import streams
from .plans import bench_summary
from .sources import scan
from .sources.datasource import register
from .sources.framing import BGZF_PAYLOAD
from .sources.scratch import folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Words for bytes of a UTF-8 text in DuckDB.
_BYTES = "CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT)"


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, body, packed: each text as one member."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    return docs.withColumn("packed", gzip(F.col("body")))


@query(f"""SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS member_index,
  {_BYTES} AS decoded_length, md5(coalesce(text, '')) AS md5 FROM documents""")
def d03_member_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source", gunzip(F.col("packed")).alias("body"), gzip_verify(F.col("packed")).alias("r"))
    docs = docs.filter("r.status = 'OK'").select("source", "doc_id", F.col("r.decoded_bytes").alias("decoded_length"), F.md5("body").alias("md5"))
    return streams.offsets(docs, "source", "doc_id", F.col("decoded_length")).select("source", "member_index", "decoded_length", "md5")


@query(f"""SELECT doc_id, CAST(ceil({_BYTES} / {float(BGZF_PAYLOAD // 64)}) AS BIGINT) + 1 AS blocks, {_BYTES} AS decoded_bytes FROM documents""")
def d04_bgzf_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", bgzf(F.col("body"), BGZF_PAYLOAD // 64).alias("packed"))
    out = docs.select("doc_id", gzip_verify(F.col("packed")).alias("r"))
    return out.select("doc_id", F.col("r.members").alias("blocks"), F.col("r.decoded_bytes").alias("decoded_bytes"))


@query("SELECT page_id, true AS equal FROM pages")
def a01_crc_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("body"))
    found = gzip_members(pages.withColumn("packed", gzip(F.col("body"))), "page_id", "packed").select(F.col("path").cast("long").alias("_id"), F.col("crc32").alias("_crc"))
    return pages.join(found, F.col("page_id") == F.col("_id")).select("page_id", (F.crc32("body") == F.col("_crc")).alias("equal"))


@query(f"""SELECT source, count(*) AS member_count, CAST(sum({_BYTES}) AS BIGINT) AS decompressed_bytes, true AS crc_verified FROM documents GROUP BY source""")
def a03_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("source", gzip_verify(F.col("packed")).alias("r"))
    return docs.groupBy("source").agg(F.sum("r.members").alias("member_count"), F.sum("r.decoded_bytes").alias("decompressed_bytes"), F.bool_and(F.col("r.status") == "OK").alias("crc_verified"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", gunzip(F.col("packed")).cast("string").alias("text"))
    parts = F.split("text", "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return docs.select("doc_id", F.posexplode(parts).alias("line_no", "value")).withColumn("line_no", F.col("line_no").cast("long"))


_LINES = """WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
e AS (SELECT doc_id, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM d),
l AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS line_no, p[i] AS value FROM e, unnest(range(1, len(p) + 1)) AS t(i))
"""


@query(_LINES + "SELECT doc_id, line_no, value FROM l")
def s25_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir)


@query(_LINES + "SELECT doc_id, count(*) AS lines, CAST(sum(octet_length(encode(value)) + 1) AS BIGINT) AS bytes FROM l GROUP BY doc_id")
def a19_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.line_totals(_lines(spark, sf_dir), "doc_id")


@query(f"""SELECT source, CAST(row_number() OVER w - 1 AS BIGINT) AS member_index,
  CAST(coalesce(sum({_BYTES}) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS decoded_start
  FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)""")
def w02_member_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source", gzip_verify(F.col("packed")).alias("r"))
    return streams.offsets(docs, "source", "doc_id", F.col("r.decoded_bytes")).select("source", "member_index", "decoded_start")


@query(f"""WITH t AS (SELECT source, doc_id, sum({_BYTES}) OVER (PARTITION BY source ORDER BY doc_id) AS total FROM documents)
SELECT source, doc_id FROM t WHERE total <= 50000""")
def w03_output_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source", gzip_verify(F.col("packed")).alias("r"))
    return streams.within_limit(docs, "source", "doc_id", F.col("r.decoded_bytes"), 50000).select("source", "doc_id")


def _framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as four-line records, packed one record a member, read and framed again."""
    events = _table(spark, sf_dir, "events")
    text = F.concat_ws("\n", F.concat(F.lit("@"), F.col("event_id").cast("string")), "event_type", F.lit("+"), F.coalesce("props", F.lit("")), F.lit(""))
    packed = events.select("event_id", gunzip(gzip(text)).cast("string").alias("text"))
    rows = packed.select(F.col("event_id").alias("path"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "value")).filter("line_no < 4")
    return streams.records(rows)


@query("SELECT event_id AS path, CAST(0 AS BIGINT) AS record_no, '@' || event_id AS id, event_type AS seq, '+' AS plus, coalesce(props, '') AS qual FROM events")
def w05_record_framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _framed(spark, sf_dir)


@query("SELECT count(*) AS records, CAST(sum(length(event_type)) AS BIGINT) AS bases FROM events")
def a17_records_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.record_totals(_framed(spark, sf_dir))


@query("SELECT doc_id, CAST(2 AS BIGINT) AS members FROM documents")
def d05_false_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", F.concat(gzip(F.col("packed"), WriteConfig(level=0)), F.col("packed")).alias("packed"))
    found = gzip_members(docs, "doc_id", "packed").filter("status = 'OK'")
    return found.groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.count("*").alias("members"))


def _damaged(spark: SparkSession, sf_dir: str, change: Callable[[Column], Column]) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", change(F.col("packed")).alias("packed"))
    return docs.select("doc_id", gzip_verify(F.col("packed")).alias("r")).select("doc_id", F.col("r.error_kind").alias("error_kind"))


def _flip(data: Column, back: int) -> Column:
    """data with one bit of the byte back bytes before its end changed."""
    n = F.octet_length(data)
    byte = F.conv(F.hex(F.substring(data, n - back + 1, F.lit(1))), 16, 10).cast("int").bitwiseXOR(F.lit(1))
    fresh = F.unhex(F.lpad(F.hex(byte.cast("long")), 2, "0"))
    return F.concat(F.substring(data, F.lit(1), n - back), fresh, F.substring(data, n - back + 2, F.lit(back)))


@query("SELECT doc_id, 'checksum_mismatch' AS error_kind FROM documents")
def c01_bad_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _damaged(spark, sf_dir, lambda d: _flip(d, 8))


@query("SELECT doc_id, 'size_mismatch' AS error_kind FROM documents")
def c02_bad_isize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _damaged(spark, sf_dir, lambda d: _flip(d, 4))


@query("SELECT doc_id, 'truncated_input' AS error_kind FROM documents")
def c03_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _damaged(spark, sf_dir, lambda d: F.substring(d, F.lit(1), F.octet_length(d) - 1))


@query("SELECT doc_id, 'invalid_header' AS error_kind FROM documents")
def c04_junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _damaged(spark, sf_dir, lambda d: F.concat(d, F.lit("junk").cast("binary")))


def _any_like(names: tuple[str, ...], column: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in names) + ")"


_CLASS = f"""WITH n AS (SELECT page_id, lower(p) AS low, list_extract(string_split(lower(p), '/'), -1) AS name FROM
  (SELECT page_id, coalesce(url, '') || CASE page_id % 5 WHEN 0 THEN '.fastq.gz' WHEN 1 THEN '.bgz' WHEN 2 THEN '-members.gz' WHEN 3 THEN '.gz' ELSE '' END AS p FROM pages)),
c AS (SELECT *, (suffix(name, '.gz') OR suffix(name, '.bgz')) AS z, {_any_like(("bgzf",), "low")} OR suffix(name, '.bgz') AS b, {_any_like(("concat", "multimember", "multi-member", "members"), "low")} AS j,
  suffix(name, '.fastq.gz') OR suffix(name, '.fq.gz') OR suffix(name, '.fastq.bgz') OR suffix(name, '.fq.bgz') OR (contains(name, 'fastq') AND (suffix(name, '.gz') OR suffix(name, '.bgz'))) AS f FROM n)
SELECT page_id, CASE WHEN f AND b THEN 'fastq-bgzf' WHEN f AND j THEN 'fastq-concat-gzip' WHEN f THEN 'fastq-gzip' WHEN b THEN 'bgzf-gzip' WHEN j THEN 'concat-gzip'
  WHEN contains(low, 'stored') THEN 'stored-gzip' WHEN contains(low, 'random') THEN 'random-gzip' WHEN {_any_like(("log", "text", "json", "tsv"), "low")} THEN 'text-gzip' WHEN z THEN 'gzip' ELSE 'unknown' END AS class FROM c"""


@query(_CLASS.replace("suffix(", "ends_with("))
def p06_classify_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.element_at(F.array(*map(F.lit, (".fastq.gz", ".bgz", "-members.gz", ".gz", ""))), (F.col("page_id") % 5 + 1).cast("int"))
    return _table(spark, sf_dir, "pages").select("page_id", S.workload(F.concat(F.coalesce("url", F.lit("")), tail)).alias("class"))


@query("""SELECT event_id, CAST(event_id AS VARCHAR) || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'K' WHEN 2 THEN ' MiB' ELSE 'gb' END AS text,
  CAST(event_id * CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END AS BIGINT) AS bytes FROM events""")
def f01_parse_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("", "K", " MiB", "gb"))), (F.col("event_id") % 4 + 1).cast("int"))
    text = F.concat(F.col("event_id").cast("string"), unit)
    return _table(spark, sf_dir, "events").select("event_id", text.alias("text"), S.parse_size(text).alias("bytes"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as benchmark runs: the type is the variant, the value the wall time."""
    e = _table(spark, sf_dir, "events")
    names = ("gunzip", "pigz-t1", "pigz-t4", "own-t1", "own-t4")
    variant = F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.col("user_id"), F.lit(5)) + 1).cast("int"))
    threads = F.when(F.endswith(variant, F.lit("t4")), 4).when(F.endswith(variant, F.lit("t1")), 1).otherwise(0)
    zero = F.lit(0).cast("long")
    return e.select(
        F.col("event_id").alias("row_no"), F.col("event_type").alias("dataset"), F.lit("unknown").alias("workload"), S.default_mode(variant, "own").alias("mode"), variant.alias("variant"),
        threads.cast("long").alias("threads"), F.lit(False).alias("marker_enabled"), F.lit("sequential").alias("paths"), F.col("value").alias("wall_s"), (F.col("event_id") % 7 == 0).cast("long").alias("exit_code"),
        F.col("value").alias("cpu_s"), F.lit(None).cast("double").alias("user_s"), F.lit(None).cast("double").alias("system_s"), F.lit(None).cast("double").alias("mib_s"),
        F.col("event_id").alias("compressed_bytes"), F.col("user_id").alias("decoded_bytes"), zero.alias("members"), zero.alias("peak_workers"), zero.alias("peak_buffered_bytes"),
    )


_SUMMARY = """WITH r AS (SELECT event_type AS dataset, event_id, user_id, value,
  CASE ((user_id % 5) + 5) % 5 WHEN 0 THEN 'gunzip' WHEN 1 THEN 'pigz-t1' WHEN 2 THEN 'pigz-t4' WHEN 3 THEN 'own-t1' ELSE 'own-t4' END AS variant FROM events),
g AS (SELECT dataset, variant, CASE WHEN variant LIKE 'own%' THEN 'api-read-crc' ELSE 'cli-stdout-null' END AS mode,
  CASE WHEN variant LIKE '%t4' THEN 4 WHEN variant LIKE '%t1' THEN 1 ELSE 0 END AS threads,
  count(*) AS runs, count(*) FILTER (event_id % 7 = 0) AS failed_runs, max(event_id) AS compressed_bytes, avg(value) AS m,
  coalesce(stddev_samp(value), 0) AS sd, min(value) AS lo, max(value) AS hi, avg(value) FILTER (variant LIKE 'own%') AS cpu FROM r GROUP BY dataset, variant),
s AS (SELECT *, max(m) FILTER (variant = 'gunzip') OVER d / m AS vs_base, max(m) FILTER (variant = 'pigz-t1') OVER d / m AS vs_one,
  max(m) FILTER (variant LIKE 'pigz-%') OVER (PARTITION BY dataset, threads) / m AS vs_same, min(m) FILTER (variant LIKE 'pigz-%') OVER d / m AS vs_best,
  min(m) FILTER (variant LIKE 'own%') OVER (PARTITION BY dataset, mode) / m AS vs_own FROM g WINDOW d AS (PARTITION BY dataset))
SELECT dataset, mode, variant, runs, failed_runs, compressed_bytes, round(m, 6) AS mean_wall_s, round(sd, 6) AS sd_wall_s, lo AS min_wall_s, hi AS max_wall_s, round(cpu, 6) AS mean_cpu_s,
  round(vs_base, 6) AS speedup_vs_gunzip, round(vs_one, 6) AS speedup_vs_pigz_t1, round(vs_same, 6) AS speedup_vs_same_thread_pigz, round(vs_best, 6) AS speedup_vs_best_pigz, round(vs_own, 6) AS speedup_vs_best_default
FROM s """


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = ("mean_wall_s", "sd_wall_s", "mean_cpu_s", "speedup_vs_gunzip", "speedup_vs_pigz_t1", "speedup_vs_same_thread_pigz", "speedup_vs_best_pigz", "speedup_vs_best_default")
    keep = ("dataset", "mode", "variant", "runs", "failed_runs", "compressed_bytes", "min_wall_s", "max_wall_s")
    return bench_summary.summary(_runs(spark, sf_dir)).select(*keep, *(F.round(c, 6).alias(c) for c in rounded))


@query(_SUMMARY)
def a07_bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir)


@query(_SUMMARY + "ORDER BY dataset, mode, variant LIMIT 10")
def l01_summary_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir).orderBy("dataset", "mode", "variant").limit(10)


@query("""SELECT dataset, variant, level, runs, failed_runs, round(m, 6) AS mean_wall_s, round(sd, 6) AS sd_wall_s, round(max(m) FILTER (variant = 'gzip') OVER w / m, 6) AS speedup_vs_gzip FROM (
  SELECT event_type AS dataset, CASE WHEN user_id % 2 = 0 THEN 'gzip' ELSE 'own' END AS variant, CAST(user_id % 3 AS BIGINT) AS level, count(*) AS runs, count(*) FILTER (event_id % 7 = 0) AS failed_runs,
  avg(value) FILTER (event_id % 7 <> 0) AS m, CASE WHEN count(*) FILTER (event_id % 7 <> 0) > 0 THEN coalesce(stddev_samp(value) FILTER (event_id % 7 <> 0), 0) END AS sd FROM events GROUP BY ALL) WINDOW w AS (PARTITION BY dataset, level)""")
def a16_writer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select(
        F.col("event_type").alias("dataset"), F.when(F.col("user_id") % 2 == 0, "gzip").otherwise("own").alias("variant"), (F.col("user_id") % 3).alias("level"), (F.col("event_id") % 7 == 0).cast("long").alias("exit_code"),
        F.col("value").alias("wall_s"), F.col("value").alias("mib_s"), F.col("value").alias("compression_ratio"), F.lit(0).alias("input_bytes"),
    )
    out = bench_summary.writer_summary(e)
    return out.select("dataset", "variant", "level", "runs", "failed_runs", *(F.round(c, 6).alias(c) for c in ("mean_wall_s", "sd_wall_s", "speedup_vs_gzip")))


@query("SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def u03_distinct_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("kinds"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS rows, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def k01_text_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as gzip CSV files and back through the verified members of those files."""
    path = folder(spark)
    cols = ("l_returnflag", "l_linestatus", "l_quantity")
    _table(spark, sf_dir, "lineitem").select(*cols).write.option("compression", "gzip").csv(path)
    cells = F.split(F.col("value").cast("string"), ",")
    rows = scan.lines(scan.members(spark, path + "/*.csv.gz")).select(*(cells[i].alias(c) for i, c in enumerate(cols)))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("rows"), F.round(F.sum(F.col("l_quantity").cast("double")), 2).alias("quantity"))


@query("SELECT doc_id, md5(replace(coalesce(text, ''), chr(10), ' ')) AS md5 FROM documents")
def k19_bgzf_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lines of BGZF files, read back in ranges of blocks."""
    path = folder(spark)
    docs = _table(spark, sf_dir, "documents")
    lines = docs.select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.translate(F.coalesce("text", F.lit("")), "\n", " ")).alias("value"))
    register(spark)
    lines.write.format("verified_gzip").option("path", path).option("bgzf", "true").mode("append").save()
    config = DecodeConfig(task_bytes=256 * 1024)
    rows = scan.lines(scan.members(spark, path + "/*.bgz", config), config)
    cells = F.split(F.col("value").cast("string"), "\t", 2)
    return rows.select(cells[0].cast("long").alias("doc_id"), F.md5(cells[1]).alias("md5"))


@query(f"SELECT source, count(*) AS member_count, CAST(sum({_BYTES}) AS BIGINT) AS decompressed_bytes, true AS crc_verified FROM documents GROUP BY source")
def s03_member_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concatenated members in bounded files per source, planned by candidates and
    chained; per source: members, bytes, and whether all checksums hold."""
    path = folder(spark)
    docs = _documents(spark, sf_dir).select("source", "doc_id", gunzip(F.col("packed")).alias("raw"))
    write_concatenated(docs, "source", "doc_id", "raw", path).count()
    config = DecodeConfig(grid_size=4096)
    found = scan.members(spark, path + "/*/*.gz", config)
    sums = scan.report(found, scan.list_files(spark, path + "/*/*.gz")).withColumn("source", F.regexp_extract("path", r"([^/]+)/[^/]+\.gz$", 1))
    return sums.groupBy("source").agg(F.sum("member_count").alias("member_count"), F.sum("decompressed_bytes").alias("decompressed_bytes"), F.bool_and("crc_verified").alias("crc_verified"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: every document through the writer and the verified reader."""
    return d03_member_roundtrip(spark, sf_dir)
