import gzip
import json
import os
import zlib

import pytest
from pyspark.sql import functions as F

from veriflate.config import DecodeConfig, WriteConfig
from veriflate.functions import scalars as S
from veriflate.functions.gzip_columns import gunzip, gzip_members, gzip_verify, write_concatenated
from veriflate.functions.gzip_columns import gzip as zipped
from veriflate.operators import streams
from veriflate.plans import bench_summary, generators
from veriflate.sources import scan
from veriflate.sources.datasource import register
from veriflate.sources.deflate_writer import bgzf, bgzf_block, compress
from veriflate.sources.framing import bgzf_link
from veriflate.streaming.watch import verified_files

BODY = b"".join(b"line %d of the file\n" % i for i in range(4000)) + b"no newline at the end"


@pytest.fixture()
def folder(tmp_path):
    files = {
        "plain.gz": compress(BODY),
        "blocks.gz": bgzf(BODY, payload=3000),
        "members.gz": b"".join(compress(BODY[i : i + 9000], WriteConfig(level=1)) for i in range(0, len(BODY), 9000)),
        "mixed.gz": bgzf(BODY[:50000], payload=3000) + compress(BODY[50000:]),
        "trap.gz": compress(compress(BODY[:20000]) * 2, WriteConfig(level=0)) + compress(BODY[20000:], WriteConfig(level=0)),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path


@pytest.mark.parametrize("config", [DecodeConfig(threads=1), DecodeConfig(grid_size=2048, task_bytes=4096, chunk_size=4096)])
def test_members_chunks_and_lines(spark, folder, config):
    found = scan.members(spark, str(folder), config).cache()
    assert found.filter("status <> 'OK'").count() == 0
    report = {os.path.basename(r.path): r for r in scan.report(found, scan.list_files(spark, str(folder))).collect()}
    for name, r in report.items():
        data = (folder / name).read_bytes()
        assert r.crc_verified and r.compressed_bytes == len(data) and r.decompressed_bytes == len(gzip.decompress(data))
    if config.threads != 1:
        assert report["blocks.gz"].paths_used == ["bgzf"] and report["mixed.gz"].paths_used == ["bgzf", "sequential"]
        assert report["members.gz"].paths_used == ["multi_member"]
    for r in scan.stream_crc(found).collect():
        data = gzip.decompress((folder / os.path.basename(r.path)).read_bytes())
        assert (r.crc32, r.length) == (zlib.crc32(data), len(data))
    parts = scan.chunks(found, config)
    whole = parts.groupBy("path").agg(F.sum(F.octet_length("data")).alias("n"), F.count("*").alias("chunks")).collect()
    assert all(r.n == report[os.path.basename(r.path)].decompressed_bytes for r in whole)
    lines = scan.lines(found.filter(~F.col("path").endswith("trap.gz")), config)
    for path, rows in lines.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line_no", "value")))).collect():
        assert [bytes(r.value) for r in rows] == BODY.split(b"\n"), path
        assert [r.line_no for r in rows] == list(range(len(rows)))


def test_damage_ends_a_file(spark, tmp_path):
    good = compress(BODY[:9000])
    (tmp_path / "bad.gz").write_bytes(good + good[:-3] + b"abc")
    (tmp_path / "empty.gz").write_bytes(b"")
    (tmp_path / "blocks.gz").write_bytes(b"".join([bgzf(BODY, payload=5000)[:-40], b"x" * 40]))
    found = scan.members(spark, str(tmp_path), DecodeConfig(grid_size=1024, task_bytes=2000))
    bad = {os.path.basename(r.path): r for r in found.filter("status = 'ERROR'").collect()}
    assert bad["bad.gz"].error_kind in ("checksum_mismatch", "size_mismatch") and bad["bad.gz"].member_index == 1
    assert bad["empty.gz"].error_kind == "truncated_input"
    assert "blocks.gz" in bad
    assert all(not r.crc_verified for r in scan.report(found, scan.list_files(spark, str(tmp_path))).collect())


def test_output_limit_over_members(spark, folder):
    found = scan.members(spark, str(folder / "members.gz"), DecodeConfig(grid_size=2048, output_limit=20000))
    rows = found.orderBy("member_index").collect()
    assert [r.status for r in rows] == ["OK", "OK", "ERROR"] and rows[-1].error_kind == "output_limit"


def test_data_source(spark, folder, tmp_path_factory):
    register(spark)
    read = lambda **o: spark.read.format("verified_gzip").options(**o)
    n = {}
    for threads in ("1", "4"):
        parts = read(threads=threads, taskBytes="8000").load(str(folder / "blocks.gz")).orderBy("decoded_start").collect()
        assert b"".join(bytes(p.data) for p in parts) == BODY
        n[threads] = read(mode="members", threads=threads, taskBytes="8000").load(str(folder / "blocks.gz")).orderBy("member_index").drop("decode_path").collect()
    assert n["1"] == n["4"]
    lines = read(mode="lines").load(str(folder / "members.gz"))
    assert streams.line_totals(lines, "path").first().asDict()["lines"] == 4001
    with pytest.raises(Exception, match="ignoreCorruptFiles"):
        read(ignoreCorruptFiles="true").load(str(folder)).count()
    with pytest.raises(Exception, match="output_limit"):
        read(outputLimit="100").load(str(folder / "plain.gz")).count()
    for blocked in ("true", "false"):
        out = str(tmp_path_factory.mktemp("sink") / "out")
        rows = generators.log_lines(spark, 5000)
        rows.write.format("verified_gzip").option("path", out).option("bgzf", blocked).option("level", "9").mode("append").save()
        report = json.load(open(os.path.join(out, "_REPORT.json")))
        assert sum(r["compressed_bytes"] for r in report) == sum(os.path.getsize(os.path.join(out, r["path"])) for r in report)
        back = scan.lines(scan.members(spark, out + "/part-*"))
        assert {bytes(r.value).decode() for r in back.collect()} == {r.value for r in rows.collect()}


def test_columns_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(b"abc")), (2, bytearray(b"")), (3, None)], "id long, body binary")
    out = df.select("id", "body", zipped(F.col("body")).alias("z"))
    assert out.filter("body is not null").select((F.col("body") == gunzip(F.col("z"))).alias("same")).agg(F.bool_and("same")).first()[0]
    assert {r.id: r.r.members for r in out.select("id", gzip_verify(F.col("z")).alias("r")).collect() if r.r.members} == {1: 1, 2: 1}
    assert gzip_members(out, "id", "z").count() == 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gz").write_bytes(compress(b"a"))
    (tmp_path / "in" / "b.gz").write_bytes(compress(b"b")[:-1])
    stream = verified_files(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert sorted(r.status for r in spark.table("seen").select("result.status").collect()) == ["ERROR", "OK"]


def test_scalars(spark):
    row = spark.range(1).select(
        S.parse_size(F.lit("4MiB")).alias("a"), S.output_path(F.lit("x.fq.bgz")).alias("b"), S.path_names(F.array().cast("array<string>")).alias("c"),
        S.throughput(F.lit(2097152), F.lit(2.0)).alias("d"), S.ratio_text(F.lit(0.0)).alias("e"), S.ratio_text(F.lit(1.5)).alias("f"), S.parse_bool(F.lit("Yes")).alias("g"),
        S.parse_list(F.lit(" a, b,,a")).alias("h"), S.isize(F.lit(4294967297)).alias("i"), S.canonical_mode(F.lit("WC")).alias("j"), S.parse_number(F.lit("")).alias("k"), S.decimals(F.lit(0.5), 2).alias("l"),
    ).first()
    assert tuple(row) == (4194304, "x.fq", "none", 1.0, "", "1.5000", True, ["a", "b"], 1, "cli-pipe-wc", 0.0, "0.50")
    for bad in (S.parse_size(F.lit("1 x")), S.canonical_mode(F.lit("no")), S.parse_bool(F.lit("maybe")), S.output_path(F.lit("x.txt"))):
        with pytest.raises(Exception):
            spark.range(1).select(bad).collect()


def test_summary_from_csv(spark, tmp_path):
    head = "dataset,variant,iteration,threads,wall_s,exit_code,cpu_s"
    rows = ["d,gunzip,1,0,4.0,0,", "d,gunzip,2,0,6.0,0,", "d,pigz-t2,1,2,2.0,1,", "d,own-t2,1,2,1.0,0,0.5", "e,own-t1,1,1,3.0,0"]
    (tmp_path / "b.csv").write_text("\n".join([head, *rows]) + "\n")
    out = {(r.dataset, r.variant): r for r in bench_summary.summary(bench_summary.load(spark, str(tmp_path / "b.csv"))).collect()}
    own = out["d", "own-t2"]
    assert (own.speedup_vs_gunzip, own.speedup_vs_same_thread_pigz, own.speedup_vs_best_pigz, own.speedup_vs_pigz_t1) == (5.0, 2.0, 2.0, None)
    assert (own.mean_cpu_s, out["d", "gunzip"].runs, round(out["d", "gunzip"].sd_wall_s, 6), out["d", "pigz-t2"].failed_runs) == (0.5, 2, 1.414214, 1)
    assert out["e", "own-t1"].sd_wall_s == 0.0 and out["e", "own-t1"].speedup_vs_gunzip is None


def test_generators_and_records(spark):
    lines = generators.fastq_lines(spark, 50).withColumn("path", F.lit("p"))
    assert tuple(streams.record_totals(streams.records(lines.filter("line_no < 199"))).first()) == (49, 49 * 150)
    data = b"".join(bytes(r.data) for r in generators.random_blocks(spark, 5000, 1024).orderBy("offset").collect())
    assert data == generators.random_bytes(5000)
    s, want = generators.START, []
    for _ in range(20):
        s = (s * 1664525 + 1013904223) % 2**32
        want.append(s >> 24)
    assert list(data[:20]) == want


def test_concatenated_members_of_a_large_group_go_to_several_files(spark, tmp_path):
    bodies = {i: b"row %d " % i * 40 for i in range(3000)}
    df = spark.createDataFrame([("hot" if i % 10 else "cold", i, x) for i, x in bodies.items()], "g string, i long, d binary").repartition(3)
    # Ranges this small would be merged into one.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_concatenated(df, "g", "i", "d", f"file://{tmp_path}").count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g, rest in (("hot", False), ("cold", True)):
        files = sorted((tmp_path / g).glob("*.gz"))
        assert b"".join(gzip.decompress(f.read_bytes()) for f in files) == b"".join(x for i, x in bodies.items() if (i % 10 == 0) == rest)
        assert g == "cold" or len(files) > 1
    report = scan.report(scan.members(spark, f"{tmp_path}/*/*.gz"), scan.list_files(spark, f"{tmp_path}/*/*.gz")).collect()
    assert sum(r.member_count for r in report) == len(bodies) and all(r.crc_verified for r in report)


def bad_block_size(data):
    """The BGZF stream with its second block's stated size spanning two blocks; gzip reads it."""
    first = bgzf_link(data, 0, len(data))[1]
    second = bgzf_link(data[first:], 0, len(data) - first)[1]
    third = bgzf_link(data[first + second :], 0, len(data) - first - second)[1]
    return data[: first + 16] + (second + third - 1).to_bytes(2, "little") + data[first + 18 :]


def test_verified_ends_decide_not_stated_sizes(spark, tmp_path):
    blocks = bgzf(BODY, payload=3000)
    inner = bgzf(BODY[:9000], payload=1000)
    files = {
        "spans.gz": bad_block_size(blocks),
        "inner.gz": bgzf(BODY[:5000], payload=999) + compress(inner, WriteConfig(level=0)) + bgzf(BODY[5000:], payload=999),
        "stored.gz": b"".join(bgzf_block(inner[i : i + 2000], WriteConfig(level=0)) for i in range(0, len(inner), 2000)),
        "cut.gz": blocks[: len(blocks) // 2],
        "empty_members.gz": b"".join(compress(x) for x in (b"", b"a\nb", b"", b"c\n", b"", b"d", b"")),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
        if name != "cut.gz":
            assert gzip.decompress(data)
    keep = [c.strip().split(" ")[0] for c in scan.PLACED.split(",") if "decode_path" not in c]
    rows = {}
    for config in (DecodeConfig(threads=1), DecodeConfig(task_bytes=700, grid_size=1024), DecodeConfig(task_bytes=5000, grid_size=4096)):
        found = scan.members(spark, str(tmp_path), config)
        got = sorted(map(tuple, found.select(*keep).collect()), key=lambda r: (r[0], r[2]))
        assert rows.setdefault("want", got) == got
        ok = found.filter(~F.col("path").endswith("cut.gz"))
        lines = sorted(map(tuple, scan.lines(ok, config).select("path", "line_no", "value").collect()))
        assert rows.setdefault("lines", lines) == lines
    by_file = {}
    for path, number, value in rows["lines"]:
        by_file.setdefault(os.path.basename(path), []).append((number, bytes(value)))
    for name in files.keys() - {"cut.gz"}:
        want = gzip.decompress(files[name]).split(b"\n")
        assert by_file[name] == list(enumerate(want if want[-1] else want[:-1])), name
    register(spark)
    read = spark.read.format("verified_gzip").options(mode="members", taskBytes="700")
    with pytest.raises(Exception, match="blocks do not end where they say"):
        read.load(str(tmp_path / "spans.gz")).count()


def test_running_sums_over_ranges(spark):
    rows = [(f"g{i % 3}" if i % 7 else None, i, (i * 37) % 101) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o long, n long")
    got = {(r.g, r.o): (r.member_index, r.decoded_start) for r in streams.offsets(df, "g", "o", F.col("n")).collect()}
    at = {}
    for g, o, n in rows:
        index, total = at.get(g, (0, 0))
        assert got[g, o] == (index, total)
        at[g] = (index + 1, total + n)
    kept = {r.o for r in streams.within_limit(df, "g", "o", F.col("n"), 3000).collect()}
    assert kept == {o for g, o, n in rows if got[g, o][1] + n <= 3000}


def test_rows_that_name_ranges_stay_spread(spark):
    """A few bytes each, they were one task."""
    rows = spark.createDataFrame([("p", i) for i in range(400)], "path string, start long")
    tasks = scan.spread(rows, "path", "start").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
