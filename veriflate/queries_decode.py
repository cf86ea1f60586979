"""Registered queries of decoding: readers, access paths, damaged and odd files, the DEFLATE layer."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DecodeConfig, WriteConfig
from .errors import GzipError
from .files import Reader, compress_stream, decode_to, decompress_file
from .functions.gzip_columns import gzip_verify, write_concatenated
from .operators import streams
from .plans import fixtures, generators
from .queries import _BYTES, _documents, _table, query
from .sources import deflate, marker, scan
from .sources.bytes_at import MemorySource, PathSource
from .sources.datasource import register
from .sources.deflate_writer import GzipWriter, compress
from .sources.deflate_writer import bgzf as blocks
from .sources.inflate import decode, decode_all
from .sources.scratch import folder, stored

SMALL = DecodeConfig(grid_size=4096, task_bytes=8192)
_TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _packed_one(_: int, body: bytes) -> bytes:
    return compress(body)


def _each(df: DataFrame, schema: str, make: Callable[[int, bytes], tuple], shape: Callable[[int, bytes], bytes] = _packed_one) -> DataFrame:
    """Rows of make(id, stream) for a frame of ids and bodies, where stream is shape(id, body). One worker a task makes
    and reads the streams, one at a time."""
    fields = [c.split() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [make(i, shape(i, b.as_py())) for i, b in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    return df.mapInArrow(run, schema)


#: Bytes of streams that are sent on together.
_SENT = 1 << 20


def _streams(df: DataFrame, make: Callable[[bytes], bytes]) -> DataFrame:
    """source, doc_id, stream for a frame of source, doc_id, body; made one at a time and sent on in small batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, made = 0, 0, []
            for n, body in enumerate(batch.column(2), 1):
                made.append(make(body.as_py()))
                size += len(made[-1])
                if size >= _SENT or n == batch.num_rows:
                    part = batch.slice(first, n - first)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.binary())], names=["source", "doc_id", "stream"])
                    first, size, made = n, 0, []

    schema = df.select("source", "doc_id").schema.add("stream", "binary")
    return df.select("source", "doc_id", "body").mapInArrow(run, schema)


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", "body")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", "packed")


@query(f"SELECT doc_id, {_BYTES} AS decoded, CAST(1 AS BIGINT) AS members, true AS verified FROM documents")
def s02_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call opens, finish() verifies what was not read: no byte is handed out."""

    def make(i: int, data: bytes) -> tuple:
        r = Reader(data).finish()
        return i, r.decompressed_bytes, r.member_count, r.crc_verified

    return _each(_bodies(spark, sf_dir), "doc_id long, decoded long, members long, verified boolean", make)


@query(f"SELECT doc_id, {_BYTES} AS decoded, CAST(ceil({_BYTES} / 100.0) AS BIGINT) AS steps FROM documents")
def p02_peek_consume(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(i: int, data: bytes) -> tuple:
        reader, steps = Reader(data), 0
        while len(held := reader.peek()):
            reader.consume(min(100, len(held)))
            steps += 1
        return i, reader.stats().decompressed_bytes, steps

    return _each(_bodies(spark, sf_dir), "doc_id long, decoded long, steps long", make)


@query("SELECT doc_id, left(hex(encode(coalesce(text, ''))), 200) AS head FROM documents")
def l04_read_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading stops after 100 bytes."""
    return _each(_bodies(spark, sf_dir), "doc_id long, head string", lambda i, data: (i, Reader(data).read(100).hex().upper()))


class _Forward(io.RawIOBase):
    """A stream that cannot be positioned."""

    def __init__(self, data: bytes) -> None:
        self._data = io.BytesIO(data)

    def read(self, n: int = -1) -> bytes:
        return self._data.read(min(n, 999) if n >= 0 else n)


@query("SELECT doc_id, md5(coalesce(text, '')) AS md5, true AS open FROM documents")
def s04_forward_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a stream that is read forward only and stays open."""

    def make(i: int, data: bytes) -> tuple:
        stream = _Forward(data)
        reader = Reader(stream)
        body = reader.read()
        reader.finish()
        reader.close()
        return i, hashlib.md5(body).hexdigest(), not stream.closed

    return _each(_bodies(spark, sf_dir), "doc_id long, md5 string, open boolean", make)


@query(f"SELECT doc_id, md5(coalesce(text, '')) AS md5, {_BYTES} AS decoded FROM documents")
def k11_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(i: int, data: bytes) -> tuple:
        out = io.BytesIO()
        report = decode_to(data, out)
        return i, hashlib.md5(out.getvalue()).hexdigest(), report.decompressed_bytes

    return _each(_bodies(spark, sf_dir), "doc_id long, md5 string, decoded long", make)


@query("SELECT doc_id, 'cancelled' AS error_kind FROM documents")
def t04_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(i: int, data: bytes) -> tuple:
        reader = Reader(data)
        reader.cancel()
        try:
            reader.read(1)
        except GzipError as e:
            return i, e.kind
        return i, None

    return _each(_bodies(spark, sf_dir), "doc_id long, error_kind string", make)


@query("SELECT true AS same, true AS refused, CAST(3 AS BIGINT) AS files")
def k13_file_to_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local files of the driver: compress, decompress, and no output over the input."""
    text = "\n".join(r.value for r in generators.log_lines(spark, 2000).orderBy("line_no").collect()).encode()
    with tempfile.TemporaryDirectory() as at:
        plain, packed, back = (os.path.join(at, n) for n in ("a.log", "a.log.gz", "b.log"))
        with open(packed, "wb") as out:
            compress_stream(io.BytesIO(text), out)
        decompress_file(packed, back)
        with open(plain, "wb") as out:
            out.write(text)
        with open(back, "rb") as f:
            same = f.read() == text
        try:
            decompress_file(packed, packed)
            refused = False
        except GzipError:
            refused = True
        files = len(os.listdir(at))
    return spark.createDataFrame([(same, refused, files)], "same boolean, refused boolean, files long")


@query(f"""SELECT doc_id, {_BYTES} AS size, true AS whole, true AS prefix, true AS idempotent FROM documents""")
def k05_writer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """write, write_line, flush, finish and close: what was flushed can be read, the report is that of the trailer."""

    def make(i: int, data: bytes) -> tuple:
        body, out = zlib.decompress(data, 31), []
        half = len(body) // 2
        writer = GzipWriter(out.append)
        writer.write(body[:half])
        writer.flush()
        prefix = zlib.decompressobj(31).decompress(b"".join(out)) == body[:half]
        writer.write(body[half:])
        report = writer.finish()
        again = writer.finish() == report
        writer.close()
        stream = b"".join(out)
        whole = zlib.decompress(stream, 31) == body and (report.compressed_bytes, report.crc32, report.isize) == (len(stream), zlib.crc32(body), len(body) & 0xFFFFFFFF)
        return i, report.uncompressed_bytes, whole, prefix, again

    return _each(_bodies(spark, sf_dir), "doc_id long, size long, whole boolean, prefix boolean, idempotent boolean", make)


@query(f"SELECT doc_id, CASE WHEN {_BYTES} > 2000 THEN 'output_limit' END AS error_kind FROM documents")
def l05_limit_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _packed(spark, sf_dir).select("doc_id", gzip_verify(F.col("packed"), DecodeConfig(output_limit=2000)).alias("r"))
    return docs.select("doc_id", F.col("r.error_kind").alias("error_kind"))


def _files(spark: SparkSession, docs: DataFrame, column: str) -> str:
    """Files of each source with the streams in column, one after the other; the pattern that names them."""
    path = folder(spark)
    write_concatenated(docs, "source", "doc_id", column, path, ready=True).count()
    return path + "/*/*.gz"


def _sources(found: DataFrame, files: DataFrame) -> DataFrame:
    """source, member_count, decompressed_bytes, crc_verified, paths of files that are named by their source."""
    sums = scan.report(found, files).withColumn("source", F.regexp_extract("path", r"([^/]+)/[^/]+\.gz$", 1))
    paths = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("paths_used")))), "+")
    return sums.groupBy("source").agg(F.sum("member_count").alias("member_count"), F.sum("decompressed_bytes").alias("decompressed_bytes"), F.bool_and("crc_verified").alias("crc_verified"), paths.alias("paths"))


_BLOCKS = 1024


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _streams(_documents(spark, sf_dir), lambda body: blocks(body, payload=_BLOCKS) + compress(body))
    path = _files(spark, docs, "stream")
    return scan.members(spark, path, SMALL), scan.list_files(spark, path)


_MIXED = f"""SELECT source, CAST(sum(ceil({_BYTES} / {float(_BLOCKS)}) + 2) AS BIGINT) AS member_count, CAST(2 * sum({_BYTES}) AS BIGINT) AS decompressed_bytes, true AS crc_verified"""


@query(_MIXED + " FROM documents GROUP BY source")
def u02_mixed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked and plain members in turn in one file."""
    return _sources(*_mixed(spark, sf_dir)).drop("paths")


@query("SELECT DISTINCT source, 'bgzf+sequential' AS paths FROM documents")
def d07_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behind the first member without a block size, files are read in sequence."""
    return _sources(*_mixed(spark, sf_dir)).select("source", "paths")


@query(f"""SELECT source, CAST(sum(ceil({_BYTES} / {float(_BLOCKS)}) + 1) AS BIGINT) AS member_count, CAST(sum({_BYTES}) AS BIGINT) AS decompressed_bytes, true AS crc_verified FROM documents GROUP BY source""")
def c05_bgzf_bsize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that state the size of two: verified ends decide."""
    docs = _streams(_documents(spark, sf_dir), lambda body: fixtures.misstated(blocks(body, payload=_BLOCKS)))
    path = _files(spark, docs, "stream")
    return _sources(scan.members(spark, path, SMALL), scan.list_files(spark, path)).drop("paths")


@query(f"""SELECT source, CAST(2 * count(*) AS BIGINT) AS member_count, CAST(sum({_BYTES}) AS BIGINT) AS decoded, true AS crc_verified FROM documents GROUP BY source""")
def d05_false_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole members inside an extra field and inside stored payload are found as candidates and never committed."""

    def trap(body: bytes) -> bytes:
        inner = compress(body)
        return fixtures.of(inner, fixtures.stored_blocks(inner, 700)) + fixtures.of(body, fixtures.deflated(body), inner[:40_000] if len(inner) > 40_000 else inner)

    path = _files(spark, _streams(_documents(spark, sf_dir), trap), "stream")
    found = scan.members(spark, path, SMALL)
    sums = _sources(found, scan.list_files(spark, path))
    # The second member of each pair is the document.
    own = found.filter("status = 'OK' and member_index % 2 = 1").groupBy(F.regexp_extract("path", r"([^/]+)/[^/]+\.gz$", 1).alias("_s")).agg(F.sum("decoded_length").alias("decoded"))
    return sums.join(own, F.col("source") == F.col("_s")).select("source", "member_count", "decoded", "crc_verified")


@query("SELECT source, true AS equal FROM documents GROUP BY source")
def a02_stream_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum of each file's whole stream, from its members' and from its bytes."""
    path = _files(spark, _documents(spark, sf_dir).select("source", "doc_id", "packed"), "packed")
    sums = scan.stream_crc(scan.members(spark, path, SMALL))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                source, crc = PathSource(name), 0
                try:
                    for part in decode(source, SMALL):
                        if isinstance(part, bytes):
                            crc = zlib.crc32(part, crc)
                finally:
                    source.close()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([crc], pa.int64())], names=["_p", "_crc"])

    plain = scan.spread(scan.list_files(spark, path), "path").mapInArrow(whole, "_p string, _crc long")
    both = sums.join(plain, F.col("path") == F.col("_p"))
    return both.withColumn("source", F.regexp_extract("path", r"([^/]+)/[^/]+\.gz$", 1)).groupBy("source").agg(F.bool_and(F.col("crc32") == F.col("_crc")).alias("equal"))


@query(f"SELECT count(*) AS members, CAST(sum({_BYTES}) AS BIGINT) AS decoded_bytes, CAST(0 AS BIGINT) AS errors FROM documents")
def t05_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _files(spark, _documents(spark, sf_dir).select("source", "doc_id", "packed"), "packed")
    found, seen = scan.observed(scan.members(spark, path, SMALL))
    found.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([tuple(int(seen.get[k]) for k in ("members", "decoded_bytes", "errors"))], "members long, decoded_bytes long, errors long")


@query(f"SELECT doc_id, CAST(x AS BIGINT) AS part, {_BYTES} AS size FROM documents, unnest([0, 1, 2]) AS t(x)")
def w01_restore_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that come late, out of order and twice, once each and in order."""
    parts = _packed(spark, sf_dir).select("doc_id", gzip_verify(F.col("packed")).alias("r")).select("doc_id", F.col("r.decoded_bytes").alias("size"))
    parts = parts.select("doc_id", "size", F.explode(F.array(*(F.lit(x).cast("long") for x in (2, 0, 1, 0, 2)))).alias("part"))
    return streams.ordered(parts.repartition(5, F.xxhash64("doc_id", "part")), "doc_id", "part").select("doc_id", "part", "size")


def _shaped_one(i: int, body: bytes) -> bytes:
    """The document as a member of one of the shapes in turn."""
    return fixtures.shaped(body, fixtures.SHAPES[i % len(fixtures.SHAPES)])


@query("SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents")
def k20_fixture_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_bodies(spark, sf_dir), "doc_id long, md5 string", lambda i, data: (i, hashlib.md5(decode_all(data)[0]).hexdigest()), _shaped_one)


@query("SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents")
def d13_own_inflate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All block types through the engine's own bit reader, codes and copies."""

    def make(i: int, data: bytes) -> tuple:
        chunk = deflate.decode_blocks(MemorySource(data), 80, 1 << 62, 1 << 30, True)
        return i, hashlib.md5(deflate.resolve(chunk.symbols, b"")).hexdigest()

    return _each(_bodies(spark, sf_dir), "doc_id long, md5 string", make, _shaped_one)


@query("SELECT doc_id, 'invalid_deflate' AS error_kind FROM documents")
def d12_bad_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes with too many or too few entries, reserved blocks and wrong stored lengths."""
    cases = ("over", "incomplete", "empty", "reserved", "stored")

    def make(i: int, data: bytes) -> tuple:
        out = fixtures.BitWriter()
        case = cases[i % len(cases)]
        try:
            if case == "over":
                deflate.build_code([1, 1, 1])
            elif case == "incomplete":
                deflate.build_code([2, 2, 2])
            elif case == "empty":
                deflate.build_code([0] * 30)
            else:
                out.put(7 if case == "reserved" else 1, 3)
                out.align()
                out.put(i & 0xFF, 32)
                deflate.decode_blocks(MemorySource(out.bytes()), 0, 8, 100)
        except GzipError as e:
            return i, e.kind
        return i, None

    return _each(_bodies(spark, sf_dir), "doc_id long, error_kind string", make)


@query("SELECT doc_id, true AS equal FROM documents")
def d18_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies that overlap what they make, against one symbol at a time."""
    from array import array

    def make(i: int, data: bytes) -> tuple:
        equal, data = True, data * 3
        for distance, length in ((1, 258), (2, 3), (i % 40 + 1, i % 256 + 3), (len(data), 17)):
            fast, slow = array("H", list(data)), array("H", list(data))
            deflate.copy_match(fast, distance, length)
            for _ in range(length):
                slow.append(slow[-distance])
            equal &= fast == slow
        return i, equal

    return _each(_bodies(spark, sf_dir), "doc_id long, equal boolean", make)


@query("SELECT doc_id, true AS window_known, true AS equal FROM documents")
def d23_inflate_at_any_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the second of three blocks on, at whatever bit it begins: with markers and resolved, and by zlib with the window."""

    def make(i: int, data: bytes) -> tuple:
        body = zlib.decompress(data, 31)
        text, cut = body * 3 + b"%d" % i, 2 * len(body)
        engine = zlib.compressobj(6, zlib.DEFLATED, -15)
        raw = engine.compress(text[:cut]) + engine.flush(zlib.Z_BLOCK) + engine.compress(text[cut:]) + engine.flush()
        source = MemorySource(raw)
        borders: list[tuple[int, int]] = []
        whole = deflate.decode_blocks(source, 0, 1 << 62, 1 << 30, True, borders)
        bit, at = borders[len(borders) // 2]
        window = text[:at][-deflate.WINDOW :]
        chunk = deflate.decode_blocks(source, bit, 1 << 62, 1 << 30)
        exact = b"".join(x for x in deflate.inflate_from(source, bit, window) if not isinstance(x, int))
        equal = deflate.resolve(chunk.symbols, window) == exact == text[at:] and deflate.resolve(whole.symbols, b"") == text
        return i, deflate.window_after(window, chunk.symbols) == deflate.advance(window, exact), equal

    return _each(_bodies(spark, sf_dir), "doc_id long, window_known boolean, equal boolean", make)


@query(f"SELECT CAST(sum(octet_length(encode(replace(coalesce(text, ''), chr(10), ' '))) + 1) AS BIGINT) AS decompressed_bytes, CAST(count(*) AS BIGINT) AS lines, true AS verified, true AS parallel FROM documents")
def d17_marker_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one member each, decoded from their middle with markers; chunks hang on a chain of bits."""
    path = folder(spark)
    register(spark)
    rows = _table(spark, sf_dir, "documents").select(F.translate(F.coalesce("text", F.lit("")), "\n", " ").alias("value"))
    rows.coalesce(2).write.format("verified_gzip").option("path", path).mode("append").save()
    config = DecodeConfig(grid_size=64 * 1024)
    found = marker.jobs(spark, path + "/*.gz", config)
    verified = stored(marker.members(spark, path + "/*.gz", config, found))
    parts = marker.chunks(found, verified)
    ends = F.pandas_udf(lambda s: s.map(lambda x: bytes(x).count(b"\n")), "long")
    counted = parts.select(F.octet_length("data").alias("n"), ends("data").alias("lines"))
    sums = counted.agg(F.sum("n").alias("decompressed_bytes"), F.sum("lines").alias("lines"))
    good = verified.agg(F.bool_and(F.col("status") == "OK").alias("verified"), F.bool_and(F.col("decode_path") == marker.HOW).alias("parallel"))
    jobs = found.groupBy("path").count().agg((F.max("count") > 1).alias("several"))
    # Three tables of one row each.
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(sums).join(one(good), "_one").join(one(jobs), "_one").select("decompressed_bytes", "lines", "verified", (F.col("parallel") & F.col("several")).alias("parallel"))


@query(f"SELECT doc_id, {_BYTES} AS decoded_bytes, true AS equal FROM documents")
def k03_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each level and strategy gives a stream of the same bytes."""
    configs = [WriteConfig(level=n, strategy=s) for n, s in ((0, 0), (1, 0), (9, 0), (6, 2))]

    def make(i: int, body: bytes) -> tuple:
        return i, len(body), all(decode_all(compress(body, c))[0] == body for c in configs)

    return _each(_bodies(spark, sf_dir), "doc_id long, decoded_bytes long, equal boolean", make, lambda _, body: body)
