"""New gzip files of a folder as a stream (an addition of this engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DecodeConfig
from ..functions.gzip_columns import gunzip, gzip_verify


def verified_files(spark: SparkSession, folder: str, pattern: str = "*.gz", files_per_batch: int = 16, config: DecodeConfig | None = None) -> DataFrame:
    """path, length, result (functions.gzip_columns.VERIFIED) for each new file; files must fit in a cell."""
    raw = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return raw.select("path", "length", gzip_verify(F.col("content"), config).alias("result"))


def decoded_files(spark: SparkSession, folder: str, pattern: str = "*.gz", files_per_batch: int = 16, config: DecodeConfig | None = None) -> DataFrame:
    """path, data: the verified content of each new file; a damaged file fails the stream."""
    raw = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return raw.select("path", gunzip(F.col("content"), config).alias("data"))
