"""The corpus pipeline: quality rules, near-duplicates, personal data, source
mixing, packing. Each stage is a function of (spark, docs, sf_dir); all but the
last return the columns of documents.

quality keeps the documents that the rules and the forest keep. near_duplicates
keeps the smallest id of each group. personal_data replaces every span by its
kind in angle brackets and counts n_chars anew. mixing returns each document
once for every round of its source's stream that takes at least half of it, so
a document can come twice or not at all, in the order of the schedule, in which
packing then reads them. packing returns one row per piece.

Rows that share a doc_id are kept or dropped together; rows without one are
judged on their own and are no copies of others. Null texts have no words, so that quality drops them; an empty table stays
empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriflate.llm import minhash, mixing, packing, pii
from veriflate.llm import quality as rules
from veriflate.llm.common import small, store, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the ids in gone(_gone). Null ids stay; no join has to bring them together."""
    kept = docs.filter("doc_id is not null").join(small(gone.distinct()), F.col("doc_id") == F.col("_gone"), "left_anti")
    none = docs.filter("doc_id is null")
    return kept if none.isEmpty() else kept.union(none)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Rows without an id are told apart by their text; no label has a negative id.
    own = docs.select(*COLUMNS).withColumn("_id", F.coalesce("doc_id", -F.shiftrightunsigned(F.xxhash64("text"), 2) - 1))
    judged = rules.judge(own, table(spark, sf_dir, "labels"), id_col="_id").filter("not kept").select(F.col("doc_id").alias("_gone"))
    judged = store(judged.distinct(), "rejected")
    return own.join(small(judged), F.col("_id") == F.col("_gone"), "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = store(minhash.near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("_gone")), "copies")
    return _without(docs.select(*COLUMNS), found)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mix), ("packing", pack)]

#: The forest, the spans and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
