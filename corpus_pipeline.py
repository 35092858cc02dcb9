"""The corpus pipeline: five training-data operators over ``documents``, one after the other.

Each stage takes (spark, docs, sf_dir), works on everything that its predecessor kept and returns a DataFrame; all but
the last return the columns of documents. The last adds ``piece_ids`` (the SentencePiece ids of the whole text) and
``decodes`` (decoding them gives the text back); columns of those names are replaced.

Null texts are empty texts; null identifiers sort last where one of several rows stays; repeated rows are copies; empty
tables give empty tables; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import Workspace, read_table
from gridloom.llm.exact_dedup import drop_copies
from gridloom.llm.minhash import drop_similar
from gridloom.llm.mixing import mix
from gridloom.llm.quality import keep_good
from gridloom.llm.sentencepiece_codec import decoded, encode_column


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, read_table(spark, sf_dir, "labels"), Workspace(spark, "quality"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs, Workspace(spark, "exact"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_similar(docs, Workspace(spark, "near"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, Workspace(spark, "mixing"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    Workspace(spark, "pieces")  # sends the package to the executors
    # The workers still hold memory of earlier stages: fewer words are remembered.
    encoded = encode_column(docs, cached=120_000)
    return encoded.withColumn("decodes", F.coalesce("text", F.lit("")) == decoded("piece_ids"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixing), ("pieces", pieces)]

#: SQL can't express a trained classifier or the codec; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    work = Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        kept = work.keep(stage(spark, docs, sf_dir), name)
        work.forget(before)  # nothing reads it any more
        docs = before = kept
    return STAGES[-1][1](spark, docs, sf_dir)
