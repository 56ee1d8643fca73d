"""Training-corpus pipeline: quality rules, SimHash near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet and the next stage reads it.
All stages but the last return the columns of `documents`; a stage that changes texts sets n_chars anew where the table
has it. SQL can't express fingerprints and bins, so ORACLE_SQL is None and tests compare `run` with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convhist.llm import near_text, op4_suffix, op5_packing, op9_lines
from convhist.llm.encoders import vocabulary
from convhist.session import scratch_path

#: Strings of this many bytes that repeat lose their later copies. 51 words of four letters and a space have 254 bytes and
#: 51 of one letter have 101, so passages of REPEAT_WORDS words that are shorter lose theirs too.
REPEAT_BYTES = 256
REPEAT_WORDS = 51


def _with_length(docs: DataFrame, like: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*[F.col(f"`{c}`") for c in like.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failed lines."""
    return _with_length(op9_lines.clean(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies."""
    return near_text.drop_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of strings of REPEAT_BYTES bytes or REPEAT_WORDS words; documents without any text left go."""
    return _with_length(op4_suffix.without_repeats(docs, REPEAT_BYTES, min_words=REPEAT_WORDS), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    pieces = op5_packing.pack(docs, vocabulary("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
