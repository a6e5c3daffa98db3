"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns
of documents. ``run`` writes each stage as Parquet to the folder that ``spark.checkpoint.dir`` names and reads it again.
SQL expresses none of the middle stages, so ``ORACLE_SQL`` is None; tests compare every stage with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurra.llm.common import fixed, table
from recurra.llm.encode import tokenizer_file
from recurra.llm.language import fit_text_model, identify, without_rejected
from recurra.llm.lines import line_classes, without_lines
from recurra.llm.packing import pack
from recurra.llm.simhash import without_near_duplicates
from recurra.llm.tiling import leaks, without_leaks

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no known language; their ``lang`` is the declaration and their ``source`` the host.

    Nulls in either are no evidence. Rows are decided one by one, by id and text, so repeated rows and one id with several
    texts are kept or dropped for their own text; null and empty texts and ties are decided as ``identify`` says. An empty
    table stays empty.
    """
    model = fit_text_model(docs, "text", "lang", "doc_id")
    evidence = [F.col("lang").alias("declared"), F.col("source").alias("host")]
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", *evidence)
    return without_rejected(docs, identify(rows, model))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop all but the first of near-equal lines, in the order of ids and lines. Documents stay, even without a line.

    Null texts stay null, empty ones empty; equal rows keep and lose the same lines; null ids come where ``line_classes`` puts
    them. An empty table stays empty.
    """
    return without_lines(docs, line_classes(docs, edits=2))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates: the smallest id, then the smallest text hash; null ids come last.

    Rows are known by id and text. Null, empty and blank texts are one group. An empty table stays empty.
    """
    return without_near_duplicates(docs, shingle=4, distance=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item.

    Rows are decided by id and text, so other texts under the same id, or under none, stay; equal rows go together. Null and
    empty texts hold nothing. Without documents, or without items, all rows stay.
    """
    return without_leaks(docs, leaks(docs, table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens that mix sources in their proportions.

    Null and empty texts are a piece with the end token alone, a null source is a source; repeated rows are packed as often as
    they are there. An empty table gives no piece.
    """
    pieces = pack(docs, tokenizer_file(), window=4096, end_id=2)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select(*names)


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = fixed(stage(spark, docs, sf_dir))
    return docs
