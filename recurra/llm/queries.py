"""One registered query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recurra.llm import hnsw
from recurra.llm.brown import scores
from recurra.llm.centroids import centroid_clusters, clusters_sql
from recurra.llm.chunks import repeated_passages
from recurra.llm.common import table
from recurra.llm.encode import tokenizer_file
from recurra.llm.frames import read_tokens, token_index, write_tokens
from recurra.llm.language import documents_as_rows, fit_text_model, identify, pages_as_rows
from recurra.llm.lines import line_classes
from recurra.llm.negatives import hard_negatives, negatives_sql
from recurra.llm.packing import pack
from recurra.llm.shards import balanced_shards
from recurra.llm.simhash import near_duplicates
from recurra.llm.tiling import leaks
from recurra.llm.transducer import token_counts
from recurra.settings import new_folder

Query = Callable[[SparkSession, str], DataFrame]


def op1_tiling(spark: SparkSession, folder: str) -> DataFrame:
    found = leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("text_hash")


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    """All documents and all pages; hosts, suffixes and declared languages count over both."""
    docs = table(spark, folder, "documents")
    model = fit_text_model(docs, "text", "lang", "doc_id")
    rows = documents_as_rows(docs).unionByName(pages_as_rows(table(spark, folder, "pages")))
    return identify(rows, model)


def op3_brown(spark: SparkSession, folder: str) -> DataFrame:
    return scores(table(spark, folder, "documents"))


def op4_shards(spark: SparkSession, folder: str) -> DataFrame:
    return balanced_shards(table(spark, folder, "documents"), shards=8)


def op5_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_passages(table(spark, folder, "documents")).drop("text_hash")


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack(table(spark, folder, "documents"), tokenizer_file(), window=4096, end_id=2)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select(*names)


def op7_lines(spark: SparkSession, folder: str) -> DataFrame:
    return line_classes(table(spark, folder, "documents"), edits=2).drop("text_hash")


def op8_token_frames(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    manifest = write_tokens(docs, new_folder(spark, "tokens"), tokenizer_file(), end_id=2)
    read = read_tokens(token_index(manifest))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), shingle=4, distance=4)


def op10_hnsw(spark: SparkSession, folder: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, folder, "embeddings"), threshold=0.93)


def op11_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives(table(spark, folder, "embeddings"))


def op12_transducer(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), limit=4096)


def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroid_clusters(table(spark, folder, "embeddings"), k=8, rounds=10, salt="3")


QUERIES: dict[str, Query] = {
    "op1_tiling": op1_tiling,
    "op2_language": op2_language,
    "op3_brown": op3_brown,
    "op4_shards": op4_shards,
    "op5_chunks": op5_chunks,
    "op6_packing": op6_packing,
    "op7_lines": op7_lines,
    "op8_token_frames": op8_token_frames,
    "op9_simhash": op9_simhash,
    "op10_hnsw": op10_hnsw,
    "op11_negatives": op11_negatives,
    "op12_transducer": op12_transducer,
    "op13_centroids": op13_centroids,
}

ORACLE: dict[str, str] = {
    "op11_negatives": negatives_sql(),
    "op13_centroids": clusters_sql(k=8, rounds=10, salt="3"),
}
