"""The registered queries of this subpackage: one per operator, over whole tables.

Each reads its table, runs its operator with production parameters, and derives the digest
columns of its contract from the operator's real output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import queries_pages, queries_turns
from .castore import read_store, write_store
from .chunkbpe import decode_ids, encode_documents
from .packing import pack_documents
from .simhash import simhash_groups
from .storage import scratch
from .tokencount import count_tokens

PACK_END, STORE_END = 2, 1


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary ``name`` lies on this machine; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), PACK_END)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op8_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "idstore")
    write_store(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"), STORE_END)
    return read_store(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    decoded = decode_ids(encode_documents(table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text_utf8", 256).alias("decoded_sha256"),
    )


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES = {
    "op4_packing": op4_packing,
    "op5_simhash": op5_simhash,
    "op8_chunk_store": op8_chunk_store,
    "op10_chunk_bpe": op10_chunk_bpe,
    "op11_token_counts": op11_token_counts,
} | queries_pages.QUERIES | queries_turns.QUERIES

ORACLES: dict[str, str] = queries_pages.ORACLES | queries_turns.ORACLES
