"""Registered queries of the training-data operators: thin, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path
from ..sources.tables import table_path
from . import codes, mil, mixing, packed_files, repair, rules, winnow
from .jaccard import jaccard_components
from .packing import CAPACITY, id_width, pack_documents
from .repeats import remove_repeats
from .secrets import scan_secrets
from .sharding import shard_documents
from .token_count import count_tokens
from .transducer import encode_documents

BYTE_FILE, WORD_FILE = "byte_bpe_50k.json", "word_bpe_49k.json"


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, "documents"))


def op1_token_counts(spark, sf_dir):
    return count_tokens(documents(spark, sf_dir), tokenizer_file(BYTE_FILE))


def op2_pack_sequences(spark, sf_dir):
    path = tokenizer_file(BYTE_FILE)
    packed = pack_documents(documents(spark, sf_dir), path)
    return packed_files.read_packed(spark, packed_files.write_packed(packed, scratch_path(spark, "op2-packed"), CAPACITY, id_width(path)))


def op3_quality_rules(spark, sf_dir):
    return rules.quality_rules(documents(spark, sf_dir))


def op4_jaccard_join(spark, sf_dir):
    return jaccard_components(documents(spark, sf_dir))


def op5_quality_mil(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return mil.classify(docs, mil.train(docs, spark.read.parquet(table_path(sf_dir, "labels"))))


def op6_secret_scan(spark, sf_dir):
    return scan_secrets(documents(spark, sf_dir))


def op7_repeated_strings(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir))


def op8_bpe_codec(spark, sf_dir):
    return encode_documents(documents(spark, sf_dir), tokenizer_file(WORD_FILE))


def op9_lpt_shards(spark, sf_dir):
    return shard_documents(documents(spark, sf_dir))


def op10_winnowing(spark, sf_dir):
    return winnow.decontaminate(documents(spark, sf_dir), spark.read.parquet(table_path(sf_dir, "benchmark")))


def op11_sainte_lague_mix(spark, sf_dir):
    return mixing.mix_documents(documents(spark, sf_dir))


def op12_conversation_repair(spark, sf_dir):
    rows = spark.read.parquet(table_path(sf_dir, "conversations"))
    return repair.audit(repair.damaged(rows), present="present")


def op13_vector_codes(spark, sf_dir):
    return codes.compress(spark.read.parquet(table_path(sf_dir, "embeddings")))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_pack_sequences, op3_quality_rules, op4_jaccard_join, op5_quality_mil, op6_secret_scan, op7_repeated_strings, op8_bpe_codec, op9_lpt_shards, op10_winnowing,
    op11_sainte_lague_mix, op12_conversation_repair, op13_vector_codes)}
SQL = {"op3_quality_rules": rules.SQL, "op10_winnowing": winnow.SQL, "op11_sainte_lague_mix": mixing.SQL, "op13_vector_codes": codes.SQL}
