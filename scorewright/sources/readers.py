"""Typed readers of the library's inputs.

Every reader declares its schema (no inference job) and filters on partition
columns, so the scan skips folders and unread columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K

EMAIL_SCHEMA = ("message_id string, subject string, `from` string, `to` array<string>, cc array<string>, bcc array<string>, "
                "date timestamp_ntz, body string, file_name string, ordinal long")
SCENARIO_SCHEMA = ("id long, question string, answer string, message_ids array<string>, how_realistic float, "
                   "inbox_address string, query_date string, split string")
MATH_SCHEMA = "doc_id long, expected_answer string, problem string, generated_solution string, config string, split string"


def read_email_source(spark: SparkSession, path: str) -> DataFrame:
    """Typed email records; a missing column reads as null."""
    return spark.read.schema(EMAIL_SCHEMA).parquet(path)


def load_scenarios(spark: SparkSession, path: str, split: str = "train", limit: int | None = None,
                   max_messages: int | None = 1, shuffle: bool = False, seed: int | None = None) -> DataFrame:
    """Scenarios of one split (folder ``split=...``) that refer to at most
    ``max_messages`` messages (None: any number), in id order or, with
    ``shuffle``, in the order that the seed gives; the first ``limit`` of
    them."""
    from ..operators.sampling import seed_hash

    rows = spark.read.schema(SCENARIO_SCHEMA).parquet(path).filter(F.col("split") == split)
    if max_messages is not None:
        rows = rows.filter(F.size("message_ids") <= max_messages)
    order = [seed_hash(F.col("id"), K.DEFAULT_SEED if seed is None else seed), F.col("id")] if shuffle else [F.col("id")]
    return rows.orderBy(*order).limit(limit) if limit is not None else rows.orderBy(*order)


def read_math_set(spark: SparkSession, path: str, config: str, split: str, columns: list[str]) -> DataFrame:
    """Columns of one config and split of a set stored in folders
    ``config=.../split=...``."""
    rows = spark.read.schema(MATH_SCHEMA).parquet(path)
    return rows.filter((F.col("config") == config) & (F.col("split") == split)).select(*columns)
