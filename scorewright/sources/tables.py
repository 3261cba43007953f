"""Readers for the parquet tables the library runs on.

Every reader selects only the columns a job needs, so the parquet scan's
``ReadSchema`` is pruned and filters written downstream reach the scan as
``PushedFilters``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None,
               key: str | None = None) -> DataFrame:
    """Pruned scan of one table, in the splits that the reader gives.

    ``key``: rows that get heavy work may be dealt by this column first, but
    only where the session asks for it (``spark.scorewright.scan.partitions``, set by
    ``build_session`` for a local master whose small files hold one split)."""
    df = spark.read.parquet(table_path(sf_dir, name))
    df = df.select(*columns) if columns else df
    n = spark.conf.get("spark.scorewright.scan.partitions", None)
    return df.repartition(int(n), key) if key and n else df
