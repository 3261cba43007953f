"""Global positions without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def with_position(df: DataFrame, order: list, out: str, name: str) -> DataFrame:
    """Adds the 0-based position of each row in ``order``.

    The rows are dealt by range, sorted inside the partitions and written once
    in the shared folder, so both passes see the same partitions.  A row's
    position is its place in its partition plus the rows of the partitions
    before it; that table has one row per partition."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_part", F.expr("shiftright(_at, 33)"))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(before), "_part").withColumn(out, place).drop("_part", "_at", "_before")
