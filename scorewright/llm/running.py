"""Running sums over a whole table in a given order, without a single-task sort."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path


def _local(sums: list[str]):
    """Adds the running position and sums of a task's rows, before each row."""
    def run(batches):
        place, total = 0, dict.fromkeys(sums, 0)
        for batch in batches:
            columns = list(batch.columns)
            columns.append(pa.array(np.arange(place, place + batch.num_rows), pa.int64()))
            place += batch.num_rows
            for c in sums:
                value = pc.fill_null(batch.column(c).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
                upto = np.cumsum(value) + total[c]
                columns.append(pa.array(upto - value, pa.int64()))
                total[c] = int(upto[-1]) if len(upto) else total[c]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_at", *[f"_{c}" for c in sums]])
    return run


def with_running(df: DataFrame, order: list, sums: list[str], name: str) -> DataFrame:
    """Adds ``at``, the 0-based position of each row in ``order``, and for each
    column c of ``sums`` the sum ``c_before`` over the rows before it.

    The rows are dealt by range, sorted in the tasks, summed there as they
    stream by and written once in the shared folder; the sums of the partitions
    before come from a table with one row per partition."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    put = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*put.schema.fields, *[T.StructField(c, T.LongType()) for c in ("_at", *[f"_{c}" for c in sums])]])
    put.mapInArrow(_local(sums), schema).write.parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_n_{c}") for c in sums])
    upto = Window.orderBy("_part")
    before = parts.select("_part", (F.sum("_n").over(upto) - F.col("_n")).alias("_b"),
                          *[(F.sum(f"_n_{c}").over(upto) - F.col(f"_n_{c}")).alias(f"_b_{c}") for c in sums])
    out = rows.join(F.broadcast(before), "_part")
    return out.select(*df.columns, (F.col("_at") + F.col("_b")).alias("at"), *[(F.col(f"_{c}") + F.col(f"_b_{c}")).alias(f"{c}_before") for c in sums])
