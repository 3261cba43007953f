"""Operator 9: shards of near-equal bytes by longest-processing-time first.

Equal texts form a group that stays together.  The groups, largest first, each
go to the least-loaded shard.  Groups of one size are alike to that rule, so
the heap runs over the histogram of group sizes, streamed largest first, and
deals all groups of a size in one step with the result that one-by-one dealing
has.  The groups themselves are numbered and placed by Spark.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .ordinal import with_position

#: Rows of the plan that the driver holds before it writes them.
PLAN_ROWS = 200_000


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of ``size`` each shard gets when each goes
    to the least-loaded shard (ties: the lower shard); ``loads`` is updated."""
    got = [0] * len(loads)
    if count <= 4 * len(loads):
        heap = [(x, k) for k, x in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count):
            x, k = heap[0]
            heapq.heapreplace(heap, (x + size, k))
            got[k] += 1
    else:  # the picks are the ``count`` least of the loads + j * size: find their level
        def below(level):
            return [max(0, -(-(level - x) // size)) for x in loads]

        lo, hi = min(loads), max(loads) + size * (count + 1)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if sum(below(mid)) <= count else (lo, mid - 1)
        got = below(lo)
        rest = count - sum(got)
        for k, x in enumerate(loads):
            if rest and x + got[k] * size == lo:
                got[k] += 1
                rest -= 1
    for k, n in enumerate(got):
        loads[k] += n * size
    return got


def shard_documents(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ("bytes"), shard,
    slot, grown_shard (null).

    A null text counts as an empty one and shares its group; repeated rows each
    get a slot; an empty table gives no rows; other columns are not read.  Only
    sizes, checksums and 32-byte group keys are shuffled, never texts.  The
    driver streams the histogram of group sizes (one row per distinct size) and
    writes the plan in pieces, so it holds a bounded part of it."""
    spark = docs.sparkSession
    t = F.coalesce(docs[text], F.lit(""))
    path, plan_path = scratch_path(spark, "op9-sizes"), scratch_path(spark, "op9-plan")
    docs.select(docs[doc_id].cast("long").alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"),
                F.crc32(t.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(t, 256)).alias("key")).write.parquet(path)
    rows = spark.read.parquet(path)
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    placed = with_position(groups, [F.col("bytes").desc(), F.col("key")], "place", "op9-groups")
    sizes = placed.groupBy("bytes").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))

    loads, plan = [0] * shards, []
    schema = "bytes long, first long, ends array<long>"

    def flush():
        spark.createDataFrame(plan, schema).coalesce(1).write.mode("append").parquet(plan_path)
        plan.clear()

    for r in sizes.orderBy(F.col("bytes").desc()).toLocalIterator():
        ends, total = [], 0
        for n in deal(loads, r["bytes"], r["n"]):
            ends.append(total := total + n)
        plan.append((r["bytes"], r["first"], ends))
        if len(plan) >= PLAN_ROWS:
            flush()
    flush()
    plan = spark.read.schema(schema).parquet(plan_path)
    shard = F.size(F.filter("ends", lambda e: e <= F.col("place") - F.col("first")))
    homes = placed.join(plan, "bytes").select("key", shard.cast("int").alias("shard"))
    put = with_position(rows.join(homes, "key").drop("key"), ["shard", "doc_id", "text_crc32", "size"], "at", "op9-slots")
    starts = put.groupBy("shard").agg(F.min("at").alias("from"))  # one row per shard
    return put.join(F.broadcast(starts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("from")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
