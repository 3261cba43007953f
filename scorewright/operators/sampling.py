"""Ordinals, splits, seeded orders, batches and epochs.

Global positions never use an unpartitioned window over all rows (that runs
in one task): see ``with_positions`` and ``with_prefix_sum``.  Their offset
table has one row per partition, so its window and broadcast are bounded.

Seeded orders use ``md5(key || seed)``: deterministic under retries and the
same order in any engine (unlike ``rand()``/``randomSplit`` on unordered
input).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..session import cut_lineage


def with_positions(df: DataFrame, order: list, out: str, num_partitions: int | None = None) -> DataFrame:
    """Adds ``out``: the 0-based global position of each row in ``order``.

    Range partitions, sorted, are materialised once (reliable checkpoint in the
    shared folder), because range bounds come from sampling and both passes
    must see the same partitions.  A row's place in its partition is the low
    part of ``monotonically_increasing_id``; the rows before its partition come
    from a table with one row per partition."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    put = cut_lineage(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.expr("shiftright(_id, 33)")
    sizes = put.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return put.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(out, place).drop("_part", "_id", "_before")


def _local_prefix(value: str):
    """Adds ``_loc``, the sum of ``value`` over the task's rows before this one;
    the other columns pass through as they are."""
    def run(batches):
        total = 0
        for batch in batches:
            v = pc.fill_null(batch.column(batch.schema.get_field_index(value)), 0).to_numpy(zero_copy_only=False)
            upto = np.cumsum(v) + total
            total = int(upto[-1]) if len(upto) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - v, pa.int64())], names=[*batch.schema.names, "_loc"])
    return run


def with_prefix_sum(df: DataFrame, order_cols: list[str], value: Column | str, out: str,
                    num_partitions: int | None = None) -> DataFrame:
    """Adds ``out`` = sum of ``value`` over all rows strictly before this row
    in ``order_cols`` order (order_cols must be unique per row).  Same plan as
    ``with_positions``; the sorted rows are summed as they stream into the
    checkpoint, so they go through Arrow once and are not computed again."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    val = F.col(value) if isinstance(value, str) else value
    put = (df.withColumn("_v", val.cast("long")).repartitionByRange(n, *order_cols)
           .sortWithinPartitions(*order_cols).withColumn("_pid", F.spark_partition_id()))
    schema = T.StructType([*put.schema.fields, T.StructField("_loc", T.LongType())])
    local = cut_lineage(put.mapInArrow(_local_prefix("_v"), schema))
    totals = local.groupBy("_pid").agg(F.sum("_v").alias("_tot"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", F.coalesce(F.sum("_tot").over(before), F.lit(0)).alias("_off"))
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn(out, (F.col("_off") + F.col("_loc")).cast("long"))
            .drop("_pid", "_v", "_loc", "_off"))


def with_ordinal(df: DataFrame, order_cols: list[str], out: str = "ordinal") -> DataFrame:
    """0-based global position in ``order_cols`` order."""
    return with_positions(df, [F.col(c) for c in order_cols], out)


def positional_split(df: DataFrame, order_cols: list[str], train_fraction: float = K.TRAIN_FRACTION,
                     out: str = "split") -> DataFrame:
    """First ``int(train_fraction * n)`` rows in order -> 'train', the rest
    -> 'val'. ``n`` is counted on the same materialised rows as the positions."""
    put = with_ordinal(df, order_cols, "_ord")
    cut = int(train_fraction * put.count())
    return put.withColumn(
        out, F.when(F.col("_ord") < cut, F.lit("train")).otherwise(F.lit("val"))).withColumnRenamed("_ord", "position")


def seed_hash(key: Column, seed) -> Column:
    """md5 hex of ``key || seed`` (same text in DuckDB)."""
    return F.md5(F.concat(key.cast("string"), F.lit(str(seed))))


def seed_number(key: Column, seed) -> Column:
    """First 32 bits of the md5 as a non-negative integer."""
    return F.conv(F.substring(seed_hash(key, seed), 1, 8), 16, 10).cast("long")


def seeded_shuffle(df: DataFrame, key: str, seed=K.DEFAULT_SEED, out: str = "position") -> DataFrame:
    """Deterministic shuffled position (0-based) of every row."""
    return (with_ordinal(df.withColumn("_h", seed_hash(F.col(key), seed)), ["_h", key], out).drop("_h"))


def hash_split(df: DataFrame, key: str, seed=K.DEFAULT_SEED, test_percent: int = 1,
               out: str = "split") -> DataFrame:
    """Stable per-key split: ``md5`` bucket < pct -> 'test'."""
    b = F.pmod(seed_number(F.col(key), seed), F.lit(100))
    return df.withColumn(out, F.when(b < test_percent, F.lit("test")).otherwise(F.lit("train")))


def mini_batches(df: DataFrame, key: str, batch_size: int, seed=K.DEFAULT_SEED) -> DataFrame:
    """Seeded shuffle, then ``batch_id = position div batch_size``."""
    s = seeded_shuffle(df, key, seed)
    return s.withColumn("batch_id", F.floor(F.col("position") / batch_size).cast("long"))


def epoch_batches(items: DataFrame, key: str, groups_per_step: int, num_epochs: int,
                  seed=K.DEFAULT_SEED, initial_step: int = 0, max_steps: int | None = None) -> DataFrame:
    """Step plan over ``num_epochs`` passes: each epoch has its own seeded
    order; ``groups_per_step`` items per step; steps numbered across epochs;
    steps before ``initial_step`` skipped; stop after ``max_steps`` (the
    step equal to max_steps is still produced, then the loop breaks)."""
    items = cut_lineage(items)
    n = items.count()
    steps_per_epoch = -(-n // groups_per_step)
    if max_steps is not None and n:  # later epochs hold no step that is kept
        num_epochs = min(num_epochs, max_steps // steps_per_epoch + 1)
    e = items.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(num_epochs - 1))))
    e = e.withColumn("_h", seed_hash(F.concat(F.col("epoch").cast("string"), F.lit(":"), F.col(key).cast("string")), seed))
    e = with_ordinal(e, ["epoch", "_h", key], "_ord").drop("_h")
    pos = F.col("_ord") - F.col("epoch") * F.lit(n)
    e = e.withColumn("epoch_step", F.floor(pos / groups_per_step).cast("long"))
    e = e.withColumn("step", F.col("epoch") * F.lit(steps_per_epoch) + F.col("epoch_step"))
    e = e.withColumn("slot", (pos % groups_per_step).cast("int")).drop("_ord")
    e = e.filter(F.col("step") >= initial_step)
    if max_steps is not None:
        e = e.filter(F.col("step") <= max_steps)
    return e


def head_limit(df: DataFrame, order_cols: list[str], limit, falsy_means_all: bool = True) -> DataFrame:
    """First ``limit`` rows in order. With ``falsy_means_all`` a limit of 0
    or None keeps every row (``if limit: head(limit)``); otherwise only None
    does (slice form ``[:limit]``, where 0 keeps nothing)."""
    if limit is None or (falsy_means_all and not limit):
        return df
    if int(limit) <= 0:
        return df.limit(0)
    return df.orderBy(*order_cols).limit(int(limit))


def synthetic_tasks(df: DataFrame, key: str, seed=K.DEFAULT_SEED) -> DataFrame:
    """Guess-game rows, one per input row: the fixed prompt and an answer
    drawn from the word list by a seeded hash of the key."""
    words = F.array(*[F.lit(w) for w in K.GUESS_WORDS])
    idx = F.pmod(seed_number(F.col(key), seed), F.lit(len(K.GUESS_WORDS))) + 1
    prompt = K.GUESS_SYSTEM_PROMPT + "\n\n" + K.GUESS_TASK
    return df.select(F.col(key), F.lit(prompt).alias("prompt"), F.element_at(words, idx.cast("int")).alias("answer"))


def pack_blocks(df: DataFrame, order_cols: list[str], tokens: str, budget: int) -> DataFrame:
    """Wrapped packing: all sequences laid end to end in order and cut into
    blocks of ``budget`` tokens. Adds ``start`` (global token offset),
    ``first_block`` and ``last_block`` of every sequence."""
    s = with_prefix_sum(df, order_cols, tokens, "start")
    end = F.col("start") + F.greatest(F.col(tokens) - 1, F.lit(0))
    return s.withColumns({
        "first_block": F.floor(F.col("start") / budget).cast("long"),
        "last_block": F.floor(end / budget).cast("long"),
    })


def block_pieces(packed: DataFrame, key: str, tokens: str, budget: int) -> DataFrame:
    """One row per (block, sequence): ``at`` place in the block, ``offset`` first
    token of the sequence that the block holds, ``n`` how many.  Sequences
    without tokens are in no block."""
    rows = packed.filter(F.col(tokens) > 0).withColumn("block", F.explode(F.sequence("first_block", "last_block")))
    begin = F.greatest(F.col("start"), F.col("block") * budget)
    end = F.least(F.col("start") + F.col(tokens), (F.col("block") + 1) * budget)
    return rows.select("block", key, (begin - F.col("block") * budget).alias("at"), (begin - F.col("start")).alias("offset"), (end - begin).alias("n"))


def first_tokens(text, limit: int) -> Column:
    """The text up to the end of its ``limit``-th whitespace token, otherwise
    as it stands."""
    col = F.col(text) if isinstance(text, str) else text
    words, gaps = F.regexp_extract_all(col, F.lit("\\S+"), 0), F.split(col, "\\S+", -1)
    head = F.zip_with(F.slice(gaps, 1, limit), F.slice(words, 1, limit), lambda g, w: F.concat(g, w))
    return F.when(F.size(words) <= limit, col).otherwise(F.array_join(head, ""))
