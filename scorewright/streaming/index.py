"""Search-index upkeep from a change feed (inserts, updates, deletes).

The index is one base table and a few deltas, each with one row per message:
its last change by ``seq`` and, per field, its tokens in order with a space
between (no token holds one), so a row that is dealt out or merged takes no more
room than the text.  A delete has none; its row stays so that an older change
that comes late does not bring the message back.

* A micro-batch is reduced to the last change of every message and written as a
  delta (the first one as the base), so its cost goes with the batch.
* Once the deltas hold more than ``SHARE`` of the base's rows, base and deltas
  are merged into a new base.  So what a read goes through is at most 1 + SHARE
  times the messages, however many changes there were, and the rewriting adds
  up to a few times the changes.
* A manifest, written last and named by the batch, says which tables make up
  the index.  Readers take the newest complete manifest; a retried batch starts
  from the manifest before it and makes the same tables again.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fts_tokens

FIELDS = ("subject", "body")
#: Rows of the deltas over those of the base from which they are merged.
SHARE = 0.25
ROWS = "message_id string, seq long, op string, subject string, body string"
MANIFEST = "base long, deltas array<long>, base_rows long, delta_rows long"


class Index(NamedTuple):
    """The tables that make up the index, by the batch that wrote them."""

    base: int | None = None
    deltas: list[int] = []
    base_rows: int = 0
    delta_rows: int = 0


def last_changes(changes: DataFrame, values: list[Column] | None = None) -> DataFrame:
    """One row per message, that with the greatest ``seq``.  Of rows that share
    it, the one with the greatest digest of its ``values`` (all other columns)
    stays, so a retry takes the same.  Rows are dealt out once, by message."""
    values = values or [F.col(c) for c in sorted(changes.columns) if c not in ("message_id", "seq")]
    marked = changes.filter("message_id is not null and seq is not null").withColumn("_mark", F.sha2(F.to_json(F.struct(*values)), 256))
    w = Window.partitionBy("message_id").orderBy(F.col("seq").desc(), F.col("_mark").desc())
    return marked.withColumn("_no", F.row_number().over(w)).filter("_no = 1").drop("_no", "_mark")


def _words(field: str) -> Column:
    """The tokens of a field as one text."""
    return F.array_join(fts_tokens(field), " ").alias(field)


def _tokens() -> Column:
    """(term, field, pos) of a row's tokens."""
    def of(field):
        terms = F.when(F.col(field) != "", F.split(field, " ")).otherwise(F.array().cast("array<string>"))
        return F.transform(terms, lambda t, i: F.struct(t.alias("term"), F.lit(field).alias("field"), i.alias("pos")))
    return F.concat(*map(of, FIELDS)).alias("tokens")


def read_manifest(spark: SparkSession, root: str, before: int | None = None) -> Index:
    """The index as the newest complete manifest (of a batch below ``before``) has it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return Index()
    batches = (int(s.getPath().getName()) for s in fs.listStatus(path) if s.isDirectory())
    for batch in sorted((b for b in batches if before is None or b < before), reverse=True):
        if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/{batch}/_SUCCESS")):
            return Index(*spark.read.schema(MANIFEST).parquet(f"{root}/manifest/{batch}").first())
    return Index()


def current(spark: SparkSession, root: str, index: Index) -> DataFrame:
    """The last change of every message, deletes included.  Only the deltas are
    grouped; the base is scanned and loses the messages that they replace."""
    def table(*paths):
        return spark.read.schema(ROWS).parquet(*paths) if paths else spark.createDataFrame([], ROWS)
    base = table(*([f"{root}/base/{index.base}"] if index.base is not None else []))
    if not index.deltas:
        return base
    late = table(*[f"{root}/delta/{d}" for d in index.deltas])
    if len(index.deltas) > 1:  # one alone has a row per message
        late = last_changes(late, [F.col("op"), _tokens()])
    if index.base is None:
        return late
    newer = base.alias("b").join(late.select("message_id", F.col("seq").alias("late")), "message_id", "left")
    older = late.join(base.select("message_id", F.col("seq").alias("held")), "message_id", "left")
    return newer.filter("late is null or seq > late").drop("late").unionByName(older.filter("held is null or seq >= held").drop("held"))


def apply_changes(root: str, share: float = SHARE):
    """foreachBatch function: change rows (op, message_id, subject, body, seq)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = read_manifest(spark, root, batch_id)
        own = last_changes(batch.select("op", "message_id", "subject", "body", "seq"))
        rows = own.select("message_id", "seq", "op", *map(_words, FIELDS))
        first = old == Index()
        path = f"{root}/{'base' if first else 'delta'}/{batch_id}"
        rows.write.mode("overwrite").parquet(path)
        n = spark.read.schema(ROWS).parquet(path).count()
        new = Index(batch_id, [], n, 0) if first else old._replace(deltas=[*old.deltas, batch_id], delta_rows=old.delta_rows + n)
        if new.delta_rows > share * new.base_rows:
            current(spark, root, new).write.mode("overwrite").parquet(f"{root}/base/{batch_id}")
            new = Index(batch_id, [], spark.read.schema(ROWS).parquet(f"{root}/base/{batch_id}").count(), 0)
        spark.createDataFrame([new], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/{batch_id}")
    return run


def live_postings(spark: SparkSession, root: str) -> DataFrame:
    """Postings (message_id, term, field, pos) of the messages as they stand;
    none before the first batch."""
    now = current(spark, root, read_manifest(spark, root)).filter("op != 'delete'")
    return now.select("message_id", F.inline(_tokens()))


def run_change_feed(spark: SparkSession, changes_dir: str, schema, root: str, checkpoint: str,
                    files_per_batch: int | None = None) -> None:
    """Consume every change file available now."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    q = (reader.parquet(changes_dir).writeStream.foreachBatch(apply_changes(root)).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
