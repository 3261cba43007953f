"""Sinks: manifests, label records, training rows, and build-once
materialisation (the email corpus is written by ``plans.store``).

Writes go through Spark's file commit protocol (a ``_SUCCESS`` marker only
after every task committed), so a job retried after an executor loss either
finds a complete table or rebuilds it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of a folder that ``write_row_files`` makes.
FOLDER_FILES = 1000


def write_manifests(df: DataFrame, path: str, max_records_per_file: int = 100_000) -> None:
    """One table partitioned by ``split`` (train / val / test folders)."""
    (df.write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file)
     .partitionBy("split").parquet(path))


def write_label_records(df: DataFrame, path: str) -> None:
    """One JSON line per record (``file_stem``, ``json``) instead of one file
    per record."""
    df.select("file_stem", "json").write.mode("overwrite").json(path)


def write_training_rows(df: DataFrame, path: str, columns=("prompt", "gold_json", "patent_id"),
                        max_records_per_file: int = 100_000) -> None:
    df.select(*columns).write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file).parquet(path)


def write_row_files(df: DataFrame, path: str, folder_files: int = FOLDER_FILES) -> str:
    """One text file, ended by a newline, for each row of a one-column table (a
    null gives the newline alone), in folders of at most ``folder_files`` under
    ``path``: a fresh folder that all executors share, any that ``pyarrow.fs``
    opens.  Names tell the task and the row, so a task that runs again writes the
    same files again and nothing is left to commit file by file; folders are
    listed side by side.  That holds for rows that come in the same order again,
    as a scan gives them, and without speculative attempts (Spark's default): one
    that outlives the job could be writing a file while it is read."""
    def run(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(path)
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for value in batch.column(0).cast(pa.string()):
                folder = f"{base}/folder={task:05d}-{n // folder_files:05d}"
                if n % folder_files == 0:
                    fs.create_dir(folder, recursive=True)
                with fs.open_output_stream(f"{folder}/part-{task:05d}-{n:09d}.txt") as out:
                    out.write((value.as_buffer().to_pybytes() if value.is_valid else b"") + b"\n")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    fs, base = pyarrow.fs.FileSystem.from_uri(path)
    fs.create_dir(base, recursive=True)  # stays empty if there are no rows
    df.mapInArrow(run, "n long").agg(F.sum("n")).first()
    return path


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def plan_key(*frames: DataFrame) -> str:
    """Digest of what the frames compute: their analysed plans in canonical
    form, whole, without the numbers that differ from session to session.  It
    hangs on columns, expressions and joins, not on where the input lies."""
    conf, limit = frames[0].sparkSession.conf, "spark.sql.debug.maxToStringFields"
    before = conf.get(limit)
    conf.set(limit, "100000")
    try:
        text = "\n".join(df._jdf.queryExecution().analyzed().canonicalized().toString() for df in frames)
    finally:
        conf.set(limit, before)
    text = re.sub(r"#\d+L?", "", text)
    return hashlib.sha256(re.sub(r"\b([a-z])_\d+\b", r"\1", text).encode()).hexdigest()


def build_once(spark: SparkSession, path: str, build: Callable[[], DataFrame],
               writer: Callable[[DataFrame, str], None] | None = None, schema: str | None = None) -> DataFrame:
    """Read the table at ``path`` if a complete one is there (``_SUCCESS``),
    else build, write and read it; with ``schema`` no file is opened to learn it."""
    if not _exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        df = build()
        if writer:
            writer(df, path)
        else:
            df.write.mode("overwrite").parquet(path)
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)
