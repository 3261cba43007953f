"""File sources: raw JSON records, folder listings, label contents, manifests.

* Listings read file metadata only (``binaryFile`` with no ``content`` column
  selected, so no file body is opened).
* A raw-record scan with a limit sorts the listing by file name and takes
  the first ``limit`` paths before any content is read; only those paths
  (at most ``limit`` strings) are handed to the reader.
* Bytes are decoded as UTF-8 when valid, else as Latin-1; validity of the
  JSON is decided by Python's strict parser (see ``functions.udfs``), and
  records that fail are returned in a rejected-rows DataFrame with a reason
  instead of stopping the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.udfs import PARSED_SCHEMA, parse_completion

STEM_RE = "([^/]+)\\.[^./]+$"
NAME_RE = "([^/]+)$"


#: Splits that one task reads.  A split holds at most 32 small files, fewer than
#: are worth a task.
TASK_SPLITS = 16


#: Not moved by Spark below ``fewer_tasks``, where it would start a Python worker's
#: stream for every split, nor run a second time for a filter on its result.
_parse_once = F.arrow_udf(parse_completion.func, PARSED_SCHEMA).asNondeterministic()


def fewer_tasks(files: DataFrame) -> DataFrame:
    """The rows of many small files in fewer tasks, without a shuffle; every
    core keeps several."""
    n = max(4 * files.sparkSession.sparkContext.defaultParallelism, -(-files.rdd.getNumPartitions() // TASK_SPLITS))
    return files.coalesce(n)


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, name, stem, length, modificationTime) of the files in a folder."""
    df = fewer_tasks(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
                     .select("path", "length", "modificationTime"))
    return df.select("path",
                     F.regexp_extract("path", NAME_RE, 1).alias("name"),
                     F.regexp_extract("path", STEM_RE, 1).alias("stem"),
                     "length", "modificationTime")


def listing_digest(spark: SparkSession, folder: str) -> str:
    """Digest of a folder's (or file's) names, lengths and modification times."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    r = every.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("a"),
                  F.bit_xor(F.xxhash64(F.lit(1), "path", "length", "modificationTime")).alias("b")).first()
    return f"{r['n']}-{r['a']}-{r['b']}"


def first_files(spark: SparkSession, folder: str, limit: int | None, glob: str = "*") -> DataFrame:
    """Listing sorted by file name, first ``limit`` entries (all when None
    or 0)."""
    lst = list_files(spark, folder, glob)
    return lst.orderBy("name").limit(int(limit)) if limit else lst


def _decode(content) -> F.Column:
    as_utf8 = content.cast("string")
    return F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(F.decode(content, "ISO-8859-1"))


def read_raw_records(spark: SparkSession, folder: str, schema: T.StructType, limit: int | None = None,
                     glob: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(records, rejected). ``records`` has ``path`` plus the ``schema``
    columns; ``rejected`` has ``path`` and ``reason``."""
    if limit:
        paths = [r["path"] for r in first_files(spark, folder, limit, glob).select("path").collect()]
        if not paths:
            empty = spark.createDataFrame([], T.StructType([T.StructField("path", T.StringType())]))
            return (empty.select("path", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]),
                    empty.withColumn("reason", F.lit(None).cast("string")))
        raw = spark.read.format("binaryFile").load(paths)
    else:
        raw = fewer_tasks(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content"))
    text = raw.select("path", _decode(F.col("content")).alias("text"))
    checked = text.withColumn("_p", _parse_once(F.col("text")))
    ok = F.col("_p.outcome") == "whole"
    records = checked.filter(ok).select("path", F.from_json("text", schema).alias("r")).select("path", "r.*")
    rejected = checked.filter(~ok).select(
        "path", F.when(F.col("_p.outcome") == "not_object", F.lit("JSON value is not an object"))
        .otherwise(F.lit("invalid JSON")).alias("reason"))
    return records, rejected


def split_listing(spark: SparkSession, pdfs_dir: str, labels_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pdf listing, label listing) keyed by file stem; metadata only."""
    pdfs = list_files(spark, pdfs_dir, "*.pdf").select("stem", "path")
    labels = list_files(spark, labels_dir, "*.json").select("stem", "path")
    return pdfs, labels


def read_label_contents(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """(path, content): each label file as one string, UTF-8 or else Latin-1."""
    df = spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(folder)
    whole = fewer_tasks(df.select(F.col("_metadata.file_path").alias("path"), "value"))
    return whole.select("path", _decode(F.col("value").cast("binary")).alias("content"))


MANIFEST_SCHEMA = T.StructType([
    T.StructField("patent_id", T.StringType()),
    T.StructField("pdf_path", T.StringType()),
    T.StructField("gold_json_path", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("split", T.StringType()),
])


def read_manifest(spark: SparkSession, path: str, schema: T.StructType = MANIFEST_SCHEMA) -> DataFrame:
    """Manifest parquet with a declared schema (no inference job); partition
    filters on ``split`` prune folders."""
    return spark.read.schema(schema).parquet(path)


def extract_text(files: DataFrame, extractor_factory, fallback_factory=None, path: str = "path",
                 content: str = "content") -> DataFrame:
    """User text-extraction hook over file bytes, run with ``mapInPandas``:
    the extractor is built once per partition (``extractor_factory()``
    returns ``bytes -> str``); when it raises, the fallback is tried; a file
    that both fail on gets a null text and the error message."""
    def run(batches):
        ext = extractor_factory()
        fb = fallback_factory() if fallback_factory else None
        for pdf in batches:
            texts, errors = [], []
            for b in pdf[content]:
                try:
                    texts.append(ext(b))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    if fb is None:
                        texts.append(None)
                        errors.append(str(e))
                        continue
                    try:
                        texts.append(fb(b))
                        errors.append(None)
                    except Exception as e2:  # noqa: BLE001
                        texts.append(None)
                        errors.append(str(e2))
            yield pdf[[path]].assign(text=texts, error=errors)

    schema = T.StructType([T.StructField(path, T.StringType()), T.StructField("text", T.StringType()),
                           T.StructField("error", T.StringType())])
    return files.select(path, content).mapInPandas(run, schema)
