"""Materialised corpus, written once per state of the input and of the build
(build-once, SNK-5) under the shared checkpoint folder and read by every search
and lookup:

* ``emails`` with their texts, in folders by a hash of the message id, so a
  lookup by id reads the wanted folders alone;
* ``recipients``, clustered by address for the filters, and in the same folders
  by message id for the lookups;
* ``mail``, the emails' ids, senders and dates, clustered by date, so the search
  filters read no text and skip dates;
* ``lists`` and ``stats``, the posting lists and messages per term, in folders
  by term bucket and clustered by term.

The lists are dealt out packed, a row per message and bucket, to as many tasks
for a bucket as the mail's text asks for (``PIECE_BYTES``), so the rows that a
task sorts stay in memory.  Every other clustered table is dealt by range on a
key that ends in the message id.  So a busy day, mailbox or term spans several
writers.  The folder's name holds a
digest of the input's listing and of the plans that build the tables: changed
build code makes a new store."""

from __future__ import annotations

import hashlib
import os
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, search
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import sinks
from ..sources.files import listing_digest
from ..sources.tables import table_path
from . import fixtures as fx

EMAILS = "id long, message_id string, subject string, from_address string, date string, body string, file_name string, slot int"
RECIPIENTS = "email_id string, recipient_address string, recipient_type string, position int"
MAIL = "message_id string, from_address string, date string"
LISTS = "term string, message_id string, places array<long>, bucket int"
STATS = "term string, n long, bucket int"


#: Bytes of text whose lists one task sorts; they take up to ten times as much in memory.
PIECE_BYTES = 24 << 20


class Store(NamedTuple):
    emails: DataFrame
    recipients: DataFrame
    lists: DataFrame
    stats: DataFrame
    mail: DataFrame
    recipients_by_id: DataFrame


def _kept(spark, sf_dir):
    return corpus.dedup_emails(fx.email_source(spark, sf_dir))


def _emails(kept):
    return corpus.emails_table(kept).withColumn("slot", corpus.id_slot("message_id"))


def _lists(emails, pieces=1):
    task = F.col("bucket") * pieces + F.pmod(F.xxhash64("message_id"), F.lit(pieces))
    return search.unpacked(search.packed_lists(emails).repartitionById(search.TERM_BUCKETS * pieces, task.cast("int")))


_KEYS: dict[tuple[str, ...], str] = {}


def build_key(spark: SparkSession, sf_dir: str) -> str:
    """Digest of the plans of the tables' builds; made once per session and input."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _KEYS:
        kept = _kept(spark, sf_dir)
        emails = _emails(kept)
        lists = _lists(emails)
        _KEYS[at] = sinks.plan_key(emails, corpus.recipients_table(kept), lists, search.term_stats(lists))
    return _KEYS[at]


def _base(spark: SparkSession, sf_dir: str, tag: str = "") -> str:
    tag = tag or os.environ.get("SCOREWRIGHT_STORE_TAG", "")
    h = hashlib.md5(f"{build_key(spark, sf_dir)} {listing_digest(spark, table_path(sf_dir, 'documents'))}".encode()).hexdigest()[:16]
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{h}{tag}"


def corpus_store(spark: SparkSession, sf_dir: str, tag: str = "") -> Store:
    base = _base(spark, sf_dir, tag)
    state = {}

    def kept():
        if "kept" not in state:
            state["kept"] = cut_lineage(_kept(spark, sf_dir))
        return state["kept"]

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def unique_emails():
        table = _emails(kept())
        corpus.assert_unique(table)
        return table

    def clustered(*order, folders=(), dealt=False):
        def write(df, path):
            out = (df if dealt else df.repartitionByRange(n, *order)).sortWithinPartitions(*order).write.mode("overwrite")
            (out.partitionBy(*folders) if folders else out).parquet(path)
        return write

    def table(name, build, schema, *order, folders=(), dealt=False):
        return sinks.build_once(spark, f"{base}/{name}", build, clustered(*order, folders=folders, dealt=dealt), schema)

    def sized_lists():
        size = F.sum(sum(F.coalesce(F.octet_length(f), F.lit(0)).cast("long") for f in search.FIELDS))
        share = search.TERM_BUCKETS * PIECE_BYTES
        return _lists(emails, max(1, -(-(emails.agg(size).first()[0] or 0) // share)))

    emails = table("emails", unique_emails, EMAILS, "slot", "message_id", folders=["slot"])
    recipients = table("recipients", lambda: corpus.recipients_table(kept()), RECIPIENTS, "recipient_address", "email_id")
    by_id = table("recipients_by_id", lambda: recipients.withColumn("slot", corpus.id_slot("email_id")), f"{RECIPIENTS}, slot int",
                  "slot", "email_id", folders=["slot"])
    mail = table("mail", lambda: emails.select("message_id", "from_address", "date"), MAIL, "date", "message_id")
    lists = table("lists", sized_lists, LISTS, "bucket", "term", "message_id", folders=["bucket"], dealt=True)
    stats = table("term_stats", lambda: search.term_stats(lists), STATS, "bucket", "term", folders=["bucket"])
    return Store(emails, recipients, lists, stats, mail, by_id)
