"""Email corpus build: clean recipient arrays, drop long or over-addressed
messages, keep the first copy of each (subject, body, sender), and write the
``emails`` and ``recipients`` tables.

Order of steps (a row failing an earlier step never reaches a later one):
clean addresses -> body length -> recipient count -> dedup.

Dedup groups on a digest of (subject, body, sender) with a narrow partial
aggregate (digest, least ordinal, count), so a group of copies that holds a
third of all rows sends one short row per map task, and no text is sorted; the
kept rows are then joined by ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def clean_addresses(df: DataFrame, cols=K.RECIPIENT_TYPES) -> DataFrame:
    """Drop null and empty entries of each address array; null array -> []."""
    empty = F.array().cast("array<string>")
    return df.withColumns({
        cname: F.filter(F.coalesce(F.col(cname), empty), lambda x: x.isNotNull() & (x != ""))
        for cname in cols
    })


def recipient_count(cols=K.RECIPIENT_TYPES) -> Column:
    total = F.lit(0)
    for cname in cols:
        total = total + F.size(cname)
    return total


def with_outcome(df: DataFrame, body: str = "body", max_body: int = K.MAX_BODY_CHARS,
                 max_recipients: int = K.MAX_RECIPIENTS) -> DataFrame:
    """Adds ``stage_outcome``: invalid (null body), skipped (too long / too
    many recipients) or candidate (goes on to dedup)."""
    return df.withColumn(
        "stage_outcome",
        F.when(F.col(body).isNull(), F.lit("invalid"))
        .when(F.length(body) > max_body, F.lit("skipped"))
        .when(recipient_count() > max_recipients, F.lit("skipped"))
        .otherwise(F.lit("candidate")))


DEDUP_KEYS = ("subject", "body", "from")


def key_digest(keys=DEDUP_KEYS) -> Column:
    """SHA-256 of the key values with their lengths; a null is its own value."""
    parts = [F.coalesce(F.concat(F.octet_length(k).cast("string"), F.lit(":"), F.col(k)), F.lit("-")) for k in keys]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def keep_first(df: DataFrame, keys=DEDUP_KEYS, ordinal: str = "ordinal") -> DataFrame:
    """First row per key in ordinal order (null keys compare equal; ordinals
    are unique) plus the number of copies dropped (``n_copies - 1``) on the
    kept row."""
    narrow = df.select(key_digest(keys).alias("_key"), ordinal)
    first = narrow.groupBy("_key").agg(F.min(ordinal).alias(ordinal), (F.count(F.lit(1)) - 1).alias("dropped_copies"))
    kept = df.join(first.drop("_key"), ordinal)
    return kept.select(*keys, *[c for c in df.columns if c not in keys], "dropped_copies")


def dedup_emails(source: DataFrame) -> DataFrame:
    """Cleaned, filtered, deduplicated messages (the rows that are kept)."""
    staged = with_outcome(clean_addresses(source))
    cand = staged.filter(F.col("stage_outcome") == "candidate").drop("stage_outcome")
    return keep_first(cand)


def build_outcomes(source: DataFrame) -> DataFrame:
    """Counts per outcome: kept, skipped (length and recipients share one
    counter), duplicate, invalid. One pass over the source and narrow partial
    aggregates; kept and duplicate are there even without a message."""
    staged = with_outcome(clean_addresses(source))
    staged = staged.select("stage_outcome", F.when(F.col("stage_outcome") == "candidate", key_digest()).alias("_key"))
    groups = staged.groupBy("stage_outcome", "_key").agg(F.count(F.lit(1)).alias("n"))

    def row(name, n):
        return F.struct(name.alias("outcome"), n.cast("long").alias("n"))
    rows = F.when(F.col("_key").isNotNull(), F.array(row(F.lit("kept"), F.lit(1)), row(F.lit("duplicate"), F.col("n") - 1)))
    counted = groups.select(F.inline(rows.otherwise(F.array(row(F.col("stage_outcome"), F.col("n"))))))
    always = source.sparkSession.range(2).select(F.when(F.col("id") == 0, "kept").otherwise("duplicate").alias("outcome"), F.lit(0).cast("long").alias("n"))
    return counted.unionByName(always).groupBy("outcome").agg(F.sum("n").alias("n"))


def emails_table(kept: DataFrame) -> DataFrame:
    """``emails``: surrogate id (source ordinal, unique and stable under
    retries), unique message_id, date stored as ``yyyy-MM-dd HH:mm:ss`` text."""
    return kept.select(
        F.col("ordinal").alias("id"),
        "message_id", "subject",
        F.col("from").alias("from_address"),
        F.date_format("date", K.EMAIL_DATE_FORMAT).alias("date"),
        "body", "file_name",
    )


def recipients_table(kept: DataFrame) -> DataFrame:
    """``recipients``: one row per (message, address, type) in to, cc, bcc
    order, with the position inside its type list. One explode, no union."""
    def tagged(rtype):
        return F.transform(rtype, lambda a, i: F.struct(a.alias("addr"), F.lit(rtype).alias("rtype"), i.alias("pos")))

    parts = [tagged(rtype) for rtype in K.RECIPIENT_TYPES]
    return kept.select("message_id", F.explode(F.concat(*parts)).alias("r")).select(
        F.col("message_id").alias("email_id"),
        F.col("r.addr").alias("recipient_address"),
        F.col("r.rtype").alias("recipient_type"),
        F.col("r.pos").alias("position"),
    )


def unique_violations(emails: DataFrame, key: str = "message_id") -> DataFrame:
    """Keys that occur more than once (empty when the constraint holds)."""
    return emails.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def assert_unique(emails: DataFrame, key: str = "message_id") -> None:
    bad = unique_violations(emails, key).limit(1).count()
    if bad:
        raise ValueError(f"duplicate {key} values in emails")


#: Folders of tables that are looked up by message id.
ID_SLOTS = 32


def id_slot(message_id: str) -> Column:
    return F.pmod(F.xxhash64(message_id), F.lit(ID_SLOTS)).cast("int")


def _slots_of(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """A table in folders by ``slot``, cut to the folders of the wanted ids: at
    most ID_SLOTS numbers, known at run time before a file is opened."""
    if "slot" not in table.columns:
        return table
    slots = wanted.agg(F.collect_set(id_slot("message_id")).alias("s")).scalar()
    return table.filter(F.array_contains(slots, F.col("slot")))


def read_emails(emails: DataFrame, recipients: DataFrame, ids: DataFrame, id_col: str = "message_id") -> DataFrame:
    """Batch point lookup: each requested id with its recipients collected by
    type (case-insensitive; other types ignored; missing -> []), in original
    order. Unknown ids give no row. A message has at most MAX_RECIPIENTS
    recipients, so each collected group is bounded.  Of tables in folders by
    ``slot`` only the folders of the requested ids are read."""
    wanted = ids.select(F.col(id_col).alias("message_id")).distinct()
    base = _slots_of(emails, wanted).join(wanted, "message_id", "left_semi")
    rec = _slots_of(recipients, wanted).join(wanted.withColumnRenamed("message_id", "email_id"), "email_id", "left_semi")
    t = F.lower("recipient_type")

    def pick(kind):
        items = F.array_sort(F.collect_list(F.when(t == kind, F.struct("position", "recipient_address"))))
        return F.transform(items, lambda s: s["recipient_address"]).alias(f"{kind}_addresses")

    agg = rec.groupBy("email_id").agg(*[pick(k) for k in K.RECIPIENT_TYPES])
    empty = F.array().cast("array<string>")
    out = base.join(agg, base.message_id == agg.email_id, "left").drop("email_id")
    return out.select(
        "message_id", "date", "subject", "from_address",
        *[F.coalesce(F.col(f"{k}_addresses"), empty).alias(f"{k}_addresses") for k in K.RECIPIENT_TYPES],
        "body", "file_name")
