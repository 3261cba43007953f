"""Operator 10 (native): benchmark decontamination by winnowing.

Fingerprints are the least k-gram hash of every run of W consecutive k-grams,
so any shared span of k + W - 1 = 10 words has at least one in common.  The
fingerprints of both sides are joined, and each hit is extended to all 10-word
windows that hold it, which are compared word for word with the items'
windows: exact, whatever the hashes do.  An item of fewer than 10 words is one
window of its own length and is looked up by the hash of that many words.
Spark functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .sieve import sieve, without

WINDOW, GRAM = 10, 5
RUN = WINDOW - GRAM + 1
HALF = (RUN + 1) // 2
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Low bits of a packed fingerprint that hold the position (modulo 2**24).
POS_BITS = 24


def words(text: Column) -> Column:
    """Words of a text as they stand; ``lowered`` folds A-Z of one word."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def lowered(x: Column) -> Column:
    return F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))


def hashes(text: Column) -> Column:
    return F.transform(words(text), lambda x: F.xxhash64(lowered(x)))


def gram_hashes(h: str, n: int) -> Column:
    """Hash of every n consecutive word hashes."""
    return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (n - 1), F.lit(0))),
                       lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, n)]))


def packed(grams: Column) -> Column:
    """Hash in the high bits, position modulo 2**24 in the low ones."""
    low = (1 << POS_BITS) - 1
    return F.transform(grams, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(low))))


def least_of(p: str, *steps: int) -> Column:
    """The least of each element and those ``steps`` places on, as far as all are there."""
    return F.transform(F.slice(p, 1, F.greatest(F.size(p) - max(steps), F.lit(0))), lambda x, i: F.least(x, *[F.get(p, i + k) for k in steps]))


def halves(p: str) -> Column:
    """Least packed hash of every HALF neighbours."""
    return least_of(p, *range(1, HALF))


def winnowed(m: str) -> Column:
    """Distinct least packed hashes of every RUN neighbours, from ``halves``."""
    return F.array_distinct(least_of(m, RUN - HALF))


def fingerprints(rows: DataFrame, own: list[str], text: str, lengths: list[int]) -> DataFrame:
    """(own columns, n, key, pos): winnowed fingerprints (n = 10) and, for each
    n in ``lengths``, every n-gram."""
    step = rows.select(*own, hashes(F.col(text)).alias("h"))
    step = step.select(*own, "h", packed(gram_hashes("h", GRAM)).alias("p"))
    step = step.select(*own, "h", halves("p").alias("m"))
    def tagged(prints: Column, n: int) -> Column:
        return F.transform(prints, lambda x: F.struct(F.lit(n).alias("n"), x.alias("p")))

    arrays = [tagged(winnowed("m"), WINDOW), *[tagged(packed(gram_hashes("h", n)), n) for n in lengths]]
    flat = arrays[0] if len(arrays) == 1 else F.concat(*arrays)
    return step.select(*own, F.inline(flat)).select(
        *own, "n", F.expr(f"shiftright(p, {POS_BITS})").alias("key"), F.col("p").bitwiseAND(F.lit((1 << POS_BITS) - 1)).alias("pos"))


def item_windows(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """Each distinct window (n words, joined by a space) with the ids of the
    items that hold it."""
    step = items.select(F.col(item_id).cast("string").alias("item"), F.transform(words(F.col(text)), lowered).alias("w"))
    step = step.filter(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(WINDOW)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)
    step = step.select("item", "n", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))).alias("window"))
    return step.groupBy("n", "window").agg(F.collect_set("item").alias("items"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("_t")).withColumn("_th", F.xxhash64("_t"))


def _hits(docs: DataFrame, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(_d, _h, n_hit, items) of the keyed documents (doc_id, _t, _th) that hold
    a window.

    The items' windows and fingerprints are written (their size is then known,
    so Spark broadcasts them below its threshold and shuffles them otherwise).
    One pass over the texts joins the documents' fingerprints with them.  Only
    documents with a hit have the windows around their hits compared: a filter
    over their keys, made at run time, stands at the second reading of the
    texts, so no other text is shuffled."""
    spark = docs.sparkSession
    items = items.select(items[item_id].alias("_item"), items[item_text].alias("_text"))

    win_path, fp_path, cand_path = (scratch_path(spark, f"op10-{x}") for x in ("windows", "prints", "hits"))
    item_windows(items, "_item", "_text").write.parquet(win_path)
    windows = spark.read.parquet(win_path)
    short = [r.n for r in windows.filter(F.col("n") < WINDOW).select("n").distinct().collect()]  # at most nine numbers
    prints = fingerprints(windows.select(F.col("n").alias("own"), "window"), ["own"], "window", sorted(short)).filter("own = n")
    prints.select("n", "key").distinct().write.parquet(fp_path)
    prints = spark.read.parquet(fp_path)

    key = ["doc_id", "_th"]
    found = fingerprints(docs, key, "_t", sorted(short)).join(prints, ["n", "key"], "left_semi")
    found.groupBy(*key).agg(F.collect_set(F.struct("n", "pos")).alias("hits")).write.parquet(cand_path)
    cand = spark.read.parquet(cand_path).select(F.col("doc_id").alias("_d"), F.col("_th").alias("_h"), "hits")

    # extend: every window of the right length that holds a hit
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("_th").eqNullSafe(F.col("_h"))
    near = docs.filter(sieve(cand.select(F.col("_d").alias("doc_id"), F.col("_h").alias("_th")), key))
    held = near.join(cand, same).select(*key, "hits", F.transform(words(F.col("_t")), lowered).alias("w"))
    turn = 1 << POS_BITS
    place = F.transform("hits", lambda x: F.transform(
        F.sequence(x["pos"], F.greatest(F.size("w").cast("long"), x["pos"]), F.lit(turn).cast("long")),
        lambda p: F.struct(x["n"].alias("n"), p.alias("pos"))))
    around = F.transform(F.flatten(place), lambda x: F.transform(
        F.sequence(F.when(x["n"] == WINDOW, x["pos"] - (WINDOW - GRAM)).otherwise(x["pos"]), x["pos"]),
        lambda s: F.struct(x["n"].alias("n"), s.alias("start"))))
    starts = F.filter(F.array_distinct(F.flatten(around)), lambda x: (x["start"] >= 0) & (x["start"] + x["n"] <= F.size("w")))
    tried = held.select(*key, F.explode(F.transform(starts, lambda x: F.struct(
        x["n"].alias("n"), x["start"].alias("start"), F.array_join(F.slice("w", (x["start"] + 1).cast("int"), x["n"]), " ").alias("window")))).alias("x"))
    hits = tried.select(*key, "x.*").join(windows, ["n", "window"])
    covered = F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)))))
    per_doc = hits.groupBy(*key).agg(covered.cast("long").alias("n_hit"),
                                     F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return per_doc.select(F.col("doc_id").alias("_d"), F.col("_th").alias("_h"), "n_hit", "items")


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated.

    Documents are told apart by (doc_id, hash of text), so repeated rows and
    null ids keep their own results.  A null text has no words; a document
    without words, and any document when there are no items, is clean; other
    columns are not read."""
    docs = _keyed(docs, doc_id, text)
    per_doc = _hits(docs, items, item_id, item_text)
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("_th").eqNullSafe(F.col("_h"))
    every = docs.select("doc_id", "_th", F.size(words(F.col("_t"))).cast("long").alias("n_words"))
    out = every.join(per_doc, same, "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                      F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
                      F.col("n_hit").isNotNull().alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows without a hit, with all their columns, whatever they are called.

    Null and empty texts, and any row when there are no items, stay; repeated
    rows stay or go together; a null doc_id is a value like others; a text of
    any length is compared whole; an empty table gives none.  The keys of the
    rows that go are written; other texts are not shuffled."""
    found = _hits(_keyed(docs, doc_id, text), items, item_id, item_text).select("_d", "_h")
    path = scratch_path(docs.sparkSession, "op10-contaminated")
    found.write.parquet(path)
    gone = docs.sparkSession.read.schema(found.schema).parquet(path)
    return without(docs, gone, [docs[doc_id].cast("long"), F.xxhash64(docs[text])])


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
      list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item,
      list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(ws[i : i + n - 1], ' ') AS win
       FROM (SELECT item, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(ws[i : i + n - 1], ' ') AS win
       FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, ns)),
hit AS (SELECT rid, dw.n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""
