"""Operator 3 (native): quality rules in a bitmask ledger.

Every rule is evaluated once per text; the ledger keeps the measurements and
one failure bit per rule.  Policies are versioned sets of rules applied to the
stored bits, and ablations are bitwise aggregations over the ledger, so neither
reads a text again.  Spark functions only; no shuffle before an aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Rules in bit order: name -> failure condition over the measurements.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "100 * n_symbols > 50 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
}

#: Policies: name -> version -> rules that a kept document must pass.
POLICIES = {
    "base": {1: ("few_words", "repeated_windows")},
    "prose": {
        1: ("few_words", "repeated_windows", "many_symbols"),
        2: ("few_words", "repeated_windows", "many_symbols", "duplicate_lines", "short_words", "long_words"),
    },
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def policy_mask(name: str, version: int) -> int:
    return sum(bit(r) for r in POLICIES[name][version])


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the measurements of each whole text.

    Repeated windows are found inside the row: the 3-word windows' hashes are
    sorted with their positions in the low bits, so equal neighbours are
    repeats; a text whose hashes are all distinct skips that.  (Two different
    windows of one text are taken as equal only if they agree in the 64-bit
    hash less the position bits, about 2**-50.)"""
    t = F.coalesce(F.col("_t"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("_t")).select(
        "doc_id", F.array_remove(F.split(t, WORD_GAP), "").alias("w"), lines.alias("lines"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    step = step.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    own = ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    windows = F.transform(F.slice("h", 1, F.greatest(F.size("h") - 2, F.lit(0))),
                          lambda x, i: F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2)))
    step = step.select(*own, windows.alias("g"))
    # the position takes as many low bits as the text needs
    step = step.select(*own, "g", F.length(F.bin(F.size("g").cast("long"))).alias("bits"),
                       (F.size(F.array_distinct("g")) < F.size("g")).alias("some"))
    step = step.withColumn("low", F.expr("shiftleft(1L, bits) - 1"))
    step = step.select(*own, "bits", "low", F.when(F.col("some"), F.sort_array(
        F.transform("g", lambda x, i: x.bitwiseAND(F.bitwise_not("low")).bitwiseOR(i.cast("long"))))).alias("s"))

    def same(x, other):
        return F.call_function("shiftrightunsigned", x.bitwiseXOR(other), F.col("bits")) == 0

    hit = F.filter("s", lambda x, i: same(x, F.get("s", i - 1)) | same(x, F.get("s", i + 1)))
    step = step.select(*own, F.transform(hit, lambda x: x.bitwiseAND(F.col("low"))).alias("p"))
    reach = F.array_union(F.array_union("p", F.transform("p", lambda x: x + 1)), F.transform("p", lambda x: x + 2))
    return step.select(*own, F.when(F.col("p").isNull(), 0).otherwise(F.size(reach)).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, measurements and ``fails``: bit k is set when rule k fails.

    One row per input row.  A null text has no words (like an empty one) and so
    fails ``few_words``; a null doc_id stays null; other columns are not read."""
    bits = sum((F.when(F.expr(cond), F.lit(bit(name)).cast("long")).otherwise(F.lit(0).cast("long"))
                for name, cond in RULES.items()), F.lit(0).cast("long"))
    return measure(docs, doc_id, text).withColumn("fails", bits)


def apply_policy(book: DataFrame, name: str, version: int, out: str = "kept") -> DataFrame:
    """Adds ``out``: no rule of the policy version failed."""
    return book.withColumn(out, F.col("fails").bitwiseAND(F.lit(policy_mask(name, version)).cast("long")) == 0)


def ablations(book: DataFrame, name: str, version: int) -> DataFrame:
    """Per rule of the policy: documents that fail it, and documents that only
    it rejects (kept if the rule is left out).  One bitwise aggregation with
    partial sums, one output row per rule; an empty ledger gives zeros."""
    rules, mask = POLICIES[name][version], policy_mask(name, version)
    own = F.col("fails").bitwiseAND(F.lit(mask).cast("long"))
    sums = [F.count_if(own.bitwiseAND(F.lit(bit(r)).cast("long")) != 0).alias(f"f_{r}") for r in rules]
    sums += [F.count_if(own == F.lit(bit(r)).cast("long")).alias(f"o_{r}") for r in rules]
    one = book.agg(*sums)
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"o_{r}").alias("n_only")) for r in rules])
    return one.select(F.inline(rows))


def quality_rules(docs: DataFrame, policy: str = "prose", version: int = 2, **names) -> DataFrame:
    """Ledger with the verdicts: base_failed, and kept (never if base_failed)."""
    book = apply_policy(apply_policy(ledger(docs, **names), "base", 1, "_ok"), policy, version, "_kept")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~F.col("_ok")).alias("base_failed"), (F.col("_ok") & F.col("_kept")).alias("kept"), "fails")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
      coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (rid)),
f AS (SELECT *, (n_words < 50) OR (100 * n_repeat_words > 50 * n_words) AS base_failed,
      (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
       + CASE WHEN 100 * n_symbols > 50 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
       + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END)::BIGINT AS fails FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, fails = 0 AS kept, fails FROM f
"""
