"""Batch scoring: K completions per prompt against one gold row per prompt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prompts import completion_text


def score_batch(prompts: DataFrame, gold: DataFrame, score: Callable[[DataFrame], DataFrame], key: str = "prompt_id",
                completions: str = "completions") -> DataFrame:
    """``prompts`` holds an array of completions per key, each a string, one
    message or a list of messages; ``gold`` one row per key.  The two are
    joined on the key before the arrays are spread, so the texts are shuffled
    once and the rows of a prompt stay together for statistics by the same key.
    Returns ``score``'s columns on rows (key, gen_idx, completion, gold...).  A
    prompt without gold gives no rows, one without completions neither;
    ``unscored`` lists them."""
    rows = prompts.select(key, completions).join(gold, key)
    rows = rows.select(*gold.columns, F.posexplode(completions).alias("gen_idx", "completion"))
    return score(rows.withColumn("completion", completion_text(rows, "completion")))


def unscored(prompts: DataFrame, gold: DataFrame, key: str = "prompt_id", completions: str = "completions") -> DataFrame:
    """(key, reason) of what ``score_batch`` gives no rows for: prompts without
    completions or without gold, and gold without a prompt.  Only keys and the
    arrays' sizes are joined."""
    p = prompts.select(F.col(key).alias("_p"), (F.coalesce(F.size(completions), F.lit(0)) > 0).alias("_some"))
    g = gold.select(F.col(key).alias("_g"))
    both = p.join(g, F.col("_p") == F.col("_g"), "full")
    reason = (F.when(F.col("_some").isNull(), F.lit("no prompt")).when(F.col("_g").isNull(), F.lit("no gold"))
              .when(~F.col("_some"), F.lit("no completions")))
    return both.select(F.coalesce("_p", "_g").alias(key), reason.alias("reason")).filter(F.col("reason").isNotNull())
