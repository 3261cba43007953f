"""Typed row validation: required fields, closed value sets and numeric
fields checked with ``try_cast``; failing rows are kept with a reason
instead of raising, so one bad record does not stop a job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCENARIO_REQUIRED = ("id", "question", "answer", "message_ids", "inbox_address", "query_date", "split")
SCENARIO_SPLITS = ("train", "test")


def validate_scenarios(raw: DataFrame) -> DataFrame:
    """Adds ``valid`` and ``reason`` (first failing rule) and the typed
    ``how_realistic_value``."""
    reason = None
    for f in SCENARIO_REQUIRED:
        cond = F.col(f).isNull()
        reason = F.when(cond, F.lit(f"missing {f}")) if reason is None else reason.when(cond, F.lit(f"missing {f}"))
    hr = F.col("how_realistic").cast("string").try_cast("float")
    reason = (reason.when(~F.col("split").isin(*SCENARIO_SPLITS), F.lit("split not in train/test"))
              .when(hr.isNull(), F.lit("how_realistic not a number")))
    return raw.withColumns({"reason": reason, "how_realistic_value": hr}).withColumn("valid", F.col("reason").isNull())
