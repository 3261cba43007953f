"""Scoring completions as they arrive (Structured Streaming).

* ``score_stream``: the batch reward columns applied to a streaming
  DataFrame; stateless, append mode.
* ``group_stats_stream``: per-prompt reward statistics in event-time windows
  with a watermark and append mode: a window is written once, when the
  watermark has passed it; its state is then dropped, and later rows for it
  are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import math_rewards


def score_stream(stream: DataFrame, text: str = "completion", answer: str = "answer") -> DataFrame:
    return math_rewards.score_math(stream, text, answer)


EPOCH_NTZ = "1970-01-01 00:00:00"


def ntz_to_instant(col) -> F.Column:
    """Wall-clock (TIMESTAMP_NTZ) read as UTC, as an instant: independent of
    the session time zone (a plain cast would use the session zone)."""
    secs = F.timestamp_diff("SECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), col)
    return F.timestamp_seconds(secs)


def instant_to_utc_text(col, fmt: str = "yyyy-MM-dd HH:mm:ss") -> F.Column:
    return F.date_format(F.timestamp_add("SECOND", F.unix_seconds(col), F.lit(EPOCH_NTZ).cast("timestamp_ntz")), fmt)


def group_stats_stream(scored: DataFrame, event_time: str = "event_time", window: str = "1 hour",
                       delay: str = "10 minutes", group: str = "prompt_id") -> DataFrame:
    # watermarks need an instant (TIMESTAMP); NTZ event times are read as UTC
    if dict(scored.dtypes)[event_time] == "timestamp_ntz":
        scored = scored.withColumn(event_time, ntz_to_instant(F.col(event_time)))
    w = scored.withWatermark(event_time, delay)
    return (w.groupBy(F.window(event_time, window), group)
            .agg(F.avg("reward").alias("mean_reward"), F.stddev_pop("reward").alias("std_reward"),
                 F.count(F.lit(1)).alias("n")))


def run_available(stream_df: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process everything available now into a parquet table (append mode) and
    return the table; the driver holds no rows.  A later call with the same
    folders goes on where this one ended."""
    q = (stream_df.writeStream.format("parquet").outputMode("append").option("path", out)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return stream_df.sparkSession.read.schema(stream_df.schema).parquet(out)
