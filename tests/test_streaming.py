"""Streaming: late completions beyond the watermark are dropped in append
mode; finished windows are emitted once."""
import tempfile
import time

from pyspark.sql import functions as F

from scorewright.streaming import scores


def test_late_rows_dropped_after_watermark(spark):
    base = tempfile.mkdtemp(prefix="sw-late-")
    schema = "prompt_id long, gen_idx int, answer string, completion string, event_time timestamp_ntz"
    ok = "<end_working_out><SOLUTION>5</SOLUTION>"
    rows1 = [(1, i, "5", ok, "2001-01-01 00:10:00") for i in range(4)]
    rows2 = [(2, 0, "5", ok, "2001-01-01 03:00:00")]   # moves the watermark to 02:50
    rows3 = [(3, 0, "5", ok, "2001-01-01 06:00:00")]   # window of prompt 1 is emitted and evicted
    rows4 = [(1, 9, "5", "late and wrong", "2001-01-01 00:20:00")]
    for rows in (rows1, rows2, rows3, rows4):
        (spark.createDataFrame(rows, "prompt_id long, gen_idx int, answer string, completion string, t string")
         .select("prompt_id", "gen_idx", "answer", "completion", F.col("t").cast("timestamp_ntz").alias("event_time"))
         .coalesce(1).write.mode("append").parquet(f"{base}/in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    stats = scores.group_stats_stream(scores.score_stream(stream), window="1 hour", delay="10 minutes")
    out = scores.run_available(stats, f"{base}/out", f"{base}/ckpt")
    got = {}
    for r in out.collect():
        got.setdefault(r["prompt_id"], []).append(r["n"])
    assert 4 in got[1] and 5 not in got[1]   # the emitted window is final; the late row never joins it
    assert got[2] == [1]
    assert 3 not in got                      # the last window is still open


def test_stream_scores_equal_batch(spark):
    from scorewright.operators import math_rewards
    base = tempfile.mkdtemp(prefix="sw-sc-")
    df = spark.createDataFrame([(1, "<end_working_out><SOLUTION>3</SOLUTION>", "3"), (2, "x", "1")],
                               "id long, completion string, answer string")
    df.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{base}/in")
    got = scores.run_available(scores.score_stream(stream), f"{base}/out", f"{base}/ckpt")
    want = math_rewards.score_math(df)
    assert sorted(tuple(r) for r in got.select("id", "reward").collect()) == \
        sorted(tuple(r) for r in want.select("id", "reward").collect())


def test_window_stats_independent_of_session_zone(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    q = E.queries()["stream_group_stats"]
    a = sorted(tuple(r) for r in q(spark, SF_SMALL).collect())
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        b = sorted(tuple(r) for r in q(spark, SF_SMALL).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert a == b and a[0][1].endswith(":00:00")


def test_change_feed_keeps_the_last_change(spark):
    """Changes of one message inside one batch and over batches that come in
    the wrong order; a retried batch changes nothing."""
    from scorewright.streaming import index
    base = tempfile.mkdtemp(prefix="sw-idx-")
    schema = "op string, message_id string, subject string, body string, seq long"
    late = [("update", "m3", "third", "new", 9), ("delete", "m4", None, None, 8)]
    one = [("insert", "m1", "Hello", "alpha", 0), ("delete", "m1", None, None, 1),
           ("insert", "m2", "Hello", "beta", 2), ("update", "m2", "Again", "gamma delta", 3),
           ("insert", "m3", "old", "old", 4), ("insert", "m4", "gone", "gone", 5)]
    apply = index.apply_changes(base)
    apply(spark.createDataFrame(late, schema), 0)
    apply(spark.createDataFrame(one, schema), 1)

    def now():
        return sorted(tuple(r) for r in index.live_postings(spark, base).select("message_id", "field", "pos", "term").collect())
    want = [("m2", "body", 0, "gamma"), ("m2", "body", 1, "delta"), ("m2", "subject", 0, "again"),
            ("m3", "body", 0, "new"), ("m3", "subject", 0, "third")]
    assert now() == want
    apply(spark.createDataFrame(one, schema), 1)
    assert now() == want


def test_reads_of_the_index_do_not_grow_with_the_changes(spark):
    """The same 40 messages change in every batch: what a read goes through
    stays near 40 rows, merged or not; deltas wait for the share."""
    from scorewright.streaming import index
    schema = "op string, message_id string, subject string, body string, seq long"
    for share in (0.25, 3.0):
        base = tempfile.mkdtemp(prefix="sw-idx-")
        assert index.live_postings(spark, base).collect() == []
        apply, waited = index.apply_changes(base, share), 0
        for batch in range(6):
            rows = [("delete" if (i + batch) % 9 == 0 else "update", f"m{i}", f"s{batch}", f"word{i} at {batch}", 100 * batch + i) for i in range(40)]
            apply(spark.createDataFrame(rows + rows[:5], schema), batch)
            now = index.read_manifest(spark, base)
            waited = max(waited, len(now.deltas))
            assert now.base_rows == 40 and now.delta_rows <= share * 40
            got = {r.message_id for r in index.live_postings(spark, base).filter(f"term = '{batch}'").collect()}
            assert got == {f"m{i}" for i in range(40) if (i + batch) % 9}
            assert index.live_postings(spark, base).filter(f"term = '{batch - 1}'").count() == 0
        assert waited == (0 if share < 1 else 3)


def test_a_retried_batch_makes_the_same_index(spark):
    """A batch that ran, or broke off before its manifest, is run again."""
    from scorewright.streaming import index
    base = tempfile.mkdtemp(prefix="sw-idx-")
    schema = "op string, message_id string, subject string, body string, seq long"
    apply = index.apply_changes(base, 0.5)
    batches = [[("insert", f"m{i}", "one", "two words", 10 * b + i) for i in range(6 - b, 8 - b)] for b in range(5)]
    for b, rows in enumerate(batches):
        apply(spark.createDataFrame(rows, schema), b)
    want = sorted(map(tuple, index.live_postings(spark, base).collect()))
    for b in (4, 3, 4):
        apply(spark.createDataFrame(batches[b], schema), b)
    assert sorted(map(tuple, index.live_postings(spark, base).collect())) == want
    spark.range(1).write.parquet(f"{base}/delta/9")  # a batch without a manifest is no part of the index
    assert sorted(map(tuple, index.live_postings(spark, base).collect())) == want


def test_changes_are_dealt_out_once_and_the_index_holds_no_token_rows(spark):
    """one exchange picks the last changes; a stored row holds its tokens as
    plain text, the first batch is the base, and merges give every posting."""
    from scorewright.operators import search
    from scorewright.streaming import index
    schema = "op string, message_id string, subject string, body string, seq long"
    rows = [("insert", f"m{i}", "Été  x" if i % 2 else None, "" if i % 5 == 0 else f"a{i}, b's\nc a{i}", i % 3) for i in range(30)]
    rows += [("update", f"m{i}", "new", f"z{i}", 5) for i in range(0, 30, 4)] + [("insert", None, "no", "id", 1), ("insert", "m1", "no", "seq", None)]
    changes = spark.createDataFrame(rows, schema).repartition(3)
    plan = index.last_changes(changes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    base = tempfile.mkdtemp(prefix="sw-idx-")
    apply = index.apply_changes(base)
    for b in range(3):
        apply(changes.filter(F.pmod(F.hash("message_id", "seq"), F.lit(3)) == b), b)
    held = spark.read.parquet(f"{base}/base/{index.read_manifest(spark, base).base}")
    assert {t for c, t in held.dtypes if c not in ("message_id", "seq")} == {"string"}
    last = spark.createDataFrame([r for r in rows if r[1] and r[4] is not None and not (r[4] < 5 and int(r[1][1:]) % 4 == 0)], schema)
    cols = ["message_id", "term", "field", "pos"]
    want = sorted(map(tuple, search.postings(last).select(*cols).collect()))
    assert sorted(map(tuple, index.live_postings(spark, base).select(*cols).collect())) == want
