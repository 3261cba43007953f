"""Plan-shape checks that guard the scale design (no data assertions)."""
from pyspark.sql import functions as F

from conftest import SF_SMALL
from scorewright.operators import prompts, search
from scorewright.plans import catalog
from scorewright.plans import fixtures as fx
from scorewright.plans.store import corpus_store


def test_search_top_k_is_limited_before_exchange_and_buckets_pruned(spark):
    emails, rec, post, stats, mail, _ = corpus_store(spark, SF_SMALL)
    res = search.search(mail, rec, catalog.search_requests(spark, SF_SMALL), post, stats)
    p = res._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p
    assert "dynamicpruning" in p.lower()


def test_math_scan_reads_only_needed_columns(spark):
    df = fx.math_rows(spark, SF_SMALL).select("prompt_id", "completion")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "o_orderstatus" not in p and "o_totalprice" not in p


def test_conversation_rendering_collects_partially(spark):
    df = prompts.conversations_to_messages(fx.chat(spark, SF_SMALL))
    assert "partial_collect_list" in df._jdf.queryExecution().executedPlan().toString()


def test_quantile_cut_exact_and_sketch(spark):
    df = spark.range(0, 8).withColumnRenamed("id", "n")
    kept = [r["n"] for r in prompts.quantile_length_filter(df, "n", 0.9).collect()]
    assert max(kept) == 6 and len(kept) == 7          # the cut is 6.3, truncated
    assert prompts.quantile_length_filter(df, "n", 0.9, exact=False).count() in (7, 8)
    assert prompts.quantile_length_filter(df.limit(0), "n").count() == 0


def test_scan_keeps_its_splits_unless_asked(spark):
    from scorewright.sources.tables import read_table
    plan = read_table(spark, SF_SMALL, "documents", ["doc_id", "text"], key="doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_search_reads_no_message_text(spark):
    emails, rec, post, stats, mail, _ = corpus_store(spark, SF_SMALL)
    res = search.search(mail, rec, catalog.search_requests(spark, SF_SMALL), post, stats)
    plan = res._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "corpus-" in line]
    assert scans and not any("body" in line or "subject" in line for line in scans)


def test_dedup_sorts_no_text(spark):
    from scorewright.operators import corpus
    plan = corpus.dedup_emails(fx.email_source(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def _files_read(plan):
    """Files read by each parquet scan of an executed plan, by table folder."""
    name, found = plan.getClass().getSimpleName(), []
    if name == "AdaptiveSparkPlanExec":
        return _files_read(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _files_read(plan.plan())
    if name == "FileSourceScanExec":
        metric = plan.metrics().get("numFiles")
        found.append((plan.relation().location().rootPaths().head().getName(), metric.get().value()))
    children = plan.children()
    return found + [x for i in range(children.size()) for x in _files_read(children.apply(i))]


def test_lookup_reads_only_the_wanted_folders(spark):
    from scorewright.operators import corpus
    store = corpus_store(spark, SF_SMALL)
    ids = spark.createDataFrame([("m3",), ("m3",), ("m11",), ("nobody",)], "message_id string")
    out = corpus.read_emails(store.emails, store.recipients_by_id, ids)
    assert {r.message_id for r in out.collect()} == {"m3", "m11"}
    slots = {r[0] for r in ids.select(corpus.id_slot("message_id")).collect()}
    files = dict(_files_read(out._jdf.queryExecution().executedPlan()))
    for name, table in (("emails", store.emails), ("recipients_by_id", store.recipients_by_id)):
        own = [f for f in table.inputFiles() if any(f"slot={s}/" in f for s in slots)]
        assert files[name] == len(own) < len(table.inputFiles())


def test_inbox_is_two_semi_joins(spark):
    emails, rec = catalog._tables(spark, SF_SMALL)
    addresses = fx.scenarios(spark, SF_SMALL).selectExpr("inbox_address AS address")
    plan = search.parties(emails, rec, addresses)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2
    none = spark.createDataFrame([(None,)], "address string")
    assert search.parties(emails, rec, none).count() == 0


def test_changed_build_code_makes_a_new_store(spark, monkeypatch):
    from scorewright.operators import corpus
    from scorewright.plans import store
    before = store.build_key(spark, SF_SMALL)
    store._KEYS.clear()
    assert store.build_key(spark, SF_SMALL) == before  # other expression ids, same plans
    store._KEYS.clear()
    real = corpus.clean_addresses
    monkeypatch.setattr(corpus, "clean_addresses", lambda df: real(df).withColumn("subject", F.trim("subject")))
    assert store.build_key(spark, SF_SMALL) != before
    store._KEYS.clear()
