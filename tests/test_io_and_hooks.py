"""File sources, sinks, build-once, hooks and guards (need files or raise)."""
import json
import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright import constants as K
from scorewright.operators import records, registry, search
from scorewright.sources import files, sinks

SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in K.PROJECTED_FIELDS])


@pytest.fixture()
def raw_dir():
    d = tempfile.mkdtemp(prefix="sw-raw-")
    for i in range(6):
        with open(os.path.join(d, f"rec_{i:02d}.json"), "w", encoding="utf-8") as f:
            json.dump({"publication_number": f"US{i}", "title": f"T{i}", "extra": 1}, f)
    with open(os.path.join(d, "rec_06.json"), "wb") as f:
        f.write('{"publication_number": "US6", "title": "caf\xe9"}'.encode("latin-1"))
    with open(os.path.join(d, "rec_07.json"), "w") as f:
        f.write('{"publication_number": "US7",}')
    with open(os.path.join(d, "rec_08.json"), "w") as f:
        f.write("[1, 2]")
    return d


def test_raw_scan_decodes_and_quarantines(spark, raw_dir):
    recs, bad = files.read_raw_records(spark, raw_dir, SCHEMA)
    got = {r["publication_number"]: r["title"] for r in recs.collect()}
    assert got["US6"] == "café" and got["US0"] == "T0" and len(got) == 7
    reasons = {os.path.basename(r["path"]): r["reason"] for r in bad.collect()}
    assert reasons == {"rec_07.json": "invalid JSON", "rec_08.json": "JSON value is not an object"}


def test_raw_scan_limit_before_read(spark, raw_dir):
    recs, _ = files.read_raw_records(spark, raw_dir, SCHEMA, limit=3)
    assert sorted(r["publication_number"] for r in recs.collect()) == ["US0", "US1", "US2"]


def test_split_listing_and_label_load(spark):
    base = tempfile.mkdtemp(prefix="sw-split-")
    os.makedirs(f"{base}/pdfs"), os.makedirs(f"{base}/labels")
    for s in ("patent_a", "patent_b"):
        open(f"{base}/pdfs/{s}.pdf", "wb").write(b"%PDF")
    for s in ("patent_b", "patent_c"):
        open(f"{base}/labels/{s}.json", "w").write(json.dumps({"title": s}))
    pdfs, labels = files.split_listing(spark, f"{base}/pdfs", f"{base}/labels")
    pairs = records.pair_by_stem(pdfs, labels).collect()
    assert [r["patent_id"] for r in pairs] == ["patent_b"]
    contents = files.read_label_contents(spark, f"{base}/labels")
    rows, missing = records.attach_labels(records.pair_by_stem(pdfs, labels)
                                          .withColumn("gold_json_path", F.concat(F.lit("file:"), "gold_json_path")), contents)
    assert rows.count() + missing.count() == 1


def test_manifest_sink_and_build_once(spark):
    path = tempfile.mkdtemp(prefix="sw-man-") + "/m"
    df = spark.createDataFrame([("p1", "a.pdf", "a.json", "t", "train"), ("p2", "b.pdf", "b.json", "u", "val")],
                               files.MANIFEST_SCHEMA)
    sinks.write_manifests(df, path)
    back = files.read_manifest(spark, path)
    assert back.filter(F.col("split") == "val").select("patent_id").first()[0] == "p2"
    calls = []

    def build():
        calls.append(1)
        return df
    p2 = tempfile.mkdtemp(prefix="sw-once-") + "/t"
    sinks.build_once(spark, p2, build)
    sinks.build_once(spark, p2, build)
    assert len(calls) == 1


def test_require_columns(spark):
    df = spark.createDataFrame([("a",)], "patent_id string")
    with pytest.raises(ValueError):
        records.require_columns(df, "text")


def test_search_guards(spark):
    req = spark.createDataFrame(
        [(1, "x", [], 5), (2, "x", ["!!"], 5), (3, "x", ["ok"], 11), (4, "x", ["ok"], 10)],
        "request_id int, inbox string, keywords array<string>, max_results int")
    valid, rejected = search.validate_requests(req)
    assert [r["request_id"] for r in valid.collect()] == [4]
    assert {r["request_id"]: r["reject_reason"] for r in rejected.collect()} == {
        1: "no keywords", 2: "keyword without searchable token", 3: "max_results must be <= 10"}


def test_reward_registry_and_python_adapter(spark):
    df = spark.createDataFrame([("p", "<guess>about</guess>", "about"), ("p", "nope", "about")],
                               "prompt string, completion string, answer string")

    def length_reward(prompts, completions, answer):
        return [float(len(c) > 5) for c in completions]

    registry.register_reward("long", registry.python_reward(length_reward, ("prompt", "completion", "answer")),
                             ("prompt", "completion", "answer"))
    out = registry.score(df, ["guess_reward", "long"], weights={"long": 2.0}).collect()
    assert [r["reward"] for r in out] == [1.1 + 2.0, 0.0]


def test_map_batches_and_token_counter(spark):
    df = spark.createDataFrame([("a b c",), ("d",)], "text string")
    out = registry.map_batches(df, lambda p: p.assign(n=p["text"].str.len()), "text string, n long").collect()
    assert sorted(r["n"] for r in out) == [1, 5]
    count = registry.token_counter(lambda: (lambda s: s.split()))
    assert sorted(r[0] for r in df.select(count("text")).collect()) == [1, 3]


def test_extract_hook_with_fallback(spark):
    d = tempfile.mkdtemp(prefix="sw-ext-")
    open(f"{d}/a.txt", "wb").write("héllo".encode("utf-8"))
    open(f"{d}/b.txt", "wb").write(b"\xff\xfe")
    fl = spark.read.format("binaryFile").load(d)
    out = files.extract_text(fl, lambda: (lambda b: b.decode("utf-8")), lambda: (lambda b: b.decode("latin-1")))
    got = {os.path.basename(r["path"]): r["text"] for r in out.collect()}
    assert got == {"a.txt": "héllo", "b.txt": "ÿþ"}


def test_label_sink_and_head_limit_rules(spark):
    from scorewright.operators import sampling
    path = tempfile.mkdtemp(prefix="sw-lab-") + "/l"
    df = spark.createDataFrame([("patent_US1A1", '{"title":"a"}'), ("patent_7", '{"title":"b"}')], "file_stem string, json string")
    sinks.write_label_records(df, path)
    assert sorted(r["file_stem"] for r in spark.read.json(path).collect()) == ["patent_7", "patent_US1A1"]
    ids = spark.range(5).withColumnRenamed("id", "k")
    assert sampling.head_limit(ids, ["k"], 0).count() == 5          # 'if limit:' keeps all on 0
    assert sampling.head_limit(ids, ["k"], 0, falsy_means_all=False).count() == 0   # slice form
    assert sampling.head_limit(ids, ["k"], None, falsy_means_all=False).count() == 5
    assert [r["k"] for r in sampling.head_limit(ids, ["k"], 2).collect()] == [0, 1]


def test_label_contents_fall_back_to_latin_1(spark):
    base = tempfile.mkdtemp(prefix="sw-lab-")
    for name, data in (("a", '{"t": "é"}'.encode()), ("b", '{"t": "é"}'.encode("latin-1"))):
        with open(f"{base}/{name}.json", "wb") as f:
            f.write(data)
    got = {r.path.rsplit("/", 1)[1]: r.content for r in files.read_label_contents(spark, base).collect()}
    assert got == {"a.json": '{"t": "é"}', "b.json": '{"t": "é"}'}


def test_every_prompt_is_scored_or_listed(spark):
    from scorewright.operators import batch
    prompts = spark.createDataFrame([(1, ["a"]), (2, []), (3, None), (4, ["b", "c"]), (None, ["d"])], "prompt_id long, completions array<string>")
    gold = spark.createDataFrame([(1, "x"), (2, "x"), (5, "x")], "prompt_id long, answer string")
    left = {r.prompt_id: r.reason for r in batch.unscored(prompts, gold).collect()}
    assert left == {2: "no completions", 3: "no gold", 4: "no gold", 5: "no prompt", None: "no gold"}
    scored = {r.prompt_id for r in batch.score_batch(prompts, gold, lambda df: df).collect()}
    assert scored == {1}


def test_row_files_hold_one_row_each_and_no_task_makes_them_twice(spark, tmp_path):
    rows = [("a\nb",), ("é",), ("",), (None,)] + [(f"x{i}",) for i in range(40)]
    path = sinks.write_row_files(spark.createDataFrame(rows, "value string").repartition(3), str(tmp_path / "rows"), folder_files=4)
    made = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names]
    assert sorted(open(f, "rb").read() for f in made) == sorted((v or "").encode() + b"\n" for v, in rows)
    assert all(len(names) <= 4 for _, _, names in os.walk(path)) and len({os.path.basename(f) for f in made}) == len(rows)
    listed = files.list_files(spark, path, "part-*")
    assert {r.path.split(":", 1)[1] for r in listed.collect()} == set(made)
    empty = sinks.write_row_files(spark.createDataFrame([], "value string"), str(tmp_path / "none"))
    assert files.list_files(spark, empty).count() == 0


def test_many_small_files_take_few_tasks_and_are_parsed_once(spark, raw_dir, monkeypatch):
    monkeypatch.setattr(files, "TASK_SPLITS", 2)
    for i in range(1500):
        with open(os.path.join(raw_dir, f"more_{i:04d}.json"), "w") as f:
            f.write("[1]" if i % 2 else "{}")
    splits = spark.read.format("binaryFile").load(raw_dir).rdd.getNumPartitions()
    recs, bad = files.read_raw_records(spark, raw_dir, SCHEMA)
    limit = max(4 * spark.sparkContext.defaultParallelism, -(-splits // 2))
    assert splits > limit >= max(d.rdd.getNumPartitions() for d in (recs, bad, files.list_files(spark, raw_dir), files.read_label_contents(spark, raw_dir)))
    plan = bad._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and recs.count() + bad.count() == 1509
