"""Clashing names, shared ids and very long texts in the filtering stages."""
import random

from pyspark.sql import functions as F

from scorewright.llm import jaccard, rules, sieve, winnow

from .helpers import odd_texts, prose

CLASH = "doc_id long, text string, _d string, _h string, _gone string, _k0 string, _own string, _mark string, Least string, _th string, _t string"


def clashing(spark, texts):
    return spark.createDataFrame([(i, t, *(f"{c}{n}" for c in "dhgkomltx")) for n, (i, t) in enumerate(texts)], CLASH).repartition(3)


def test_without_keeps_all_other_rows(spark):
    df = clashing(spark, [(i if i % 9 else None, f"t{i % 40}") for i in range(300)])
    for some in ([], [(3, "t3"), (None, "t5"), (7, None), (11, "t0")], [(i, f"t{i % 40}") for i in range(300)]):
        keys = spark.createDataFrame(some, "a long, b string")
        got = sieve.without(df, keys, [F.col("doc_id"), F.col("text")])
        assert got.columns == df.columns
        want = [tuple(r) for r in df.collect() if (r.doc_id, r.text) not in set(some)]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_stages_take_clashing_names(spark):
    rng = random.Random(2)
    passage = prose(rng, 30)
    texts = [(i, prose(rng, 60)) for i in range(20)] + [(30, prose(rng, 20) + " " + passage), *[(i if i is None else i + 100, t) for i, t in odd_texts()]]
    df = clashing(spark, texts + [(50, texts[3][1])])
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    clean = winnow.drop_contaminated(df, items)
    assert clean.columns == df.columns and {r.doc_id for r in df.collect()} - {r.doc_id for r in clean.collect()} == {30}
    kept = jaccard.keep_one(df, 5, 80)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 50 not in ids and 3 in ids and 106 not in ids and ids.count(105) == 1
    for stage in (winnow.drop_contaminated(df.limit(0), items), jaccard.keep_one(df.limit(0), 5, 80)):
        assert stage.collect() == []


def test_rows_of_one_id_with_other_texts_all_stay(spark):
    """No row is lost because another one has its id; copies still go."""
    rng = random.Random(3)
    a, b, c = (prose(rng, 60, 5000) for _ in range(3))
    df = clashing(spark, [(1, a), (1, b), (1, b), (2, c), (3, a), (4, b + " one"), (5, ""), (5, None), (None, a), (-7, "few words")])
    kept = sorted(((r.doc_id, r.text) for r in jaccard.keep_one(df, 5, 80).collect()), key=repr)
    assert kept == sorted([(1, a), (1, b), (2, c), (5, ""), (5, None), (None, a), (-7, "few words")], key=repr)
    once = [sorted(map(tuple, jaccard.keep_one(df.repartition(n), 5, 80).collect()), key=repr) for n in (1, 5)]
    assert once[0] == once[1]


def test_a_text_of_ten_megabytes(spark):
    """Whole, not cut: what decides stands at its end."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(1_300_000)]
    passage = prose(rng, 30)
    text = " ".join(words)
    assert len(text) > 10_000_000 - 1_000_000
    df = clashing(spark, [(1, text + " " + passage), (2, "short one"), (3, text + " " + passage)])
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert [r.doc_id for r in winnow.drop_contaminated(df, items).collect()] == [2]
    assert sorted(r.doc_id for r in jaccard.keep_one(df, 5, 80).collect()) == [1, 2]
    assert sorted((r.doc_id, r.n_words) for r in rules.quality_rules(df).select("doc_id", "n_words").collect()) == [(1, 1_300_030), (2, 2), (3, 1_300_030)]
