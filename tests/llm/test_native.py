"""Operators 3 and 10 against brute force."""
import hashlib
import random
import re

from scorewright.llm import queries as Q
from scorewright.llm import rules, winnow

from .helpers import odd_texts, prose, table

GAP = re.compile(r"[\x20\x09-\x0D]+")


def brute_measure(text):
    t = text or ""
    words = [w for w in GAP.split(t) if w]
    lines = [x for x in t.split("\n") if GAP.sub("", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 3000 else \
        {i + k for c in [__import__("collections").Counter(grams)] for i, g in enumerate(grams) if c[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_rules_of_odd_rows(spark):
    rng = random.Random(3)
    rows = odd_texts() + [(100 + i, prose(rng, rng.randint(0, 90), 6)) for i in range(60)] + [(200, "a#b$ |x| *\r\nc\x0bd"), (201, "a b c a b c"), (202, "a b c")]
    got = sorted(map(tuple, rules.quality_rules(table(spark, rows)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()), key=repr)
    want = []
    for i, t in rows:
        n, chars, sym, dup, rep = brute_measure(t)
        lines = len([x for x in (t or "").split("\n") if GAP.sub("", x)])
        base = n < 50 or 100 * rep > 50 * n
        bad = 100 * sym > 50 * n or 100 * dup > 30 * lines or chars < 2 * n or chars > 25 * n
        want.append((i, n, chars, sym, dup, rep, base, not base and not bad))
    assert got == sorted(want, key=repr)
    assert rules.quality_rules(table(spark, [])).collect() == []


def test_policies_and_ablations_use_the_stored_bits(spark):
    book = rules.ledger(table(spark, odd_texts())).cache()
    rows = book.collect()
    for name, versions in rules.POLICIES.items():
        for version, own in versions.items():
            mask = sum(rules.bit(r) for r in own)
            kept = rules.apply_policy(book, name, version).filter("kept").count()
            assert kept == sum(r.fails & mask == 0 for r in rows)
            for a in rules.ablations(book, name, version).collect():
                assert a.n_failed == sum(bool(r.fails & rules.bit(a.rule)) for r in rows)
                assert a.n_only == sum(r.fails & mask == rules.bit(a.rule) for r in rows)
    empty = rules.ablations(rules.ledger(table(spark, [])), "prose", 2).collect()
    assert all(a.n_failed == a.n_only == 0 for a in empty) and len(empty) == 6


def test_native_plans_have_no_python(spark):
    sf = "/root/testdata/sf0.001"
    for q in (Q.op3_quality_rules, Q.op10_winnowing):
        plan = q(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_whole_tables_match_the_sql(spark, duck):
    for name, sql in Q.SQL.items():
        got = Q.QUERIES[name](spark, "/root/testdata/sf0.001")
        cols = sorted(got.columns)
        want = duck.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
        assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute_hits(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    found |= own
                    hit |= set(range(k, k + n))
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), ids, bool(hit)))
    return sorted(out, key=repr)


def test_winnowing_finds_every_window(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.choice([1, 2, 4, 5, 9, 10, 11, 14, 30]), 40)) for i in range(30)]
    items += [(40, None), (41, ""), (42, "?!"), (43, items[8][1]), (44, "Same Words É here"), (45, "w1")]
    docs = []
    for i in range(150):
        parts = [prose(rng, rng.randint(0, 40), 400)]
        for _ in range(rng.randint(0, 3)):
            own = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, len(own) // 2)
            parts += [" ".join(own[a : a + rng.randint(1, 20)]), prose(rng, rng.randint(0, 5), 400)]
        docs.append((i, rng.choice([" ", ", ", "\n--"]).join(parts).replace("w1", rng.choice(["w1", "W1"]))))
    docs += [(i if i is None else i + 1000, t) for i, t in odd_texts()] + [(3000, "SAME words, É here"), (3001, "same words é here"), (3002, "w " * 40 + (items[8][1] or ""))]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = winnow.decontaminate(table(spark, docs), b)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_hits(docs, items)
    clean = winnow.drop_contaminated(table(spark, docs), b)
    assert clean.columns == table(spark, docs).columns
    assert clean.count() == sum(not r[5] for r in brute_hits(docs, items))


def test_winnowing_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = winnow.decontaminate(table(spark, odd_texts()), none).collect()
    assert len(got) == len(odd_texts()) and not any(r.contaminated or r.n_hit or r.n_items for r in got)
    assert winnow.decontaminate(table(spark, []), none).collect() == []


def test_winnowing_of_periodic_and_long_texts(spark):
    items = [(1, "a b " * 6), (2, "z " * 12), (3, prose(random.Random(1), 200, 50))]
    docs = [(1, "z " * 5000), (2, "b " + "a b " * 300), (3, "q " * 3000 + items[2][1]), (4, "z " * 9)]
    got = winnow.decontaminate(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_hits(docs, items)


def test_fingerprints_are_the_least_of_each_run_without_a_slice_for_each_place(spark):
    rng = random.Random(21)
    rows = [(i, prose(rng, rng.randint(0, 40), 9)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = winnow.fingerprints(docs, ["doc_id"], "text", [])
    grams = docs.select("doc_id", winnow.hashes(docs["text"]).alias("h")).select("doc_id", winnow.packed(winnow.gram_hashes("h", winnow.GRAM)).alias("p"))
    want = {(r.doc_id, min(r.p[i : i + winnow.RUN])) for r in grams.collect() for i in range(len(r.p) - winnow.RUN + 1)}
    assert sorted((r.doc_id, r.key, r.pos) for r in got.collect()) == sorted((d, p >> winnow.POS_BITS, p & ((1 << winnow.POS_BITS) - 1)) for d, p in want)
    assert "array_min" not in got._jdf.queryExecution().optimizedPlan().toString()
