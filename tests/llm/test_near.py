"""Operators 4 and 7 against brute force."""
import collections
import hashlib
import random
import re

import numpy as np
import pytest

from scorewright.llm import graph, jaccard, repeats

from .helpers import odd_texts, prose, table

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            (i, _), (j, _) = rows[a], rows[b]
            if i is not None and j is not None and sets[a] and sets[b] and min(map(len, (sets[a], sets[b]))) * 100 >= percent * max(map(len, (sets[a], sets[b]))):
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = top(i), top(j)
                    up[max(x, y)] = min(x, y)
    out = []
    for (i, _), s in zip(rows, sets):
        own = i
        if i is None:
            same = [top(j) for (j, _), other in zip(rows, sets) if j is not None and s and other == s]
            own = min(same, default=None)
        out.append((i, len(s), own if i is None else top(i)))
    return sorted(out, key=repr)


def near_rows(seed, n=110):
    rng = random.Random(seed)
    base = prose(rng, 110, 400).split()
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
        rows.append((i, " ".join(w)))
    for i in range(n, 2 * n):
        w = prose(rng, rng.randint(1, 50), 400).split()
        rows.append((i, " ".join(w)))
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = "x"
            rows.append((i + 1000, " ".join(w)))
        if rng.random() < 0.3:
            rows.append((i + 2000, " ".join(w[:-1])))
    rows += [(5000 + i, " ".join(f"w{rng.randrange(3)}" for _ in range(rng.randint(1, 30)))) for i in range(40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k, percent, limit, pairs", [(3, 90, 10**7, 12), (5, 80, 10**7, 2), (3, 90, 3000, 12)])
def test_components_match_brute_force(spark, monkeypatch, k, percent, limit, pairs):
    """The small limits send the large group through pivots and blocks, and most
    regions through the way of the large ones."""
    monkeypatch.setattr(jaccard, "REGION_PAIRS", pairs)
    rows = near_rows(k + percent)
    got = jaccard.jaccard_components(table(spark, rows), k, percent, limit=limit)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(rows, k, percent)


@pytest.mark.parametrize("limit", [10**6, 1500])
def test_core_of_a_large_group_keeps_its_links_to_lower_ids(spark, limit):
    """Every document beside the core has a lower id than the whole core and
    links to one member of it, not to the pivot; in one block and in several."""
    rng = random.Random(12)
    base = prose(rng, 110, 400).split()
    rows = [(1000, " ".join(base))]
    for i in range(20):
        w = list(base)
        w[3 * i + 5] = f"c{i}"
        rows.append((1001 + i, " ".join(w)))
        w[(3 * i + 50) % 100] = f"n{i}"
        rows.append((1 + i, " ".join(w)))
    want = brute_components(rows, 3, 90)
    assert {c for _, _, c in want} == {1}
    members = spark.createDataFrame([(0, i, t, len(shingles(t, 3))) for i, t in rows], "root long, doc_id long, text string, n_shingles long")
    links = jaccard._join_blocks(members.filter("doc_id >= 1000"), members.filter("doc_id < 1000"), 3, 90, limit).collect()
    up = {i: 1000 if i >= 1000 else i for i, _ in rows}  # the core is connected through its pivot
    for x, y in links:
        up = {i: min(up[x], up[y]) if u in (up[x], up[y]) else u for i, u in up.items()}
    assert sorted(((i, n, up[i]) for i, n, _ in want), key=repr) == want


def test_components_of_odd_rows(spark):
    rows = odd_texts() + [(30, "A b"), (31, "a B"), (32, "a b c"), (33, "a  b\tc\n")]
    got = jaccard.jaccard_components(table(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_components(rows, 3, 90)
    assert jaccard.jaccard_components(table(spark, [])).collect() == []


def test_rows_that_share_an_id_are_one_document(spark):
    rng = random.Random(1)
    a, b = prose(rng, 50), prose(rng, 50)
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.jaccard_components(table(spark, [(5, a), (5, b), (3, a), (9, b), (8, "z")])).collect()}
    assert set(got.values()) == {3, 8}


def test_keep_one_keeps_the_least_of_each_group(spark):
    rows = odd_texts()
    kept = jaccard.keep_one(table(spark, rows), 3, 90)
    assert kept.columns == table(spark, rows).columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    first = {c for _, _, c in brute_components(rows, 3, 90)}
    assert ids == sorted(x for x in first if x is not None)


def test_group_join_uses_regions_and_is_exact():
    """In one group: many clusters, region division and skipped pairs."""
    rng = random.Random(9)
    rows = []
    for c in range(25):
        base = prose(rng, 60, 60).split()
        for _ in range(rng.randint(1, 20)):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(50)}"
            rows.append((len(rows), " ".join(w)))
    sets = [jaccard.shingle_set(t.encode(), 3) for _, t in rows]
    got = jaccard.group_labels([i for i, _ in rows], sets, 90)
    assert got.tolist() == [c for _, _, c in sorted(brute_components(rows, 3, 90), key=lambda r: r[0])]


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_region(percent):
    rng, parts = np.random.default_rng(5), jaccard.Parts(percent)
    for n in [*range(1, 60), 100, 333, 1000]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            out = rng.integers(0, max(1, n // 6) + 1)
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[out:]], rng.integers(0, 2**63, rng.integers(0, max(1, n // 6) + 1), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= percent * (len(a) + len(b) - both) and len(a) + len(b) - both != both:
                (x, need), (y, other) = parts.keys(a), parts.keys(b)
                assert np.intersect1d(x, y).size >= max(1, need, other)


@pytest.mark.parametrize("k", [1, 3, 5])
def test_sets_of_many_texts_at_once_match_plain_ones(monkeypatch, k):
    rng = random.Random(k)
    rows = [bytes(rng.choices(b"aAbB \t\n\x0b\x00\x1c\xc3\xa9xyzw", k=rng.randint(0, 300))) for _ in range(80)]
    rows += [b"", b" ", b"x" * 3000, b"y" * 256 + b" " + b"y" * 257, b"abcdefgh abcdefgh\x00 abcdefghi", b"Ab " * 300]
    off = np.cumsum([0, *map(len, rows)])
    monkeypatch.setattr(jaccard, "PIECE_BYTES", 500)
    s, n = jaccard.shingle_sets(np.frombuffer(b"".join(rows), np.uint8), off, k)
    words = [t.lower().split() for t in rows]
    assert n.tolist() == [len({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else ()) for w in words]
    for t, x in zip(rows, np.split(s, np.cumsum(n)[:-1])):
        assert (jaccard.shingle_set(t, k) == x).all() and (x[1:] > x[:-1]).all()
    # the sets of all texts share what plain ones share
    seen = collections.Counter(g for w in words for g in ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else ()))
    assert sorted(np.unique(s, return_counts=True)[1]) == sorted(seen.values())


def test_region_rows_travel_packed(spark):
    """A row for each bucket of a task, however many regions its documents have."""
    rng = random.Random(6)
    docs = table(spark, [(i, prose(rng, 200, 900)) for i in range(60)], parts=2).select("doc_id", "text")
    rows = jaccard._region_rows(docs, 5, 80)
    got = rows.collect()
    held = sum(len(r["keys"]) // 8 for r in got)
    assert held > 60 * 100 and len(got) <= 2 * jaccard.BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_large_regions_leave_a_full_bucket(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 20)
    monkeypatch.setattr(jaccard, "DEAL_ROWS", 50)
    rng = random.Random(4)
    base = prose(rng, 60, 400).split()
    rows = [(i, " ".join([*base[: i % 50], f"x{i}", *base[i % 50 + 1 :]])) for i in range(60)]
    docs = table(spark, rows).select("doc_id", "text")
    pairs = jaccard._region_pairs(jaccard._region_rows(docs, 5, 80)).collect()
    plain = collections.defaultdict(set)
    parts = jaccard.Parts(80)
    for i, t in rows:
        for key in parts.keys(jaccard.shingle_set(t.encode(), 5))[0].view(np.int64).tolist():
            plain[key].add(i)
    large = {(k, i) for k, ids in plain.items() if len(ids) > jaccard.REGION_PAIRS for i in ids}
    assert large and {(r.key, r.a) for r in pairs if r.b is None} == large
    want = collections.Counter((a, b) for ids in plain.values() if len(ids) <= jaccard.REGION_PAIRS for a in ids for b in ids if a < b)
    got = collections.Counter()
    for r in pairs:
        if r.b is not None:
            got[r.a, r.b] += r.n
    assert got == want


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200)] + [(301, 300), (300, 301)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200, 300: 300, 301: 300}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_repeats(rows, n=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(t[j : j + n] for _, t in raw for j in range(len(t) - n + 1))
    out = []
    for i, t in raw:
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - n + 1):
            if seen[t[j : j + n]] > 1:
                gone[j : j + n] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(t) else 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [20_000, 4])
def test_repeats_match_brute_force(spark, hot):
    rng = random.Random(3)

    def text(n):
        return " ".join("".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9))) for _ in range(n))
    shared = [text(60) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [text(rng.randint(0, 80)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            parts.insert(rng.randint(0, 3), s[a : a + rng.randint(100, 400)])
        rows.append((i, " ".join(parts)))
    rows += [(i if i is None else i + 500, t and t[:6000]) for i, t in odd_texts()]
    rows += [(900, "x" * 199), (901, "x" * 200), (902, "y" * 201), (903, "ab " * 700), (904, "Is " * 300 + text(50))]
    rng.shuffle(rows)
    got = repeats.remove_repeats(table(spark, rows), hot=hot)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_repeats(rows)


def test_members_of_a_name_meet_in_one_task(spark, monkeypatch):
    """Spark drops a repartition by name over a join by name, and may then split
    the join or read its shuffle locally: no join may stand below."""
    rng = random.Random(8)

    def text(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))
    lead, shared = text(240), [text(260) for _ in range(5)]
    rows = [(i, text(90) + rng.choice(shared) + text(90) + (lead if i % 2 else "")) for i in range(40)]
    plans, compare = [], repeats._compare

    def seen(rows):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return compare(rows)
    monkeypatch.setattr(repeats, "_compare", seen)
    got = repeats.remove_repeats(table(spark, rows), hot=12)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_repeats(rows)
    assert len(plans) == 1 and "hot" in plans[0] and "Join" not in plans[0]


def test_repeats_of_an_empty_table(spark):
    assert repeats.remove_repeats(table(spark, [])).collect() == []


def test_string_hashes_by_doubling():
    buf = np.frombuffer(bytes(random.Random(1).choices(range(256), k=700)), np.uint8)
    for n in (1, 2, 3, 32, 200):
        h = repeats.string_hashes(buf, n)
        assert len(h) == 700 - n + 1 and (repeats.string_hashes(buf[100:], n) == h[100:]).all()
    assert len(repeats.string_hashes(buf[:199], 200)) == 0
