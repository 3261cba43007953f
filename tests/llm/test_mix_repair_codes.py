"""Operators 11 to 13 against brute force."""
import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.llm import codes, mixing, repair
from scorewright.llm import queries as Q

from .helpers import odd_texts, prose, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- operator 11
def share(sizes, weights):
    """Targets by resharing the excess again and again, exactly."""
    total, got, open_ = sum(sizes), [Fraction(0)] * len(sizes), set(range(len(sizes)))
    rest = Fraction(total)
    while open_ and rest:
        parts = sum(weights[i] for i in open_)
        full = {i for i in open_ if rest * weights[i] / parts >= 3 * sizes[i]}
        if not full:
            for i in open_:
                got[i] = rest * weights[i] / parts
            break
        for i in full:
            got[i] = Fraction(3 * sizes[i])
            rest -= got[i]
        open_ -= full
    return got


def heap_seats(targets, room, seats):
    heap = [(-t, i) for i, t in enumerate(targets) if room[i]]
    got = [0] * len(targets)
    heapq.heapify(heap)
    while heap and sum(got) < seats:
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < room[i]:
            heapq.heappush(heap, (-(targets[i] / (2 * got[i] + 1)), i))
    return got


def mixed_docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "c") for r in rows], "doc_id long, text string, source string, key string, at long, taken string").repartition(3)


def random_rows(seed, n, sources, longest=60):
    rng = random.Random(seed)
    return [(i, prose(rng, rng.randint(0, longest)), rng.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("seed,n,sources,block", [(1, 200, ["a", "b", "c", "d", None], 8), (2, 120, ["big"] * 40 + [f"s{i}" for i in range(40)], 4), (3, 30, ["z", "é", "Z", ""], 64), (4, 12, ["a"], 5)])
def test_mix_against_a_heap_and_exact_shares(spark, seed, n, sources, block):
    rows = random_rows(seed, n, sources)
    rows += [(1, None, "a"), (None, "", "a"), (None, "w " * 700, sources[0]), (5, "same text here", sources[0]), (5, "same text here", sources[0])]
    out, pieces = mixing.mix_documents(mixed_docs(spark, rows), block=block, with_pieces=True)
    got, found = out.collect(), pieces.collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weights = [i % 3 + 1 for i in range(len(names))]
    targets = share([sizes[s] for s in names], weights)
    plan = mixing.mix_plan(mixing.document_sizes(mixed_docs(spark, rows)), block=block).orderBy("rank").collect()
    assert [p.source for p in plan] == names and [p.source_size for p in plan] == [sizes[s] for s in names]
    assert all(math.isclose(p.target, t, rel_tol=1e-12) for p, t in zip(plan, targets, strict=True))
    total = sum(sizes.values())
    count = (total + block // 2) // block
    for shard in range(8):
        want = heap_seats([p.target for p in plan], [3 * p.source_size // block for p in plan], count * (shard + 1) // 8)
        assert [p.seats[shard] for p in plan] == want
    assert sorted((r.doc_id, r.size) for r in got if r.doc_id) == sorted((i, len(WORD.findall(t or ""))) for i, t, _ in rows if i)
    assert all(0 <= r.taken <= 3 * r.size for r in got) and len(got) == len(rows)
    # the pieces fill each source's seats without gaps and lie inside their shards
    taken, by = defaultdict(list), {p.source: p for p in plan}
    for x in found:
        taken[x.source].append((x.place, x.n_words))
        upto = [s * block for s in by[x.source].seats]
        assert ([0, *upto][x.shard] <= x.place) and x.place + x.n_words <= upto[x.shard]
    for p in plan:
        at = 0
        for place, n_words in sorted(taken[p.source]):
            assert place == at
            at += n_words
        assert at == p.seats[-1] * block
    # each word is taken as often as the others, one lap more or less, and a piece lies in its row
    words = defaultdict(int)
    for x in found:
        for w in range(x.first_word, x.first_word + x.n_words):
            words[x.source, x.at, w] += 1
    for p in plan:
        of = [n for (s, *_), n in words.items() if s == p.source]
        laps = p.seats[-1] * block // p.source_size if p.source_size else 0
        assert all(n in (laps, laps + 1) for n in of) and (not laps or len(of) == p.source_size)


def test_mix_of_odd_tables(spark):
    rows = [(i, t, "s" if i and i % 2 else None) for i, t in odd_texts()]
    got = mixing.mix_documents(mixed_docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    assert mixing.mix_documents(mixed_docs(spark, rows).limit(0)).collect() == []
    empty = mixing.mix_documents(mixed_docs(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in empty] == [(0, 0, 0.0, 0)] * 2


def test_mix_agrees_with_itself_whatever_the_partitions(spark):
    rows = random_rows(7, 150, ["a", "b", "c"]) + [(3, "once more", "a")] * 2
    runs = [sorted(map(tuple, mixing.mix_documents(mixed_docs(spark, rows).repartition(k)).collect()), key=repr) for k in (1, 7)]
    assert runs[0] == runs[1]


# ---------------------------------------------------------------- operator 12
def brute_repair(rows):
    """(cost, audit, repaired) by trying all edits: the least (cost, letters)
    of every prefix and automaton state, as plain strings."""
    def nxt(state, initial):
        return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, initial))

    held = {(0, 0): (0, "", ())}
    todo = []

    def relax(key, value):
        if key not in held or value[:2] < held[key][:2]:
            held[key] = value
            heapq.heappush(todo, (value[0], value[1], key))

    todo.append((0, "", (0, 0)))
    while todo:
        cost, letters, key = heapq.heappop(todo)
        if held[key][:2] != (cost, letters):
            continue
        out, (i, state) = held[key][2], key
        for who in ("user", "assistant"):
            if (to := nxt(state, who[0])) is not None:
                relax((i, to), (cost + 2, letters + "I", (*out, (who, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            relax((i + 1, state), (cost + 3, letters + "D", out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (to := nxt(state, role[:1])) is not None:
                    relax((i + 1, to), (cost + more, letters + "K", (*out, (role, text))))
                for who in ("user", "assistant"):
                    if (to := nxt(state, who[0])) is not None:
                        relax((i + 1, to), (cost + 2 + more, letters + "R", (*out, (who, text))))
    return min((held[k] for k in ((len(rows), 0), (len(rows), 3)) if k in held), key=lambda x: x[:2])


def brute_audit(rows):
    """One conversation's (turn, role, text) rows in their order."""
    seen, faults, initials = set(), [], []
    for _, role, text in rows:
        solid = text.rstrip(" \t\n\x0b\f\r")
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
        initials.append(role[:1])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    cost, letters, out = brute_repair([(r, t, f) for (_, r, t), f in zip(rows, faults, strict=True)])
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, letters, sha


def brute_damage(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        own = convs[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own.extend([(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, own in convs.items()}


def talk(rng, n):
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None], ["Yes.", "no", "Why?", " ", "", None, "Fine!\n", "So. And", "x.\x85"]
    return [(rng.choice([None, *range(n + 3)]) if rng.random() < 0.2 else i, rng.choice(roles[: rng.choice([2, 4, 8])]), rng.choice(texts) if rng.random() < 0.4 else f"Line {i}.") for i in range(n)]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, nth long").repartition(3)


def test_repair_of_damaged_and_odd_conversations(spark):
    rng = random.Random(5)
    rows = [(c, *r) for c in range(150) for r in talk(rng, rng.randint(1, 14))] + [(None, *r) for r in talk(rng, 6)]
    rows += [(900, 1, "user", "Hi."), (900, 1, "user", "Hi."), (901, None, None, None), (902, 7, "user", "x" * 300_000)]
    got = repair.audit(repair.damaged(conversations(spark, rows)), present="present").collect()
    want = {c: brute_audit(own) for c, own in brute_damage(rows).items()}
    assert {r[0]: tuple(r[1:]) for r in got} == want and len(got) == len(want)
    assert repair.audit(repair.damaged(conversations(spark, rows[:1]).limit(0)), present="present").collect() == []


def test_op12_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = Q.op12_conversation_repair(spark, SF).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {c: brute_audit(own) for c, own in brute_damage(rows).items()}


def test_repaired_rows_follow_the_audit(spark):
    rng = random.Random(6)
    rows = [(c, *r) for c in range(40) for r in talk(rng, 9)]
    bad = repair.damaged(conversations(spark, rows))
    texts = defaultdict(list)
    for r in sorted(repair.repaired(bad, present="present").collect(), key=lambda r: (r.conv_id, r.place)):
        texts[r.conv_id].append(r)
    for a in repair.audit(bad, present="present").collect():
        own = texts[a.conv_id]
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == a.repaired_sha256
        assert "".join(r.edit for r in own) == a.audit.replace("D", "") and re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in own))


@pytest.mark.parametrize("mod,nodes", [(repair.MOD, 2048), (repair.MOD, 12), (3, 12), (1, 40)])
def test_dp_with_few_nodes_and_colliding_hashes(mod, nodes):
    """Settling early and hashes that lie change nothing."""
    rng = random.Random(mod + nodes)
    for n in [*range(0, 12), 40, 41, 150] * 4:
        rows = [(rng.choice(["user", "assistant", "system", "tool"][: rng.choice([2, 3, 4])]), f"{i}.", rng.choice([0, 0, 0, 1, 2, 3])) for i in range(n)]
        letters, out = [], []

        def give(letter, role, text):
            letters.append(letter)
            if letter != "D":
                out.append((role, text))
        own = repair.Repair(give, nodes)
        own.tree.mod = mod
        for r in rows:
            own.row(*r)
        names = {0: "", 1: "blank", 2: "duplicate", 3: "truncated"}
        cost, audit, text = brute_repair([(r, t, names[f]) for r, t, f in rows])
        assert (own.finish(), "".join(letters), tuple(out)) == (cost, audit, text)


def test_a_long_conversation_needs_little_memory():
    rng, given = random.Random(8), []
    own = repair.Repair(lambda *x: given.append(x[0]))
    most = 0
    for i in range(60_000):
        own.row(rng.choice(["user", "assistant"]), f"{i}.", rng.choice([0, 0, 0, 0, 1, 2, 3]))
        most = max(most, len(own.tree.up), len(own.rows))
    own.finish()
    assert most < 10_000 and sum(x != "I" for x in given) == 60_000


# ---------------------------------------------------------------- operator 13
def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in v], lab) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    if not first:
        return {}, None
    dim = len(first[0][1])
    w = dim // parts
    same = [r for r in kept if len(r[1]) == dim]
    books = [[r[1][p * w:(p + 1) * w] for r in first if len(r[1]) == dim] for p in range(parts)]

    def near(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * w:(p + 1) * w], e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        held = [defaultdict(list) for _ in range(parts)]
        for _, v, _ in same:
            for p in range(parts):
                held[p][near(p, v)[1]].append(v[p * w:(p + 1) * w])
        books = [[[sum(c) // len(held[p][i]) for c in zip(*held[p][i])] if i in held[p] else e for i, e in enumerate(books[p])] for p in range(parts)]
    out, labels = [], defaultdict(int)
    for i, v, lab in same:
        got = [near(p, v) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), lab))
        labels[lab] += out[-1][2]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, labels[lab], sha) for i, c, e, lab in out), key=repr), books


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, [2]) for r in rows], "vec_id long, embedding array<float>, label int, code string, error long, x array<int>").repartition(3)


@pytest.mark.parametrize("entries", [5, 256])
def test_codes_against_brute_force(spark, entries):
    rng = random.Random(9)
    rows = [(rng.randrange(1000) * 7, [rng.choice([rng.gauss(0, 2), 0.5, -1.0]) for _ in range(8)], rng.choice([None, 1, 2])) for _ in range(150)]
    rows += rows[:9] + [(None, [0.0] * 8, 3), (-5, None, 1), (-4, [float("nan")] * 8, 1), (-3, [None] + [1.0] * 7, 1), (-2, [float("-inf")] * 8, 1)]
    rows += [(20_000 + i, [1.0] * 8, 4) for i in range(40)]
    got = sorted(map(tuple, codes.compress(vectors(spark, rows), entries=entries).collect()), key=repr)
    assert got == brute_codes(rows, entries=entries)[0]


def test_odd_vectors(spark):
    assert codes.compress(vectors(spark, [(1, None, 1)])).collect() == [] == codes.compress(vectors(spark, [(1, None, 1)]).limit(0)).collect()
    got = {r.vec_id: r for r in codes.compress(vectors(spark, [(1, [1.0] * 6, 1), (2, [1.0] * 5, 1), (3, [3e38] * 6, None), (4, [], 2)])).collect()}
    assert got[1].code and got[2].code is None and got[2].error is None and got[2].label_error == got[1].label_error == 0
    assert got[3].code and got[4].code is None and got[4].label_error is None
    assert [tuple(r)[:4] for r in codes.compress(vectors(spark, [(1, [], 1)])).collect()] == [(1, "00000000", 0, 0)]


def test_search_is_exact_and_leaves_entries_out():
    rng = np.random.default_rng(3)
    for k, width, spread in ((1, 4, 5), (40, 3, 4), (256, 16, 3000), (7, 1, 3)):
        centre = rng.integers(-9 * spread, 9 * spread, (k, 1))
        book = centre + rng.integers(-spread, spread + 1, (k, width))
        x = np.concatenate([book[rng.integers(0, k, 300)] + rng.integers(-1, 2, (300, width)), book])
        index, best, looked = codes.nearest(x, book)
        dist = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (index == dist.argmin(1)).all() and (best == dist.min(1)).all()
        assert k < 100 or looked < 0.5 * dist.size
    assert [a.size for a in codes.nearest(np.zeros((0, 3), np.int64), np.zeros((2, 3), np.int64))[:2]] == [0, 0]


def test_whole_tables_match_the_sql(spark, duck):
    for name in ("op11_sainte_lague_mix", "op13_vector_codes"):
        got = Q.QUERIES[name](spark, SF)
        cols = sorted(got.columns)
        want = duck.execute(f"SELECT {', '.join(cols)} FROM ({Q.SQL[name]})").fetchall()
        assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want)


def test_taken_words_come_near_the_targets(spark):
    by = Q.op11_sainte_lague_mix(spark, SF).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 2 * mixing.BLOCK for r in by)
