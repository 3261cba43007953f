"""Operator 7: removal of repeated 200-byte strings.

Taken from difference-cover suffix sorting is the idea of a sample that any two
equal strings hit at the same offset.  Nothing is sorted in suffix order, and
there is no recursion and no comparison of adjacent prefixes: anchors are
chosen by content and repeats are counts of equal hashes:

1. Sample.  A difference cover guarantees that two equal strings have a sampled
   suffix at the same offset.  Fixed residues need at least 8 % of all
   suffixes for that; the least hash of the 32-byte strings inside each
   200-byte window gives the same guarantee with about 1.2 %, since equal
   windows choose the same place.
2. Name.  Sampled suffixes are named by their first 32 bytes.  A name that
   occurs at one place only is dropped with the windows that it stands for.
3. Go on with the repeated names only: each brings the bytes around it that its
   windows cover.
4. Count.  Windows at the same offset from the same name repeat if the hashes
   of their 200 bytes are equal.

Places are kept per distinct text; a text that several rows share repeats whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .batches import raw_bytes, record, slices
from .jaccard import mix

LENGTH, GRAM = 200, 32
RUN = LENGTH - GRAM + 1
#: Members of a name beyond which its windows are counted as rows of their own.
HOT_MEMBERS = 20_000
_LETTER = mix(np.arange(256, dtype=np.uint64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64((1 << 32) - 1)


def string_hashes(buf: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash (mod 2**64, mixed) of every ``length``-byte string, by
    doubling: a string of 2w bytes from two of w."""
    if len(buf) < length:
        return np.zeros(0, np.uint64)
    now, width, power = _LETTER[buf], 1, _STEP
    done, have = None, 0
    with np.errstate(over="ignore"):
        while True:
            if length & width:
                done, have = (now, width) if done is None else (done[: len(now) - have] * power + now[have:] if len(now) > have else now[:0], have + width)
            if have == length:
                return mix(done[: len(buf) - length + 1])
            now = now[:-width] * power + now[width:]
            width, power = 2 * width, power * power


def sampled(buf: np.ndarray, off: np.ndarray):
    """(row, name, place, first window, last window) of the sampled suffixes:
    places and window starts in bytes of the row."""
    size = np.diff(off)
    n = np.maximum(0, size - LENGTH + 1)
    if not n.sum():
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    grams = string_hashes(buf, GRAM)
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    have = 1
    while 2 * have <= RUN:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < RUN:
        least = np.minimum(least[: -(RUN - have)], least[RUN - have :])
    start = np.repeat(off[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    at = (least[start] & _LOW).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
    last = np.r_[first[1:], len(at)] - 1
    row, base = row[first], off[:-1][row[first]]
    return row, grams[at[first]], at[first] - base, start[first] - base, start[last] - base


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _samples(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("name", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("p", pa.int32()), ("a", pa.int32()), ("b", pa.int32())])

    def run(batches):
        for batch in slices(batches):
            row, name, p, a, b = sampled(*raw_bytes(batch.column(2)))
            if len(row):
                h1, h2 = (batch.column(i).to_numpy()[row] for i in (0, 1))
                yield record(schema, name.view(np.int64), h1, h2, p.astype(np.int32), a.astype(np.int32), b.astype(np.int32))

    return docs.mapInArrow(run, "name long, h1 long, h2 long, p int, a int, b int")


def _contexts(docs: DataFrame) -> DataFrame:
    """(name, h1, h2, a, b, d, bytes, hot): the bytes that the windows a..b of a
    repeated name cover, d before the name.  Equal ones of a task are sent once;
    their windows repeat, which rows without bytes say."""
    schema = pa.schema([("name", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("d", pa.int32()), ("bytes", pa.binary()), ("hot", pa.bool_())])

    def run(batches):
        texts: set = set()
        for batch in slices(batches):
            met: dict = {}
            out: list = []
            if len(texts) > 500_000:
                texts.clear()
            for h1, h2, text, marks in zip(*(batch.column(i) for i in range(4)), strict=True):
                key = h1.as_py(), h2.as_py()
                if key in texts:
                    continue
                texts.add(key)
                raw = text.as_buffer().to_pybytes()
                m = marks.values
                names, ps, starts, ends, hots = (m.field(i).to_numpy(zero_copy_only=False) for i in range(5))
                for name, p, a, b, hot in zip(names.tolist(), ps.tolist(), starts.tolist(), ends.tolist(), hots.tolist(), strict=True):
                    part = raw[a : b + LENGTH]
                    if met.setdefault((name, p - a, part), key) is key:
                        first = len(out)
                        met[name, p - a, part] = (key, first, a, b)
                        out.append((name, *key, a, b, p - a, part, hot))
                    else:
                        k, first, fa, fb = met[name, p - a, part]
                        out.append((name, *key, a, b, 0, None, hot))
                        if first is not None:
                            out.append((name, *k, fa, fb, 0, None, hot))
                            met[name, p - a, part] = (k, None, fa, fb)
            for at in range(0, len(out), 4096):
                yield record(schema, *map(list, zip(*out[at : at + 4096], strict=True)))

    return docs.mapInArrow(run, "name long, h1 long, h2 long, a int, b int, d int, bytes binary, hot boolean")


def _windows(a, d, parts):
    """(member, start in the row, offset to the name, hash) of every window."""
    buf = np.frombuffer(b"".join(parts), np.uint8)
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    off = np.cumsum(lens) - lens
    n = lens - LENGTH + 1
    which = np.repeat(np.arange(len(parts)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return which, a[which] + place, d[which] - place, string_hashes(buf, LENGTH)[off[which] + place]


def _spans(which, start):
    """(member, first, last) of the runs of window starts, sorted by member and start."""
    cut = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (start[1:] != start[:-1] + 1)])
    end = np.r_[cut[1:], len(which)] - 1
    return which[cut], start[cut], start[end]


_SPAN = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def _compare(rows: DataFrame) -> DataFrame:
    """(h1, h2, a, b): repeated windows among the members of each name.  No join
    by name may stand right below: Spark would take its shuffle for this one and
    then split or read it locally, so that members of a name part unseen."""

    def flush(held):
        name, h1, h2, a, d = (np.concatenate([x[i] for x in held]) for i in range(5))
        parts = [p for x in held for p in x[5]]
        _, once = np.unique(np.c_[name, h1, h2, a], axis=0, return_index=True)  # a text that several tasks sent
        once.sort()
        name, h1, h2, a, d, parts = name[once], h1[once], h2[once], a[once], d[once], [parts[i] for i in once]
        which, start, near, key = _windows(a.astype(np.int64), d.astype(np.int64), parts)
        key = mix(key ^ mix(name.view(np.uint64)[which] + near.astype(np.uint64)))
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = count[back] > 1
        if hit.any():
            m, first, last = _spans(which[hit], start[hit])
            yield record(_SPAN, h1[m], h2[m], first.astype(np.int32), last.astype(np.int32))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            whole = batch.column(6).is_null().to_numpy(zero_copy_only=False)
            if whole.any():
                got = batch.filter(pa.array(whole))
                yield record(_SPAN, *(got.column(i) for i in (1, 2, 3, 4)))
                batch = batch.filter(pa.array(~whole))
            if not batch.num_rows:
                continue
            # names are sorted: all but the last name held are complete
            name = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(name[1:] != name[:-1]) + 1).tolist(), len(name)]
            if size > (1 << 20) and held and held[-1][0][-1] != name[0]:
                yield from flush(held)
                held, size = [], 0
            elif size > (1 << 20) and len(cuts) > 2:
                held.append(_columns(batch.slice(0, cuts[1])))
                yield from flush(held)
                held, size, batch = [], 0, batch.slice(cuts[1])
            held.append(_columns(batch))
            size += batch.column(6).nbytes
        if held:
            yield from flush(held)

    return rows.repartition("name").sortWithinPartitions("name").mapInArrow(run, "h1 long, h2 long, a int, b int")


def _columns(batch):
    return (*(batch.column(i).to_numpy() for i in (0, 1, 2, 3, 5)), batch.column(6).to_pylist())


def _compare_rows(rows: DataFrame) -> DataFrame:
    """The same for names with very many members: a row for each window, counted
    with partial aggregation."""
    schema = pa.schema([("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("start", pa.int32())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                name, h1, h2, a, d, parts = _columns(batch.slice(at, 2000))
                which, start, near, key = _windows(a.astype(np.int64), d.astype(np.int64), parts)
                key = mix(key ^ mix(name.view(np.uint64)[which] + near.astype(np.uint64))).view(np.int64)
                yield record(schema, key, h1[which], h2[which], start.astype(np.int32))

    windows = rows.filter("bytes is not null").mapInArrow(run, "key long, h1 long, h2 long, start int")
    place = F.xxhash64("h1", "h2", "start")
    twice = windows.groupBy("key").agg(F.min(place).alias("x"), F.max(place).alias("y")).filter("x != y").select("key")
    spans = windows.join(twice, "key", "left_semi").select("h1", "h2", F.col("start").alias("a"), F.col("start").alias("b")).distinct()
    return spans.unionByName(rows.filter("bytes is null").select("h1", "h2", "a", "b"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT_MEMBERS, keep_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256
    (and the kept bytes, if asked for).

    Removed are the bytes covered by a 200-byte string that also starts at
    another place of the table; strings never cross rows and are judged on the
    input.  A null text counts as empty; repeated rows are places of their own,
    so they repeat each other; a null doc_id stays null; other columns are not
    read; an empty table gives no rows.  Texts are told apart by 128 hash bits
    and strings by 64.  Shuffled are a row of about 40 bytes for each sampled
    suffix (1.2 % of the bytes), the bytes around repeated names, and the texts
    twice; a task holds a slice of texts and the members of one name (names with
    more than ``hot`` members are spread over the tasks by window)."""
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), t.alias("text"))
    docs = docs.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(7), "text"))
    keys = ["h1", "h2"]
    rows = _kept(_samples(docs.select(*keys, "text")), "op7-samples")
    place = F.xxhash64("h1", "h2", "p")
    names = rows.groupBy("name").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.count(F.lit(1)).alias("n")).filter("x != y")
    names = _kept(names.select("name", (F.col("n") > hot).alias("hot")), "op7-names")
    live = rows.join(names, "name").dropDuplicates([*keys, "p"])
    marks = _kept(live.groupBy(*keys).agg(F.collect_list(F.struct("name", "p", "a", "b", "hot")).alias("marks")), "op7-marks")
    long = docs.filter(F.octet_length("text") >= LENGTH).select(*keys, "text")
    parts = _contexts(long.join(marks.hint("shuffle_hash"), keys).select(*keys, "text", "marks"))
    if names.filter("hot").limit(1).count():
        parts = _kept(parts, "op7-parts")
        spans = _compare(parts.filter("not hot")).unionByName(_compare_rows(parts.filter("hot")))
    else:
        spans = _compare(parts)
    copies = docs.select(*keys, F.octet_length("text").alias("n")).filter(F.col("n") >= LENGTH).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.max("n").alias("n")).filter("rows > 1")
    spans = spans.unionByName(copies.select(*keys, F.lit(0).alias("a"), (F.col("n") - LENGTH).cast("int").alias("b")))
    spans = _kept(spans.groupBy(*keys).agg(F.collect_list(F.struct("a", "b")).alias("spans")), "op7-spans")

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema([*fields, *[("kept", pa.binary())] * keep_text])

    def run(batches):
        for batch in slices(batches):
            out = []
            for i, raw, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2), strict=True):
                kept, n, removed = raw, 0, 0
                if spans.is_valid:
                    a, b = (spans.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order] + LENGTH)
                    cut = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
                    a, b = a[cut], b[np.r_[cut[1:], len(b)] - 1]
                    n, removed = len(a), int((b - a).sum())
                    edges = [0, *np.c_[a, b].ravel().tolist(), len(raw)]
                    kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                out.append((i, len(raw), removed, n, hashlib.sha256(kept).hexdigest(), *[kept] * keep_text))
            yield record(schema, *map(list, zip(*out, strict=True)))

    full = docs.join(spans.hint("shuffle_hash"), keys, "left").select("doc_id", "text", "spans")
    return full.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
