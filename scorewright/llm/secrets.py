"""Operator 6: secret scans.

Fixed-form secrets by pattern, and random-looking strings by two character
Markov models, one of random strings and one of ordinary identifiers, compared
by their log-likelihood ratio.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import raw_bytes, record, slices, tidy

#: The base kinds in their order, and the assignment pattern.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
RANDOM = "random"

#: Strings that the models judge: runs of these characters, at least so long.
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
CANDIDATE_MIN, SAMPLE_MIN = 16, 6
#: A candidate is a secret if the ratio passes both (nats; nats per character).
LLR_MIN, LLR_MEAN_MIN = 8.0, 0.35
#: Pseudo-counts: of each character, and of a state's row (shared out as the characters are).
SMOOTHING, ROW = 0.5, 20.0
STATES = len(ALPHABET) + 1  # and the start


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_HEX, _UPPER, _ALL = _table(b"0123456789abcdef"), _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), _table(ALPHABET)
_LETTER = _table(bytes(c for c in ALPHABET if chr(c).isalpha()))
_STATE = np.full(256, -1, np.int64)
_STATE[list(ALPHABET)] = np.arange(1, STATES)


def runs(buf: np.ndarray, off: np.ndarray, member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of member bytes inside a row."""
    m = member[buf]
    if not len(m):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = np.r_[True, ~m[:-1]], np.r_[~m[1:], True]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(m))]
    first[edge], last[edge - 1] = True, True
    a, b = np.flatnonzero(m & first), np.flatnonzero(m & last) + 1
    long = b - a >= least
    return a[long], b[long]


def base_spans(buf: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int, int, int]]]:
    """Row -> (kind, start, end, start of the value), in bytes of the row."""
    data, found = buf.tobytes(), {}

    def row(a):
        return int(np.searchsorted(off, a, side="right")) - 1

    low, rows = data.lower(), set()
    for word in KEYWORDS:
        at = low.find(word)
        while at >= 0:
            rows.add(r := row(at))
            at = low.find(word, int(off[r + 1]) if at + len(word) <= off[r + 1] else at + 1)
    for r in rows:
        text = data[off[r] : off[r + 1]]
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_MIN:
                found.setdefault(r, []).append((0, m.start(), m.end(), m.start(2)))
    for a, b in zip(*runs(buf, off, _UPPER, ACCESS_MIN), strict=True):
        at = data.find(b"AKIA", a, b)
        if at >= 0 and b - at >= ACCESS_MIN:
            r = row(a)
            found.setdefault(r, []).append((1, at - int(off[r]), int(b - off[r]), at - int(off[r])))
    for a, b in zip(*runs(buf, off, _HEX, HEX_MIN), strict=True):
        r = row(a)
        found.setdefault(r, []).append((2, int(a - off[r]), int(b - off[r]), int(a - off[r])))
    return found


def _candidates(buf, off, least, base, cut=True):
    """Runs of the alphabet, cut at the base spans: starts and ends of the
    pieces outside them (or of the runs that meet no base span)."""
    a, b = runs(buf, off, _ALL, least)
    taken = np.array(sorted((int(off[r]) + s, int(off[r]) + e) for r, spans in base.items() for _, s, e, _ in spans), np.int64).reshape(-1, 2)
    if not len(taken) or not len(a):
        return a, b
    reach = np.maximum.accumulate(taken[:, 1])
    first = np.flatnonzero(np.r_[True, taken[1:, 0] > reach[:-1]])  # spans that overlap or touch are one
    low, high = taken[first, 0], reach[np.r_[first[1:], len(taken)] - 1]
    begin, end = np.searchsorted(high, a, side="right"), np.searchsorted(low, b)  # the spans begin..end - 1 meet the run
    n = np.maximum(0, end - begin)
    which = np.repeat(np.arange(len(a)), n + 1)
    place = np.arange(len(which)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)
    at = begin[which] + place
    start = np.where(place > 0, high[np.maximum(at - 1, 0)], a[which])
    stop = np.where(place < n[which], low[np.minimum(at, len(low) - 1)], b[which])
    long = (stop - start >= least) & (cut | (n[which] == 0))
    return start[long], stop[long]


def _transitions(buf, a, b):
    """State pairs of all strings [a, b), flat, and the string of each."""
    lens = b - a
    which = np.repeat(np.arange(len(a)), lens)
    place = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
    at = np.repeat(a, lens) + place
    now = _STATE[buf[at]]
    prev = np.where(place > 0, _STATE[buf[at - (place > 0)]], 0)
    keep = now >= 0
    return np.maximum(prev[keep], 0) * STATES + now[keep], which[keep]


def fit(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log-likelihood ratio of each state pair, from all documents.

    Labelled samples: what the base patterns match (values of assignments,
    access keys, hex strings) are random strings; other runs of ``SAMPLE_MIN``
    characters or more that are too short to be candidates are ordinary
    identifiers.  Each task counts its pairs in a fixed table and sends the
    non-zero ones; the sums, at most 2 * STATES**2 rows, come to the driver.  A
    state that a label has seen little of falls back on the label's characters
    as a whole, and these on equal shares."""
    schema = pa.schema([("label", pa.int32()), ("pair", pa.int32()), ("n", pa.int64())])

    def run(batches):
        sums = np.zeros((2, STATES * STATES), np.int64)
        for batch in slices(batches):
            buf, off = raw_bytes(batch.column(0))
            base = base_spans(buf, off)
            values = np.array([(int(off[r]) + v, int(off[r]) + e) for r, spans in base.items() for _, _, e, v in spans], np.int64).reshape(-1, 2)
            a, b = _candidates(buf, off, SAMPLE_MIN, base, cut=False)  # what is joined to a secret may be one
            short = b - a < CANDIDATE_MIN
            for label, (a, b) in enumerate(((a[short], b[short]), (values[:, 0], values[:, 1]))):
                if len(a):
                    sums[label] += np.bincount(_transitions(buf, a, b)[0], minlength=STATES * STATES)
        for label in (0, 1):
            at = np.flatnonzero(sums[label])
            if len(at):
                yield record(schema, np.full(len(at), label, np.int32), at.astype(np.int32), sums[label][at])

    rows = docs.select(docs[text].alias("text")).mapInArrow(tidy(run), "label int, pair int, n long")
    got = rows.groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros((2, STATES * STATES))
    for r in got:
        sums[r.label, r.pair] = r.n
    sums = sums.reshape(2, STATES, STATES)
    chars = sums.sum(1) + SMOOTHING
    chars[:, 0] = 0  # nothing leads to the start
    chars /= chars.sum(1, keepdims=True)
    share = (sums + ROW * chars[:, None, :]) / (sums.sum(2, keepdims=True) + ROW)
    share[:, :, 0] = 1
    return (np.log(share[1]) - np.log(share[0])).reshape(-1)


def random_spans(buf, off, base, ratio: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Row -> spans of candidates that look random, in bytes of the row.  A run
    without a letter is a number (an amount, an id, a card: not a secret of
    this kind) and is not judged."""
    a, b = _candidates(buf, off, CANDIDATE_MIN, base)
    letters = np.r_[0, np.cumsum(_LETTER[buf])]
    named = letters[b] > letters[a]
    a, b = a[named], b[named]
    found: dict[int, list[tuple[int, int]]] = {}
    if not len(a):
        return found
    pair, which = _transitions(buf, a, b)
    score = np.bincount(which, weights=ratio[pair], minlength=len(a))
    for i in np.flatnonzero((score >= LLR_MIN) & (score >= LLR_MEAN_MIN * (b - a))):
        r = int(np.searchsorted(off, a[i], side="right")) - 1
        found.setdefault(r, []).append((int(a[i] - off[r]), int(b[i] - off[r])))
    return found


def spans_of(buf, off, ratio) -> dict[int, list[tuple[int, int, int]]]:
    """Row -> (kind, start, end) in code points, by start and kind; kind 3 is
    the models'."""
    base = base_spans(buf, off)
    extra = random_spans(buf, off, base, ratio)
    out = {}
    for r in sorted({*base, *extra}):
        spans = [(k, s, e) for k, s, e, _ in base.get(r, ())] + [(len(KINDS), s, e) for s, e in extra.get(r, ())]
        text = buf[off[r] : off[r + 1]]
        if (text >= 0x80).any():
            point = np.r_[0, np.cumsum((text & 0xC0) != 0x80)]
            spans = [(k, int(point[s]), int(point[e])) for k, s, e in spans]
        out[r] = sorted(spans, key=lambda x: (x[1], x[0]))
    return out


def _joined(spans) -> str:
    return ",".join(f"{(*KINDS, RANDOM)[k]}:{s}:{e}" for k, s, e in spans)


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ratio: np.ndarray | None = None) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256,
    spans, n_random.

    The models (``ratio``, from ``fit``) are fitted on the same documents first
    if none are given (one pass, bounded sums); the scan is row by row, without
    a shuffle.  A null text counts as empty; a null doc_id stays null; repeated
    rows each give a row; an empty table gives none; other columns are not read.
    Whole texts, in slices of about 2 MB."""
    ratio = fit(docs, text) if ratio is None else ratio
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
                        ("base_sha256", pa.string()), ("spans", pa.string()), ("n_random", pa.int64())])
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for b in slices(batches):
            found = spans_of(*raw_bytes(b.column(1)), ratio)
            n = b.num_rows
            counts, sha, shown = np.zeros((4, n), np.int64), [empty] * n, [""] * n
            for r, spans in found.items():
                for k, _, _ in spans:
                    counts[k, r] += 1
                sha[r] = hashlib.sha256(_joined([x for x in spans if x[0] < len(KINDS)]).encode()).hexdigest()
                shown[r] = _joined(spans)
            yield record(schema, b.column(0), counts[0], counts[1], counts[2], sha, shown, counts[3])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(
        tidy(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redact_secrets(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", ratio: np.ndarray | None = None) -> DataFrame:
    """The same rows and columns with every found span replaced by ``mask``
    (overlapping spans by one).  A null text stays null, an empty one empty;
    repeated rows, ids and other columns are as they were; an empty table gives
    none.  With models given (``ratio``), what is masked in a text hangs on that
    text alone; else they are fitted on these documents."""
    ratio = fit(docs, text) if ratio is None else ratio
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            nulls = batch.column(place).is_null().to_pylist()
            done = []
            for part in slices([batch], text):
                column = part.column(place)
                texts = column.to_pylist()
                for r, spans in spans_of(*raw_bytes(column), ratio).items():
                    out, at = [], 0
                    for _, s, e in spans:
                        if s >= at:
                            out += [texts[r][at:s], mask]
                        at = max(at, e)
                    texts[r] = "".join(out) + texts[r][at:]
                done += texts
            fixed = pa.array([None if x else t for x, t in zip(nulls, done, strict=True)], pa.string())
            yield batch.set_column(place, text, fixed)

    return docs.mapInArrow(tidy(run), docs.schema)
