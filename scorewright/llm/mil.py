"""Operator 5: quality classifier by attention-based multiple-instance learning.

A document is a bag of passages.  Every passage of the whole text is encoded,
gated attention gives each a weight, and the weighted passage representation is
scored.  The encoder, the attention and the score are learned together from
document labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import raw_bytes, record, slices, tidy

#: Bytes of a passage.
PASSAGE = 1024
#: Bytes of text that are counted at once, beyond the longest document; each takes about 100 bytes meanwhile.
PIECE_BYTES = 1 << 18
#: Fit: labelled documents (by hash of the id) and, of each, passages (evenly
#: spread) at most; scoring has no such bounds.
TRAIN_ROWS, TRAIN_PASSAGES = 6000, 64
HIDDEN, GATE, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 12, 14, 128, 4e-3, 1e-5, 7
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    """Character class of each byte: 16 classes."""
    groups = [b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!", b"|",
              b"#*$%&<>", b"?;:'\"()", b"-_/=+@", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100))]
    t = np.full(256, 15, np.int64)
    for k, g in enumerate(groups):
        t[list(g)] = k
    return t


_CLASS, KINDS = _classes(), 16
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_POWER = np.random.default_rng(11).integers(1, 2**62, 256, dtype=np.int64) | 1
#: Pairs of classes, then words that equal the word before.
WIDTH = KINDS * KINDS + 1


def passages(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the number of passages of each row (an
    empty row has one, of zeros); some rows are counted at a time."""
    parts, a = [], 0
    while a < len(off) - 1 or not parts:
        b = min(len(off) - 1, max(a + 1, int(np.searchsorted(off, off[a] + PIECE_BYTES, side="right")) - 1))
        parts.append(_counted(buf[off[a] : off[b]], off[a : b + 1] - off[a]))
        a = b
    return tuple(np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]


def _counted(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(off)
    n = np.maximum(1, -(-size // PASSAGE))
    first = np.cumsum(n) - n
    place = np.arange(len(buf)) - np.repeat(off[:-1], size)
    owner = np.repeat(first, size) + place // PASSAGE
    kind = _CLASS[buf]
    before = np.r_[4, kind[:-1]] if len(kind) else kind
    before[place % PASSAGE == 0] = 4
    total = int(n.sum())
    x = np.bincount(owner * (KINDS * KINDS) + before * KINDS + kind, minlength=total * KINDS * KINDS).reshape(total, -1).astype(np.float32)
    twice = np.zeros(total, np.float32)
    letter = ~_SPACE[buf]
    begin = np.flatnonzero(letter & (np.r_[True, ~letter[:-1]] | (place == 0))) if len(buf) else buf
    if len(begin) > 1:  # a sum over the letters and their places stands for each word
        spot = np.arange(len(buf)) - np.repeat(np.r_[0, begin], np.diff(np.r_[0, begin, len(buf)]))
        word = np.add.reduceat(np.where(letter, buf * _POWER[spot % 256], 0), begin)
        row = np.searchsorted(off, begin, side="right")
        twice += 8 * np.bincount(owner[begin[1:][(word[1:] == word[:-1]) & (row[1:] == row[:-1])]], minlength=total)
    length = np.maximum(1, x.sum(1, keepdims=True))
    return np.log1p(np.c_[x, twice] * (200 / length)).astype(np.float32), n


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Encoder h = relu(xE + e); attention weights softmax(w . (tanh(hV) *
    sigmoid(hU))) inside each bag; score = sigmoid(c . sum(weight * h) + d)."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = {"E": r.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), "e": np.zeros(HIDDEN), "V": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
                  "U": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "w": r.normal(0, GATE**-0.5, GATE), "c": np.zeros(HIDDEN), "d": np.zeros(1)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, x, n):
        p, start = self.p, np.cumsum(n) - n
        pre = x @ p["E"] + p["e"]
        h = np.maximum(pre, 0)
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        a = (t * s) @ p["w"]
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, start), n))
        a /= np.repeat(np.add.reduceat(a, start), n)
        z = np.add.reduceat(a[:, None] * h, start)
        return _sigmoid(z @ p["c"] + p["d"][0]), (pre, h, t, s, a, z, start)

    def scores(self, x, n) -> np.ndarray:
        return self.forward(x, n)[0].astype(np.float64) if len(n) else np.zeros(0)

    def gradient(self, x, n, y):
        p = self.p
        out, (pre, h, t, s, a, z, start) = self.forward(x, n)
        g = (out - y).astype(np.float32) / len(y)
        dz = np.repeat(g[:, None] * p["c"], n, axis=0)
        da = (dz * h).sum(1)
        dl = a * (da - np.repeat(np.add.reduceat(a * da, start), n))
        dts = dl[:, None] * p["w"]
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (pre > 0)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ dl, "c": z.T @ g, "d": np.array([g.sum()])}

    def fit(self, x, n, y) -> Model:
        """Adam over shuffled bags with a fixed seed."""
        r = np.random.default_rng(SEED)
        start = np.cumsum(n) - n
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(n))
            rate = RATE * (0.1 + 0.9 * (1 - epoch / EPOCHS))
            for at in range(0, len(order), BATCH):
                bags = order[at : at + BATCH]
                rows = np.concatenate([np.arange(start[b], start[b] + n[b]) for b in bags])
                step += 1
                for k, d in self.gradient(x[rows], n[bags], y[bags]).items():
                    d = d + DECAY * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def held_out(doc_id):
    """crc32 of the id as text, modulo 5, is 0 (a null id is held out too)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fits on at most ``TRAIN_ROWS`` labelled documents that are not held out,
    taken in order of a hash of their id.  A label that is null or not 0 or 1
    is left out; of repeated ids the lowest label holds and the text with the
    least hash is used.  Of a text longer than ``TRAIN_PASSAGES`` passages that
    many are taken, evenly spread over the whole of it.
    Passages are encoded on the executors; the driver fits on their features.
    Without any labelled row every score is 0.5."""
    y = labels.select(labels[doc_id].cast("long").alias("_id"), labels[label].cast("int").alias("_y")).filter("_y in (0, 1)")
    y = y.filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.min("_y").alias("_y"))
    # a labelled document may be absent here: pick among those that are there
    there = docs.select(docs[doc_id].cast("long").alias("_id")).distinct()
    y = y.join(there, "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_ROWS)
    rows = docs.select(docs[doc_id].cast("long").alias("_id"), docs[text].alias("text")).join(F.broadcast(y), "_id")
    rows = rows.groupBy("_id", "_y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # the same one in any run
    schema = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("n", pa.int32()), ("x", pa.binary())])

    def run(batches):
        for b in slices(batches):
            x, n = passages(*raw_bytes(b.column(1)))
            start = np.cumsum(n) - n
            keep = [x[a + np.unique(np.linspace(0, k - 1, min(k, TRAIN_PASSAGES)).astype(int))] for a, k in zip(start, n, strict=True)]
            yield record(schema, b.column(0), b.column(2), [len(k) for k in keep], [k.astype(np.float16).tobytes() for k in keep])

    got = sorted(rows.select("_id", "text", "_y").mapInArrow(tidy(run), "id long, y int, n int, x binary").collect(), key=lambda r: r.id)
    model = Model()
    if got:
        x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.float16).reshape(-1, WIDTH).astype(np.float32)
        model.fit(x, np.array([r.n for r in got]), np.array([r.y for r in got], np.float32))
    return model


def classify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Row by row, without a shuffle; only the text makes the score.  A null text
    counts as empty (one passage of zeros); a null doc_id stays null; other
    columns are not read."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for b in slices(batches):
            yield record(schema, b.column(0), model.scores(*passages(*raw_bytes(b.column(1)))))

    out = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(tidy(run), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            keep = [s >= THRESHOLD for part in slices([batch], text) for s in model.scores(*passages(*raw_bytes(part.column(place))))]
            if keep:
                yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
