"""Operator 2: token-id output by best-fit-decreasing packing.

Each task encodes its documents, cuts overlong ones into pieces without loss,
and packs the pieces of a chunk of documents, largest first, into the fullest
sequence that still has room.  A segment tree over the free room (0..capacity)
finds that sequence in logarithmic time.  No shuffle: a chunk never leaves its
task, and only the last sequences of a chunk may be part empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import record, slices
from .bpe import PreTokenizer, load_table, merge_ragged

#: Tokens of a chunk that is packed at once.
CHUNK_TOKENS = 2_000_000
#: Tokens of a sequence.
CAPACITY = 2048
CACHE_WORDS, CACHE_CHARS = 400_000, 64
_ids: dict[tuple, dict] = {}


class RoomTree:
    """Sequences by free room.  A node of the segment tree counts the
    sequences whose room lies in its range; ``fit`` finds the least room that
    is at least ``size``."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.held: dict[int, list[int]] = {}

    def add(self, room: int, seq: int) -> None:
        self.held.setdefault(room, []).append(seq)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def fit(self, size: int) -> tuple[int, int] | None:
        """(room, sequence) taken out of the tree, or None."""
        count, i = self.count, size + self.leaves
        while not count[i]:  # up to the first ancestor with something to the right
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return room, self.held[room].pop()


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indexes of the sizes in each sequence, by best-fit-decreasing.  Sizes
    are 1 to ``capacity``; equal ones keep their order."""
    tree, out = RoomTree(capacity), []
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        got = tree.fit(sizes[i])
        if got is None:
            got = capacity, len(out)
            out.append([])
        room, seq = got
        out[seq].append(i)
        if room > sizes[i]:
            tree.add(room - sizes[i], seq)
    return out


def id_width(path: str) -> int:
    """Bytes of a token id of this tokenizer file."""
    return 2 if load_table(path).size <= 1 << 16 else 4


class IdEncoder:
    """Token ids of texts as little-endian bytes, words remembered."""

    def __init__(self, path: str):
        self.table = load_table(path)
        self.split = PreTokenizer(path, self.table)
        self.dtype = np.dtype(f"<u{id_width(path)}")
        self.known = _ids.setdefault((path,), {})

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, local = self.known, {}
        fresh = [w for w in set().union(*split) if w not in known]
        for w in [w for w in fresh if not isinstance(w, str)]:
            local[w] = np.array([w], self.dtype).tobytes()
        fresh = [w for w in fresh if isinstance(w, str)]
        ids, n = merge_ragged(self.table, *self.table.symbols([w.encode() for w in fresh]))
        raw, at = ids.astype(self.dtype).tobytes(), 0
        for w, k in zip(fresh, (n * self.dtype.itemsize).tolist(), strict=True):
            (known if len(w) <= CACHE_CHARS else local)[w] = raw[at : at + k]
            at += k
        if not local:
            return [b"".join(map(known.__getitem__, ws)) for ws in split]
        return [b"".join([known[w] if w in known else local[w] for w in ws]) for ws in split]


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, pad: int = 0,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per packed sequence: seq_id, n_tokens, ids (one row of the id
    matrix: ``capacity`` little-endian integers, padded), cu_seqlens (0 and the
    end of each segment), position_resets (the places where positions start
    again at 0), doc_ids and doc_offsets (each segment's document and the token
    of it that the segment starts with).

    The segments of a document, by offset, give back exactly its tokens.  A
    null or empty text has no tokens and is in no sequence; a null doc_id stays
    null; repeated rows are packed each; an empty table gives no rows; other
    columns are not read.  ``seq_id`` is the input partition and a count within
    it."""
    schema = pa.schema([("seq_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
                        ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int64()))])

    def run(batches):
        from pyspark import TaskContext

        encode = IdEncoder(path)
        width = encode.dtype.itemsize
        made = TaskContext.get().partitionId() << 33
        pieces: list[tuple] = []
        held = 0

        def packed():
            nonlocal made
            sizes = [len(p[2]) // width for p in pieces]
            rows = []
            for seq in best_fit(sizes, capacity):
                cu = [0, *np.cumsum([sizes[i] for i in seq]).tolist()]
                ids = b"".join([pieces[i][2] for i in seq])
                ids += np.full(capacity - cu[-1], pad, encode.dtype).tobytes()
                rows.append((made, cu[-1], ids, cu, cu[:-1], [pieces[i][0] for i in seq], [pieces[i][1] for i in seq]))
                made += 1
                if len(rows) == 512:
                    yield record(schema, *map(list, zip(*rows, strict=True)))
                    rows = []
            if rows:
                yield record(schema, *map(list, zip(*rows, strict=True)))

        for b in slices(batches):
            for i, raw in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist()), strict=True):
                for at in range(0, len(raw), capacity * width):
                    pieces.append((i, at // width, raw[at : at + capacity * width]))
                held += len(raw) // width
                if held >= CHUNK_TOKENS:
                    yield from packed()
                    pieces, held = [], 0
        yield from packed()

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(
        run, "seq_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_offsets array<long>")


def documents_back(packed: DataFrame, width: int = 2) -> DataFrame:
    """doc_id and its token ids, put together again from the segments (for
    tables without repeated ids)."""
    parts = packed.select("ids", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "doc_offsets"))).select(
        F.col("col.doc_ids").alias("doc_id"), F.col("col.doc_offsets").alias("offset"),
        F.expr(f"substring(ids, cu_seqlens[pos] * {width} + 1, (cu_seqlens[pos + 1] - cu_seqlens[pos]) * {width})").alias("part"))
    return parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("offset", F.hex("part").alias("part")))).alias("p")).select(
        "doc_id", F.unhex(F.array_join(F.col("p.part"), "")).alias("ids"))
