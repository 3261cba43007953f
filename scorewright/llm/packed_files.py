"""Binary files of packed sequences, named by a manifest.

A folder holds, for every up to ``ROWS`` sequences of a task, five files:

* ``.ids``: the id matrix, one row of ``capacity`` little-endian integers of
  ``width`` bytes per sequence;
* ``.cu``: int32, each sequence's cumulative segment lengths (0 first);
* ``.resets``: a bit per place of the matrix (low bit first, rows padded to whole
  bytes), set where positions start again at 0; the padding's start is one;
* ``.rows``: int64 triples (seq_id, tokens, segments), one per sequence;
* ``.docs``: int64 triples (doc_id, token of the document, 1 or 0 for a null id),
  one per segment;

and ``manifest``, a JSON table with a row per such group of files.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import record

#: Sequences of one group of files.
ROWS = 8192
KINDS = ("ids", "cu", "resets", "rows", "docs")
MANIFEST = "name string, n_rows long, n_segments long, n_tokens long, capacity int, width int, sha256 array<string>"
PACKED = "seq_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_offsets array<long>"
_MANIFEST = pa.schema([("name", pa.string()), ("n_rows", pa.int64()), ("n_segments", pa.int64()), ("n_tokens", pa.int64()), ("capacity", pa.int32()),
                       ("width", pa.int32()), ("sha256", pa.list_(pa.string()))])
_PACKED = pa.schema([("seq_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
                     ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int64()))])


def _binary(batch: pa.RecordBatch, capacity: int) -> tuple[list[bytes], int]:
    """The bytes of each kind for the rows of a batch, and their segments."""
    seq, n, ids, cu, resets, doc, offset = (batch.column(i) for i in range(7))
    n = n.to_numpy().astype(np.int64)
    segments = np.diff(doc.offsets.to_numpy())
    docs = doc.flatten()
    triples = np.stack([docs.fill_null(0).to_numpy(), offset.flatten().to_numpy(), docs.is_valid().to_numpy(zero_copy_only=False)], axis=1)
    bits = np.zeros((batch.num_rows, -(-capacity // 8) * 8), np.uint8)
    at = resets.flatten().to_numpy()
    bits[np.repeat(np.arange(batch.num_rows), np.diff(resets.offsets.to_numpy())), at] = 1
    short = np.flatnonzero(n < capacity)
    bits[short, n[short]] = 1
    rows = np.stack([seq.to_numpy(), n, segments], axis=1)
    return [b"".join(ids.to_pylist()), cu.flatten().to_numpy().astype("<i4").tobytes(), np.packbits(bits, axis=1, bitorder="little").tobytes(),
            rows.astype("<i8").tobytes(), triples.astype("<i8").tobytes()], len(docs)


def write_packed(packed: DataFrame, path: str, capacity: int, width: int) -> str:
    """Write the rows of ``pack_documents`` as binary files under ``path`` (a
    fresh folder that all executors share; any that ``pyarrow.fs`` opens) and
    return ``path``.

    A task writes its files under names of its attempt and hands in a manifest
    row for each group; the manifest is a table that Spark commits, so files of
    lost or repeated attempts are in no manifest and never read.  A task holds a
    batch of rows.  A null document id is kept as null; an empty table gives an
    empty manifest; a row whose id row is not ``capacity * width`` bytes long is
    an error; more columns are not written."""

    def run(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(base, recursive=True)
        held = None  # name, streams, digests, [rows, segments, tokens]

        def closed():
            name, streams, digests, sums = held
            for s in streams:
                s.close()
            return record(_MANIFEST, [name], *([x] for x in sums), [capacity], [width], [[d.hexdigest() for d in digests]])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                if held is None:
                    name = uuid.uuid4().hex
                    held = name, [fs.open_output_stream(f"{base}/{name}.{k}") for k in KINDS], [hashlib.sha256() for _ in KINDS], [0, 0, 0]
                part = batch.slice(at, min(512, ROWS - held[3][0]))
                at += part.num_rows
                raw, segments = _binary(part, capacity)
                if len(raw[0]) != part.num_rows * capacity * width:
                    raise ValueError(f"id rows are not {capacity} ids of {width} bytes")
                for data, stream, digest in zip(raw, *held[1:3], strict=True):
                    stream.write(data)
                    digest.update(data)
                for i, x in enumerate((part.num_rows, segments, int(part.column(1).to_numpy().sum()))):
                    held[3][i] += x
                if held[3][0] == ROWS:
                    yield closed()
                    held = None
        if held:
            yield closed()

    names = [f.split()[0] for f in PACKED.split(", ")]
    packed.select(*names).mapInArrow(run, MANIFEST).write.json(f"{path.rstrip('/')}/manifest")
    return path


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path.rstrip('/')}/manifest")


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``write_packed`` wrote, from its files: seq_id, n_tokens,
    ids, cu_seqlens, position_resets (without the padding's), doc_ids,
    doc_offsets.

    Groups of files are dealt over the tasks; a task holds one group (at most
    ``ROWS`` sequences).  A file whose SHA-256 is not the manifest's is an error;
    an empty manifest gives no rows."""
    manifest = read_manifest(spark, path)
    files = manifest.count()
    tasks = max(1, min(files, 2 * spark.sparkContext.defaultParallelism), files // 16)

    def run(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(path)
        for batch in batches:
            for m in batch.to_pylist():
                raw = []
                for kind, digest in zip(KINDS, m["sha256"], strict=True):
                    with fs.open_input_stream(f"{base}/{m['name']}.{kind}") as f:
                        raw.append(f.read())
                    if hashlib.sha256(raw[-1]).hexdigest() != digest:
                        raise ValueError(f"{m['name']}.{kind} is not the file of the manifest")
                yield from _rows(raw, m["capacity"], m["width"])

    return manifest.repartition(tasks).mapInArrow(run, PACKED)


def _rows(raw, capacity, width):
    rows = np.frombuffer(raw[3], "<i8").reshape(-1, 3)
    cu, docs = np.frombuffer(raw[1], "<i4"), np.frombuffer(raw[4], "<i8").reshape(-1, 3)
    bits = np.frombuffer(raw[2], np.uint8).reshape(len(rows), -1)
    ends = np.r_[0, np.cumsum(rows[:, 2])]
    for a in range(0, len(rows), 512):
        b = min(a + 512, len(rows))
        seq, n, segments = rows[a:b].T
        off = (ends[a : b + 1] - ends[a]).astype(np.int32)
        cu_off = off + np.arange(b - a + 1, dtype=np.int32)
        row, at = np.nonzero(np.unpackbits(bits[a:b], axis=1, bitorder="little"))
        inside = at < n[row]
        resets = pa.ListArray.from_arrays(np.r_[0, np.cumsum(np.bincount(row[inside], minlength=b - a))].astype(np.int32), at[inside].astype(np.int32))
        part = docs[ends[a] : ends[b]]
        yield record(
            _PACKED, np.ascontiguousarray(seq), n.astype(np.int32), [raw[0][i * capacity * width : (i + 1) * capacity * width] for i in range(a, b)],
            pa.ListArray.from_arrays(cu_off, cu[ends[a] + a : ends[b] + b]), resets,
            pa.ListArray.from_arrays(off, pa.array(part[:, 0], mask=part[:, 2] == 0)), pa.ListArray.from_arrays(off, pa.array(np.ascontiguousarray(part[:, 1]))))
