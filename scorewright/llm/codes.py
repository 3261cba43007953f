"""Operator 13: product codes of vectors, found by equal-average search.

A vector is cut into parts, every part position has a codebook, and a vector's
code names the nearest entry of each part.  The search for the nearest entry
sorts the entries by their component sum and goes outward from the part's own
sum: a gap g between the sums of two w-component vectors means a squared
distance of at least g * g / w, so it ends once that is above the best distance
found.  Entries whose bound equals the best distance are still looked at, since
the lower index wins a tie.

Every round is one pass of Spark tasks over the vectors; a task hands on the
counts and sums of its parts per entry, and the driver gets their totals (parts
x entries rows, whatever the input) and makes the next codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .batches import record

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that are searched at once.
ROWS = 4096
CODED = "vec_id long, label int, code string, error long"


def cut(dim: int, parts: int) -> list[slice]:
    """Consecutive parts of equal length; if that doesn't come out even, the
    first ones are one component longer."""
    ends = [0, *np.cumsum([dim // parts + (i < dim % parts) for i in range(parts)]).tolist()]
    return [slice(a, b) for a, b in zip(ends, ends[1:])]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of the nearest entry to each row of ``x``, ties
    to the lower index, and how many distances were computed."""
    m, width = x.shape
    sums = book.sum(1)
    order = np.argsort(sums, kind="stable")
    sums, sorted_book, far = sums[order], book[order], np.iinfo(np.int64).max
    own, looked = x.sum(1), 0
    index, best = np.full(m, len(book)), np.full(m, far)
    rows = np.arange(m)
    up = np.searchsorted(sums, own)  # first entry not below
    down = up - 1
    while rows.size:
        below = np.where(down >= 0, own - sums[np.maximum(down, 0)], far)
        above = np.where(up < len(sums), sums[np.minimum(up, len(sums) - 1)] - own, far)
        gap, lower = np.minimum(below, above), below <= above
        left = gap < far
        # the nearer side ends the search for both; nothing is ruled out before a first distance
        at_best = best[rows]
        go = left & ((at_best == far) | (np.where(left, gap, 0) ** 2 <= np.where(at_best == far, 0, at_best) * width))
        rows, own, up, down, lower = rows[go], own[go], up[go], down[go], lower[go]
        at = np.where(lower, down, up)
        off = x[rows] - sorted_book[at]
        dist, entry = np.einsum("ij,ij->i", off, off), order[at]
        better = (dist < best[rows]) | ((dist == best[rows]) & (entry < index[rows]))
        best[rows[better]], index[rows[better]] = dist[better], entry[better]
        looked += rows.size
        down, up = down - lower, up + ~lower
    return index, best, looked


def whole_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x): the vectors without null or non-finite components, as
    integers floor(scale * component)."""
    v = rows[vector]
    ok = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.filter(F.coalesce(ok, F.lit(False))).select(rows[vec_id].cast("long").alias("vec_id"), rows[label].cast("int").alias("label"), v.alias("v"))
    # within a bound that keeps squared distances and gaps of sums in a long
    kept = kept.withColumn("bound", F.expr(f"cast({2**29} div (size(v) div {parts} + 1) as double)"))
    held = F.transform("v", lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.col("bound")), -F.col("bound"))).cast("int"))
    return kept.select("vec_id", "label", held.alias("x"))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _sums(books: list[np.ndarray], dim: int):
    """Per task: (part, entry, n, sums) of the vectors assigned to the entry."""
    cuts = cut(dim, len(books))

    def run(batches: Iterator[pa.RecordBatch]):
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.slice(a, ROWS), dim)
                for p, own in enumerate(cuts):
                    index = nearest(x[:, own], books[p])[0]
                    counts[p] += np.bincount(index, minlength=len(books[p]))
                    np.add.at(sums[p], index, x[:, own])
        for p, n in enumerate(counts):
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(n[used], pa.int64()),
                                              pa.array(sums[p][used].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])
    return run


def train(vectors: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of ``vectors`` (all of ``dim`` components): they start as
    the parts of the ``entries`` smallest vec_ids (null last; equal ids by
    vector; fewer rows, fewer entries), and each round replaces an entry by the
    floored mean of the parts nearest to it.  Unused entries stay."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()  # at most ``entries`` rows
    start = np.array([r.x for r in first], np.int64).reshape(len(first), dim)
    cuts = cut(dim, parts)
    books = [start[:, own].copy() for own in cuts]
    width = max(own.stop - own.start for own in cuts)
    for _ in range(rounds if len(first) else 0):
        sums = vectors.select("x").mapInArrow(_sums(books, dim), "part int, entry int, n long, sums array<long>")
        total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])
        books = [b.copy() for b in books]
        for r in total.collect():  # parts x entries rows
            book = books[r.part]
            book[r.entry] = [r[f"s{i}"] // r.n for i in range(book.shape[1])]
    return books


def encode(vectors: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    """(vec_id, label, code, error) of vectors of ``dim`` components."""
    cuts = cut(dim, len(books))
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int32()), ("code", pa.string()), ("error", pa.int64())])

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                x = _matrix(batch, dim)
                found = [nearest(x[:, own], book) for own, book in zip(cuts, books, strict=True)]
                codes = ["".join(f"{i:02x}" for i in row) for row in np.stack([f[0] for f in found], 1).tolist()]
                yield record(schema, batch.column("vec_id"), batch.column("label"), codes, sum(f[1] for f in found))
    return vectors.mapInArrow(run, CODED)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for book in books for c in book.ravel().tolist()).encode()).hexdigest()


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, with_books: bool = False):
    """vec_id, code (two hex digits per part), error, label_error,
    codebooks_sha256; with ``with_books`` also the codebooks.

    Rows whose vector is null or holds a null, NaN or infinite component are
    dropped.  The number of components is that of the smallest vec_id's vector
    (null last); a vector of another length has a null code and error and counts
    for nothing.  A length that ``parts`` doesn't divide makes the first parts
    one longer; an empty vector has code zeros and error 0.  Integers are held
    within about 2**29 over a part's length, so distances fit a long; a label's
    error beyond that is null.  Null labels are one label.  Repeated rows each
    have their row and weight; an empty table gives no rows; a column of
    another name is not read."""
    spark = rows.sparkSession
    path, coded_path = scratch_path(spark, "op13-vectors"), scratch_path(spark, "op13-coded")
    vectors = whole_vectors(rows, vec_id, vector, label, parts)
    vectors.write.parquet(path)
    vectors = spark.read.schema(vectors.schema).parquet(path)
    least = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").select(F.size("x").alias("n")).first()
    dim = least.n if least else 0
    same = vectors.filter(F.size("x") == dim)
    books = train(same, dim, parts, entries, rounds)
    coded = encode(same, books, dim).unionByName(vectors.filter(F.size("x") != dim).select(
        "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))
    coded.write.parquet(coded_path)
    coded = spark.read.schema(CODED).parquet(coded_path)
    errors = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    out = coded.join(errors, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
    return (out, books) if with_books else out


def _sql() -> str:
    """The same in relational steps: one row per part component."""
    steps = [f"""WITH v AS (SELECT vec_id, label, embedding e FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS (SELECT vec_id, label, p, c, floor({SCALE} * e[p * (len(e) // {PARTS}) + c]::DOUBLE)::BIGINT x
      FROM v, range({PARTS}) ps(p), (SELECT unnest(range(1, (SELECT max(len(e)) FROM v) // {PARTS} + 1)) c)),
b0 AS (SELECT p, n, c, x FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 n FROM v ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id))"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""d{i} AS (SELECT vec_id, label, x.p, n, sum((x.x - b.x) * (x.x - b.x))::BIGINT dist FROM x JOIN b{i} b ON x.p = b.p AND x.c = b.c GROUP BY ALL),
a{i} AS (SELECT vec_id, label, p, n, dist FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY dist, n) = 1)""")
        if i < ROUNDS:
            steps.append(f"""m{i} AS (SELECT x.p, n, c, sum(x)::HUGEINT s, count(*) k FROM x JOIN a{i} a ON x.vec_id = a.vec_id AND x.p = a.p GROUP BY ALL),
b{i + 1} AS (SELECT b.p, b.n, b.c, CASE WHEN k IS NULL THEN b.x ELSE ((s - ((s % k) + k) % k) // k)::BIGINT END x
             FROM b{i} b LEFT JOIN m{i} m ON b.p = m.p AND b.n = m.n AND b.c = m.c)""")
    return ",\n".join(steps) + f""",
f AS (SELECT vec_id, label, string_agg(printf('%02x', n), '' ORDER BY p) code, sum(dist)::BIGINT error FROM a{ROUNDS} GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, n, c)) FROM b{ROUNDS}) codebooks_sha256 FROM f"""


SQL = _sql()
