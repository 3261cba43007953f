"""Operator 1: token counts by rank-synchronous array merging."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .batches import record, slices
from .bpe import PreTokenizer, load_table, merge_ragged

#: Most pre-tokens that a Python worker remembers, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 400_000, 64
_counts: dict[str, dict[str, int]] = {}


class Counter:
    """Counts tokens of texts.  The distinct pre-tokens of a batch that were
    not seen yet are merged together as one ragged array."""

    def __init__(self, path: str):
        self.table = load_table(path)
        self.split = PreTokenizer(path, self.table)
        self.known = _counts.setdefault(path, {})

    def __call__(self, texts: list[str]) -> list[int]:
        split = [self.split(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, local = self.known, {}
        fresh = [w for w in set().union(*split) if w not in known]
        for w in [w for w in fresh if not isinstance(w, str)]:  # a special string
            local[w] = 1
        fresh = [w for w in fresh if isinstance(w, str)]
        _, n = merge_ragged(self.table, *self.table.symbols([w.encode() for w in fresh]))
        for w, k in zip(fresh, n.tolist(), strict=True):
            (known if len(w) <= CACHE_CHARS else local)[w] = k
        if not local:
            return [sum(map(known.__getitem__, ws)) for ws in split]
        return [sum(known[w] if w in known else local[w] for w in ws) for ws in split]


def count_tokens(docs: DataFrame, path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    Row by row, without a shuffle.  A null text counts as empty (0 bytes,
    0 tokens); a null doc_id stays null; repeated rows each give a row; other
    columns are not read.  Texts are never cut: the working memory is one
    slice of texts (about 2 MB or the longest text) and a bounded word cache."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        count = Counter(path)
        for b in slices(batches):
            n = count(b.column(1).to_pylist())
            yield record(schema, b.column(0), pc.binary_length(b.column(1)).cast(pa.int64()), n, [k > limit for k in n])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
