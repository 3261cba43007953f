"""Few rows of a large table by a list of keys, without shuffling the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.search import key_filter

#: Bits of the filter: about BITS_PER_KEY for each key, between these bounds (128 KiB and 8 MiB).
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 26


def sieve(keys: DataFrame, cols: list[str]) -> Column:
    """Condition on columns of the same names that holds wherever they occur in
    ``keys``, and for few other rows.  ``keys`` should be a written table: it is
    counted, and read again by the filter."""
    bits = LEAST_BITS
    wanted = min(MOST_BITS, BITS_PER_KEY * keys.count())
    while bits < wanted:
        bits *= 2
    return key_filter(keys, cols, bits)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def without(df: DataFrame, keys: DataFrame, values: list[Column]) -> DataFrame:
    """The rows whose ``values`` are no row of ``keys`` (a written table of as
    many columns; nulls are equal to nulls), with all their columns.  Rows that
    the filter lets through stay where they are; the few others are joined."""
    names = fresh(df, *[f"_k{i}" for i in range(len(values))], *[f"_k{i}_" for i in range(len(values))])
    names, theirs = names[: len(values)], names[len(values) :]
    own = df.withColumns(dict(zip(names, values, strict=True)))
    maybe = sieve(keys.toDF(*names), names)
    same = F.lit(True)
    for a, b in zip(names, theirs, strict=True):
        same = same & F.col(a).eqNullSafe(F.col(b))
    others = keys.toDF(*theirs)
    sure = own.filter(~maybe).drop(*names)
    rest = own.filter(maybe).join(others, same, "left_anti").drop(*names)
    return sure.unionByName(rest)

