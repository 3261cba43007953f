"""Reward-function registry.

A reward is a function from input columns to a ``Column``; several rewards
run in one projection and their weighted sum is the total. Built-in rewards
are JVM expressions. A user's Python reward with the batch signature
``fn(prompts, completions, **columns) -> list[float]`` is adapted into an
Arrow-batched ``pandas_udf`` (one call per batch, never per row).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import math_rewards, trajectories

RewardFn = Callable[..., Column]

_REGISTRY: dict[str, tuple[RewardFn, tuple[str, ...]]] = {}


def register_reward(name: str, fn: RewardFn, columns: tuple[str, ...]) -> None:
    """``fn(*cols)`` must return a Column; ``columns`` name its inputs."""
    _REGISTRY[name] = (fn, tuple(columns))


def registered() -> list[str]:
    return sorted(_REGISTRY)


def python_reward(fn: Callable[..., list], columns: tuple[str, ...] = ("prompt", "completion")) -> RewardFn:
    """Adapt ``fn(prompts, completions, **extra) -> list[float]`` to a
    pandas UDF over the named columns."""
    extra = columns[2:]

    @F.pandas_udf(T.DoubleType())
    def run(*series: pd.Series) -> pd.Series:
        kwargs = {n: s.tolist() for n, s in zip(extra, series[2:])}
        out = fn(series[0].tolist(), series[1].tolist(), **kwargs)
        return pd.Series([None if v is None else float(v) for v in out], dtype="float64")

    return run


def score(df: DataFrame, names: list[str], weights: dict[str, float] | None = None,
          column_map: dict[str, str] | None = None, total: str = "reward") -> DataFrame:
    """Adds one column per named reward and their weighted sum."""
    cm = column_map or {}
    cols = {}
    for n in names:
        fn, inputs = _REGISTRY[n]
        cols[n] = fn(*[F.col(cm.get(i, i)) for i in inputs])
    out = df.withColumns(cols)
    w = weights or {}
    return out.withColumn(total, reduce(add, [F.col(n) * F.lit(float(w.get(n, 1.0))) for n in names]))


register_reward("format_exact", lambda comp: math_rewards.format_exact(comp), ("completion",))
register_reward("format_approx", lambda comp: math_rewards.format_approx(comp), ("completion",))
register_reward("answer_reward", lambda comp, ans: math_rewards.answer_reward(comp, ans), ("completion", "answer"))
register_reward("number_reward", lambda comp, ans: math_rewards.number_reward(comp, ans), ("completion", "answer"))
register_reward("guess_reward", lambda comp, ans: trajectories.guess_reward(comp, ans), ("completion", "answer"))


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """User batch map (``dataset.map(fn, batched=True)``) over Arrow batches."""
    def run(batches):
        for pdf in batches:
            yield fn(pdf)
    return df.mapInPandas(run, schema)


def token_counter(tokenizer_factory: Callable[[], Callable[[str], list]]):
    """Token-count column from a user tokenizer, loaded once per Python
    worker and applied to Arrow batches (iterator pandas UDF)."""
    @F.pandas_udf(T.IntegerType())
    def count(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = tokenizer_factory()
        for s in it:
            yield s.map(lambda x: None if x is None else len(tok(x))).astype("Int32")

    return count
