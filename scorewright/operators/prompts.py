"""Prompt, message and transcript construction as column expressions.

Constant prompt parts are computed once on the driver and folded into the
plan as literals; per-row work is ``concat``/``transform`` on the JVM side.
Per-conversation rendering collects one conversation's turns (bounded by the
conversation length, not by the table) and sorts them by turn.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.text import c, count_ws_tokens, py_strip, strip_chars, truncate_preview


def extraction_prompt_parts(fields=K.RELEVANT_FIELDS) -> tuple[str, str]:
    head = (K.EXTRACTION_PROMPT_HEAD + K.EXTRACTION_PROMPT_FIELDS.format(fields=", ".join(fields))
            + K.EXTRACTION_PROMPT_DOC)
    return head, K.EXTRACTION_PROMPT_TAIL


def extraction_prompt(text) -> Column:
    head, tail = extraction_prompt_parts()
    return F.concat(F.lit(head), c(text), F.lit(tail))


def sft_sample(prompt, answer) -> Column:
    return F.concat(c(prompt), F.lit(K.SFT_ANSWER_OPEN), c(answer), F.lit(K.SFT_ANSWER_CLOSE))


def message(role: str | Column, content) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.struct(r.alias("role"), c(content).alias("content"))


def reasoning_messages(problem, solution, expected) -> Column:
    """[system, user, assistant]: think tags removed from the solution,
    stripped, wrapped in the working-out tags, then the answer in solution
    tags."""
    thoughts = py_strip(F.replace(F.replace(c(solution), F.lit(K.THINK_OPEN), F.lit("")),
                                  F.lit(K.THINK_CLOSE), F.lit("")))
    final = F.concat(F.lit(K.REASONING_START), thoughts, F.lit(K.REASONING_END),
                     F.lit(K.SOLUTION_START), c(expected), F.lit(K.SOLUTION_END))
    return F.array(message("system", F.lit(K.MATH_SYSTEM_PROMPT)), message("user", problem),
                   message("assistant", final))


def prompt_messages(problem, system: str = K.MATH_SYSTEM_PROMPT) -> Column:
    return F.array(message("system", F.lit(system)), message("user", problem))


def hash_answer(text, marked: bool = False) -> Column:
    """Identity (the current rule) or, marked, the text between the first
    and second '####' stripped; null without a marker."""
    if not marked:
        return c(text)
    return F.when(c(text).contains(K.HASH_MARK), py_strip(F.split(c(text), K.HASH_MARK, -1).getItem(1)))


def flatten_messages(msgs) -> Column:
    """Contents joined by newline (a message without content gives '')."""
    return F.array_join(F.transform(c(msgs), lambda m: F.coalesce(m["content"].cast("string"), F.lit(""))), "\n")


def completion_text(df: DataFrame, col: str = "completion") -> Column:
    """The text of a completion column, be it a string, one message or a list
    of messages."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.ArrayType):
        return flatten_messages(col)
    if isinstance(kind, T.StructType):
        return F.coalesce(F.col(f"{col}.content").cast("string"), F.lit(""))
    return F.col(col)


def render_chat(msgs, eos: str = K.DEFAULT_EOS, add_generation_prompt: bool = True,
                system_prompt: str = K.MATH_SYSTEM_PROMPT) -> Column:
    """Chat template: a leading system message (else the default system
    prompt) followed by EOS; user content bare; assistant content + EOS;
    other roles nothing; optional generation prefix."""
    m = c(msgs)
    first_is_system = F.coalesce(m.getItem(0)["role"] == "system", F.lit(False))
    head = F.when(first_is_system, F.concat(m.getItem(0)["content"], F.lit(eos))).otherwise(F.lit(system_prompt + eos))
    rest = F.when(first_is_system, F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0)))).otherwise(m)
    body = F.array_join(F.transform(rest, lambda x: F.when(x["role"] == "user", x["content"])
                                    .when(x["role"] == "assistant", F.concat(x["content"], F.lit(eos)))
                                    .otherwise(F.lit(""))), "")
    gen = F.lit(K.REASONING_START if add_generation_prompt else "")
    return F.concat(head, body, gen)


def conversations_to_messages(df: DataFrame, conv: str = "conv_id", turn: str = "turn",
                              role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation with its messages in turn order."""
    items = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"),
                                                 F.col(text).alias("content"))))
    return df.groupBy(conv).agg(items.alias("_m")).select(
        conv, F.transform("_m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def split_reasoning(text, marker: str = K.THINK_CLOSE) -> tuple[Column, Column]:
    """(thinking, content) split after the last end-of-thinking marker;
    without one, thinking is '' and content the whole text; both stripped of
    newlines only."""
    t = c(text)
    content = F.substring_index(t, marker, -1)
    has = t.contains(marker)
    thinking = F.when(has, F.substring(t, F.lit(1), F.length(t) - F.length(content))).otherwise(F.lit(""))
    content = F.when(has, content).otherwise(t)
    return strip_chars(thinking, "\n"), strip_chars(content, "\n")


def preview(role, content) -> Column:
    """Transcript line preview: system 100 chars, tool 200 chars (with '...'
    only when longer), other roles in full."""
    r = c(role)
    return (F.when(r == "system", truncate_preview(content, 100))
            .when(r == "tool", truncate_preview(content, 200))
            .otherwise(c(content)))


def judge_user_text(question, reference, answer) -> Column:
    given = {"question": question, "reference": reference, "answer": answer}
    parts = re.split(r"\{(\w+)\}", K.JUDGE_USER_TEMPLATE)
    return F.concat(*[c(given[x]) if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def agent_system_prompt(inbox, query_date, max_turns: int = K.MAX_TURNS) -> Column:
    head, rest = K.AGENT_SYSTEM_PROMPT.split("{max_turns}")
    mid, tail = rest.split("{inbox}")
    mid2, tail2 = tail.split("{query_date}")
    return F.concat(F.lit(head + str(max_turns) + mid), c(inbox), F.lit(mid2), c(query_date), F.lit(tail2))


# -------------------------------------------------------------- filters
def numeric_answer(x) -> Column:
    """pandas ``to_numeric(errors='coerce')`` is not null: surrounding spaces
    allowed, 'nan' and '1d' rejected."""
    from ..functions.text import py_float
    v = py_float(F.regexp_replace(c(x), "^ +| +$", ""))
    return v.isNotNull() & ~F.isnan(v)


def token_budget_filter(df: DataFrame, tokens: str, max_seq_length: int) -> DataFrame:
    """Keep rows with ``tokens <= max_seq_length / 2`` (the half may be
    fractional)."""
    return df.filter(F.col(tokens) <= F.lit(max_seq_length / 2.0))


def quantile_length_filter(df: DataFrame, length: str, q: float = 0.9, exact: bool = True) -> DataFrame:
    """Rows up to ``int(quantile(length, q))``, a scalar subquery of the same
    plan.  The exact percentile keeps one counter per distinct length (bounded
    by the longest sequence), the other is a fixed-size sketch; without rows
    there is no cut."""
    agg = F.percentile(length, q) if exact else F.percentile_approx(length, q, 10000)
    return df.filter(F.col(length) <= df.agg(agg.cast("long").alias("q")).select("q").scalar())


def ws_token_count(text) -> Column:
    return count_ws_tokens(text)
