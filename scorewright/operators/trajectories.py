"""Stored rollout trajectories: flatten, parse tool calls, pick final
answers, cap turns, compare sources, find shared prefixes, plan validation
and check failure budgets; plus the guess-game and judge-verdict rewards.

A trajectory is one row with an array of messages
``struct<role, content, name, tool_call_id, tool_args>``. Every per-trajectory
step works inside that array (bounded by the turn count), and group-level
steps aggregate over a group of K rollouts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.text import c, truncate_preview
from ..functions.udfs import read_verdict, strict_object

def guess_reward(text, answer) -> Column:
    """exact (last tagged guess, lower-cased, equals answer) + 0.1 x has-tag;
    no tag -> guess '' and 0."""
    found = F.regexp_extract_all(c(text), F.lit(K.GUESS_PATTERN), 1)
    has = F.size(found) > 0
    guess = F.when(has, F.lower(F.element_at(found, -1))).otherwise(F.lit(""))
    return (F.when(guess == c(answer), 1.0).otherwise(0.0)
            + F.lit(K.GUESS_FORMAT_BONUS) * F.when(has, 1.0).otherwise(0.0))


def judge_verdicts(df: DataFrame, response: str = "judge_response") -> DataFrame:
    """Read stored judge responses; one that is not a strictly valid JSON
    object with a reasoning text and an accept flag is 'accept = false' with a
    parse-error reason; ``correct`` is the float of accept."""
    df = df.withColumn("_v", read_verdict(F.col(response)))
    return df.withColumns({
        "parse_ok": F.col("_v").isNotNull(),
        "accept": F.coalesce(F.col("_v.accept"), F.lit(False)),
        "reasoning": F.coalesce(F.col("_v.reasoning"), F.concat(F.lit("Parse error. Raw: "), F.coalesce(F.col(response), F.lit("")))),
    }).drop("_v").withColumn("correct", F.col("accept").cast("double"))


MESSAGE = "struct<role:string,content:string,name:string,tool_call_id:string,tool_args:string>"


def build_trajectories(rows: DataFrame, key: str = "traj_id", turn: str = "turn") -> DataFrame:
    """Long message rows -> one row per trajectory with messages in turn
    order."""
    items = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), "role", "content", "name",
                                                 "tool_call_id", "tool_args")))
    return rows.groupBy(key).agg(items.alias("_m")).select(
        key, F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"),
                                                  m["name"].alias("name"), m["tool_call_id"].alias("tool_call_id"),
                                                  m["tool_args"].alias("tool_args"))).alias("messages"))


def flatten(traj: DataFrame, key: str = "traj_id") -> DataFrame:
    """One row per message with its position, role, tool name and call id."""
    return traj.select(key, F.posexplode("messages").alias("pos", "m")).select(
        key, "pos", F.col("m.role").alias("role"), F.col("m.name").alias("tool_name"),
        F.col("m.tool_call_id").alias("tool_call_id"), F.col("m.content").alias("content"),
        F.col("m.tool_args").alias("tool_args"))


SEARCH_ARGS = T.StructType([T.StructField("keywords", T.ArrayType(T.StringType()))])
FINAL_ARGS = T.StructType([T.StructField("answer", T.StringType()),
                           T.StructField("reference_message_ids", T.ArrayType(T.StringType()))])
READ_ARGS = T.StructType([T.StructField("message_id", T.StringType())])


def tool_calls(flat: DataFrame) -> DataFrame:
    """Tool-call rows with arguments parsed by tool; unknown tools ignored.
    Arguments that are no strictly valid JSON object give nulls."""
    calls = flat.filter(F.col("tool_name").isin("search_inbox", "read_email", K.FINAL_ANSWER_TOOL))
    calls = calls.withColumn("_args", strict_object(F.col("tool_args")))

    def of(tool, schema, field):
        return F.when(F.col("tool_name") == tool, F.from_json("_args", schema)[field])
    return calls.withColumns({
        "keywords": of("search_inbox", SEARCH_ARGS, "keywords"),
        "message_id": of("read_email", READ_ARGS, "message_id"),
        "answer": of(K.FINAL_ANSWER_TOOL, FINAL_ARGS, "answer"),
        "source_ids": of(K.FINAL_ANSWER_TOOL, FINAL_ARGS, "reference_message_ids"),
    }).drop("_args")


def final_answers(calls: DataFrame, key: str = "traj_id") -> DataFrame:
    """The first final-answer call of each trajectory (it ends the rollout)."""
    fa = calls.filter(F.col("tool_name") == K.FINAL_ANSWER_TOOL)
    return fa.groupBy(key).agg(F.min_by(F.struct("pos", "answer", "source_ids"), F.col("pos")).alias("f")).select(
        key, F.col("f.pos").alias("pos"), F.col("f.answer").alias("answer"), F.col("f.source_ids").alias("source_ids"))


def cap_turns(traj: DataFrame, max_turns: int = K.MAX_TURNS) -> DataFrame:
    """Keep the messages up to the ``max_turns``-th model reply and its tool
    results (a model turn is an assistant message)."""
    # places of the model replies, in order; what precedes reply max_turns + 1 stays
    replies = F.filter(F.transform("messages", lambda m, i: F.when(m["role"] == "assistant", i)), lambda i: i.isNotNull())
    end = F.coalesce(F.get(replies, F.lit(max_turns)), F.size("messages"))
    return traj.withColumn("messages", F.slice("messages", 1, end))


def source_coverage(answers: DataFrame, expected: DataFrame, key: str = "traj_id") -> DataFrame:
    """Sources used vs expected ids: hits, precision, recall."""
    j = answers.join(expected, key)
    used = F.array_distinct(F.coalesce("source_ids", F.array().cast("array<string>")))
    exp = F.array_distinct("expected_ids")
    hit = F.size(F.array_intersect(used, exp))
    return j.select(key, F.size(used).alias("n_used"), F.size(exp).alias("n_expected"), hit.alias("n_hit"),
                    F.when(F.size(used) > 0, hit / F.size(used)).alias("precision"),
                    F.when(F.size(exp) > 0, hit / F.size(exp)).alias("recall"))


def group_prefix(traj: DataFrame, group: str, key: str = "traj_id") -> DataFrame:
    """Length of the message prefix shared by every trajectory of a group
    (same role and content at every position; compared by a 128-bit digest).
    A position is shared if its least and greatest digests agree and every
    trajectory has it, so each step is a partial aggregate."""
    flat = traj.select(group, F.posexplode("messages").alias("pos", "m")).select(
        group, "pos", F.md5(F.to_json(F.struct("m.role", "m.content"))).alias("sig"))
    sizes = traj.groupBy(group).agg(F.count(F.lit(1)).alias("n_traj"), F.min(F.size("messages")).alias("min_len"))
    per_pos = flat.groupBy(group, "pos").agg(F.min("sig").alias("a"), F.max("sig").alias("b"))
    breaks = per_pos.filter("a != b").groupBy(group).agg(F.min("pos").alias("first_break"))
    same = sizes[group].eqNullSafe(breaks[group])
    return sizes.join(breaks, same, "left").select(
        sizes[group], F.least("min_len", F.coalesce("first_break", "min_len")).cast("long").alias("prefix_len"))


def without_prefix(traj: DataFrame, group: str, key: str = "traj_id") -> DataFrame:
    """Trajectories with their group's shared prefix taken off (``prefix_len``
    says how much)."""
    cut = group_prefix(traj, group, key).toDF("_g", "prefix_len")
    rest = F.slice("messages", (F.col("prefix_len") + 1).cast("int"), F.greatest(F.size("messages"), F.lit(1)))
    return traj.join(cut, F.col(group).eqNullSafe(F.col("_g"))).drop("_g").withColumn("messages", rest)


def validation_plan(scen: DataFrame, max_steps: int, interval: int) -> DataFrame:
    """Every ``interval``-th step (0, interval, ...) runs every validation
    scenario once: a fan-out of at most max_steps/interval + 1 rows per
    scenario, no join."""
    return scen.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(max_steps), F.lit(interval))))


def failure_budget(rollouts: DataFrame, step: str, failed: str, rollouts_per_group: int,
                   items: str = "n_items") -> DataFrame:
    """Per step: failures vs the budget ``rollouts_per_group x items``."""
    agg = rollouts.groupBy(step).agg(F.count_if(F.col(failed)).alias("n_failed"),
                                     F.count_distinct("group_id").alias(items))
    return agg.withColumn("budget", F.col(items) * F.lit(rollouts_per_group)).withColumn(
        "within_budget", F.col("n_failed") <= F.col("budget"))


def zero_fraction(df: DataFrame, arr: str) -> Column:
    """Share of entries that are 0; null for an empty or null array."""
    return F.try_divide(F.size(F.filter(arr, lambda x: x == 0)), F.size(arr))


def ranking_lines(messages: DataFrame, ranked: DataFrame, key: str = "traj_id", turn: str = "turn", content: str = "content") -> DataFrame:
    """One line per ranked trajectory (key, group_id, rank, reward, response):
    the first 50 characters of its last message, always with '...' behind them.
    A trajectory without messages has a null response."""
    last = messages.groupBy(key).agg(F.max_by(truncate_preview(content, K.RANKING_PREVIEW_CHARS, always=True), turn).alias("response"))
    return ranked.select(key, "group_id", "rank", "reward").join(last, key, "left")
