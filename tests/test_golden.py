"""Golden rows from the task definitions and the Python-vs-JVM edge cases."""

import pytest
from pyspark.sql import functions as F

from scorewright import constants as K
from scorewright.functions import text as tx
from scorewright.operators import extraction, groups, math_rewards, prompts, trajectories


def one(spark, col, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(col.alias("x")).first()["x"]


def test_format_pattern_examples(spark):
    pat = math_rewards.format_pattern()
    t1 = "Let me think!<end_working_out><SOLUTION>\n2\n</SOLUTION>"
    t2 = "<start_working_out>Let me think!<end_working_out><SOLUTION>  2  </SOLUTION>\n\n"
    assert one(spark, tx.regex_group_or_null("t", pat), t=t1) == "\n2\n"
    assert one(spark, tx.regex_group_or_null("t", pat), t=t2) == "  2  "
    assert one(spark, math_rewards.format_exact("t"), t=t1) == 3.0


def test_number_pattern_examples(spark):
    pat = K.NUMBER_PATTERN
    for text, want in [("<SOLUTION>  0.34  </SOLUTION>", "0.34"), ("<SOLUTION>  123,456  </SOLUTION>", "123,456"),
                       ("<SOLUTION>  -0.234  </SOLUTION>", "-0.234"), ("<SOLUTION>17</SOLUTION>", "17")]:
        assert one(spark, tx.regex_group_or_null("t", pat), t=text) == want


def test_answer_reward_table(spark):
    w = K.REASONING_END + K.SOLUTION_START
    cases = [(w + "5" + K.SOLUTION_END, "5", 5.0), (w + " 5 " + K.SOLUTION_END, "5", 3.5),
             (w + "10.5" + K.SOLUTION_END, "10", 2.0), (w + "11.5" + K.SOLUTION_END, "10", 1.5),
             (w + "20" + K.SOLUTION_END, "10", -2.5), (w + "abc" + K.SOLUTION_END, "10", -4.5),
             (w + "1d" + K.SOLUTION_END, "1", -4.5), (w + "3" + K.SOLUTION_END, "0", -4.5),
             ("no tags", "1", -2.0)]
    for text, ans, want in cases:
        assert one(spark, math_rewards.answer_reward("t", "a"), t=text, a=ans) == want, text


def test_number_reward_table(spark):
    s = K.SOLUTION_START
    cases = [(s + "123,456", "123456", 3.5), (s + "7", "8", -1.5), ("nothing", "1", -2.5),
             (s + ".", "1", 0.0), (s + "5", "123,456", 0.0)]
    for text, ans, want in cases:
        assert one(spark, math_rewards.number_reward("t", "a"), t=text, a=ans) == want, text


def test_format_approx_bounds(spark):
    full = K.REASONING_END + K.SOLUTION_START + "1" + K.SOLUTION_END
    assert one(spark, math_rewards.format_approx("t"), t=full) == 1.5
    assert one(spark, math_rewards.format_approx("t"), t="") == -3.0
    assert one(spark, math_rewards.format_approx("t"), t=full + full) == -3.0


def test_chat_template_example(spark):
    msgs = F.array(prompts.message("user", F.lit("What is 1+1?")),
                   prompts.message("assistant", F.lit(f"{K.REASONING_START}I think it's 2.{K.REASONING_END}"
                                                       f"{K.SOLUTION_START}2{K.SOLUTION_END}")),
                   prompts.message("user", F.lit("What is 2+2?")))
    got = spark.range(1).select(prompts.render_chat(msgs).alias("x")).first()["x"]
    want = (K.MATH_SYSTEM_PROMPT + K.DEFAULT_EOS + "What is 1+1?"
            + f"{K.REASONING_START}I think it's 2.{K.REASONING_END}{K.SOLUTION_START}2{K.SOLUTION_END}" + K.DEFAULT_EOS
            + "What is 2+2?" + K.REASONING_START)
    assert got == want


def test_trailing_comma_scores_zero(spark):
    gold = '{"title": "Folding chair", "decision": "PENDING"}'
    df = spark.createDataFrame([('{"title": "Folding chair", "decision": "PENDING",}', gold)], "completion string, gold_json string")
    r = extraction.score_extraction(extraction.parse_gold(df)).first()
    assert (r["reward"], r["validity"], r["field_mean"], r["constraints"], r["format"]) == (0.0, 0.0, 0.0, 0.0, 0.0)


def test_group_rank_example(spark):
    df = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.5), (1, 2, 0.1)], "prompt_id int, gen_idx int, reward double")
    got = [(r["gen_idx"], r["rank"]) for r in groups.group_rank(df).orderBy("rank").collect()]
    assert got == [(0, 1), (1, 2), (2, 3)]


def test_group_normalize_equal_and_spread(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, 2.0), (2, 0, 1.0), (2, 1, 3.0)], "prompt_id int, gen_idx int, reward double")
    out = {(r["prompt_id"], r["gen_idx"]): r["advantage"] for r in groups.group_normalize(df).collect()}
    assert out[(1, 0)] == 0.0 and out[(1, 1)] == 0.0
    assert out[(2, 0)] == pytest.approx(-1.0 / (1.0 + 1e-6), abs=1e-9)


def test_python_whitespace_and_floats(spark):
    assert one(spark, tx.py_strip("t"), t="  a b\u001c\u0085") == "a b"
    assert one(spark, tx.collapse_ws("t"), t="a  b") == "a b"
    assert one(spark, tx.py_float("t"), t="1d") is None
    assert one(spark, tx.py_float("t"), t="5f") is None
    assert one(spark, tx.py_float("t"), t=" 2.5 ") == 2.5
    assert one(spark, tx.py_float("t"), t="1e3") == 1000.0


def test_guess_without_tag(spark):
    assert one(spark, trajectories.guess_reward("t", "a"), t="about", a="about") == 0.0
    assert one(spark, trajectories.guess_reward("t", "a"), t="<guess>x</guess> <guess> ABOUT </guess>", a="about") == 1.1


def test_dates_one_digit(spark):
    df = spark.createDataFrame([('{"filing_date": "2020-1-5", "date_published": "2020/01/04"}',)], "completion string")
    r = extraction.parse_pred(df).select(extraction.constraints("pred").alias("c")).first()
    assert r["c"] == 0.0  # filing 2020-01-05 after published 2020-01-04
